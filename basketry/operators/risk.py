"""Interaction-risk scoring of baskets against knowledge tables.

Tables: ``toxic(item, ld50, max_dose, pregnancy, ingredient)``, ``reactions(item, type, severity)``,
``pairs(herb_a, herb_b, risk_level, evidence_level, interaction_type)``, ``families(item, family, toxicity_type,
base_risk)``. They are joined by key; whether one is small enough to broadcast is left to Spark's own size check.

Pairs inside a basket are formed only among its *relevant* items: each rule joins through the knowledge table,
so a basket of a million harmless items produces nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.groups import dealt, hot_groups, pairs_in_groups, small_side
from ..functions.lineage import cut_lineage
from ..functions.scalars import literal_map, map_get, tier
from .rows import first_per_key


@dataclass(frozen=True)
class RiskWords:
    """Vocabulary of the knowledge tables: levels with weights, evidence weights and fixed words."""

    levels: dict[str, float] = field(default_factory=lambda: {"extreme": 1.0, "high": 0.75, "medium": 0.45, "low": 0.2, "minimal": 0.05})
    evidence: dict[str, float] = field(default_factory=lambda: {"A": 1.0, "B": 0.8, "C": 0.5, "D": 0.3})
    high: str = "high"
    medium: str = "medium"
    low: str = "low"
    extreme: str = "extreme"
    safe: str = "safe"
    organ_words: tuple[str, ...] = ("liver", "kidney")
    banned: tuple[str, ...] = ("banned", "avoid")
    caution: str = "caution"
    inferred: str = "avoid (inferred)"
    unknown: str = "unknown"
    overlap_type: str = "toxic overlap"
    family_type: str = "inferred family toxicity"
    analogy_type: str = "inferred analogy"
    organ_type: str = "inferred shared organ"


def pair_scores(pairs: DataFrame, words: RiskWords = RiskWords()) -> DataFrame:
    """Knowledge pairs with an unordered key and ``risk_score`` = level weight x evidence weight x 100."""
    level = map_get(literal_map(words.levels), "risk_level", 0.3)
    evidence = map_get(literal_map(words.evidence), "evidence_level", 0.3)
    keyed = pairs.select(
        F.least("herb_a", "herb_b").alias("item_a"), F.greatest("herb_a", "herb_b").alias("item_b"),
        "risk_level", "interaction_type", F.round(level * evidence * 100, 2).alias("risk_score"))
    # one row per unordered pair: the strongest entry
    return first_per_key(keyed, ["item_a", "item_b"], [F.desc("risk_score"), F.asc("interaction_type")])


def _items(basket_items: DataFrame) -> DataFrame:
    return dealt(basket_items.select("basket_id", "item").filter(F.col("item").isNotNull()), "basket_id", "item").distinct()


def _pairs_among(bi: DataFrame, *tables: DataFrame) -> DataFrame:
    """``basket_id, item_a, item_b`` of the pairs inside baskets among items of the knowledge tables only."""
    relevant = tables[0].select("item")
    for other in tables[1:]:
        relevant = relevant.union(other.select("item"))
    kept = bi.join(relevant.distinct(), "item", "left_semi")
    return pairs_in_groups(kept, "basket_id", "item").select("basket_id", "item_a", "item_b")


def known_risk_pairs(basket_items: DataFrame, pairs: DataFrame, words: RiskWords = RiskWords()) -> DataFrame:
    """Pairs of the knowledge table that occur together in a basket.

    Only items of the table are paired, and pairs are not shuffled if the table's are few enough to broadcast. In a basket with more of them than a block, an item meets only its partners in the table, and
    the partner is then looked up in the same basket, so there no pair that is not in the table is ever formed.
    """
    scored = _scored(pairs, words)
    ordinary, big = _by_size(_items(basket_items), _listed(scored))
    known = _known(scored)
    found = pairs_in_groups(ordinary, "basket_id", "item", counted=True).join(known, ["item_a", "item_b"]).select(*FOUND)
    return found.unionByName(rest) if (rest := _looked_up(ordinary, big, known)) is not None else found


def _scored(pairs: DataFrame, words: RiskWords) -> DataFrame:
    """``pair_scores``, stored and counted, as several steps join it."""
    scored = cut_lineage(pair_scores(pairs, words))
    return small_side(scored.count(), scored)


def _listed(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode(F.array("item_a", "item_b")).alias("item"))


def _known(scored: DataFrame) -> DataFrame:
    return scored.withColumns({"inferred": F.lit(False), "priority": F.lit(1)})


def _by_size(bi: DataFrame, *tables: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Items of the tables, without null baskets: of baskets that hold at most a block of them, and of the others if there are any."""
    relevant = tables[0].select("item")
    for other in tables[1:]:
        relevant = relevant.union(other.select("item"))
    relevant = cut_lineage(relevant.distinct())
    kept = bi.join(small_side(relevant.count(), relevant), "item", "left_semi").filter(F.col("basket_id").isNotNull())
    n_hot, hot = hot_groups(kept, "basket_id")
    if not n_hot:
        return kept, None
    hot = small_side(n_hot, hot.select("basket_id"))
    return kept.join(hot, "basket_id", "left_anti"), kept.join(hot, "basket_id", "left_semi")


def _looked_up(ordinary: DataFrame, big: DataFrame | None, known: DataFrame) -> DataFrame | None:
    """Known pairs that are not formed: those of the big baskets, and entries of one item (its partner not named); None if there are none."""
    single = known.filter(F.col("item_a") == F.col("item_b"))
    out = ordinary.withColumnRenamed("item", "item_a").join(single, "item_a").select(*FOUND) if single.count() else None
    if big is None:
        return out
    first = big.withColumnRenamed("item", "item_a").join(known, "item_a")
    found = first.join(big.withColumnRenamed("item", "item_b"), ["basket_id", "item_b"]).select(*FOUND)
    return found if out is None else out.unionByName(found)


PAIR_DETAILS = ("mechanism", "evidence_level", "references")


def with_pair_details(found: DataFrame, pairs: DataFrame, details: Sequence[str] = PAIR_DETAILS, words: RiskWords = RiskWords()) -> DataFrame:
    """``found(item_a, item_b, ...)`` with what the knowledge table says of the pair beyond its score.

    The details are those of the entry that gave the pair its score; pairs not in the table have nulls, as has a detail the table lacks.
    """
    level, evidence = map_get(literal_map(words.levels), "risk_level", 0.3), map_get(literal_map(words.evidence), "evidence_level", 0.3)
    keyed = pairs.select(
        F.least("herb_a", "herb_b").alias("item_a"), F.greatest("herb_a", "herb_b").alias("item_b"), F.round(level * evidence * 100, 2).alias("_score"), F.col("interaction_type").alias("_type"),
        *[F.col(c) if c in pairs.columns else F.lit(None).cast("string").alias(c) for c in details])
    best = first_per_key(keyed, ["item_a", "item_b"], [F.desc("_score"), F.asc("_type")]).drop("_score", "_type")
    return found.join(best, ["item_a", "item_b"], "left")


def _overlap_rules(kinds: DataFrame, toxic: DataFrame, words: RiskWords) -> DataFrame:
    """Two toxic items: risk .2 + .6 x the larger ``min(1, 10 / ld50)`` (ld50 missing or 0 counts as 100)."""
    ld50 = F.coalesce(F.when(F.col("ld50") != 0, F.col("ld50")), F.lit(100.0))
    shares = toxic.select("item", F.least(F.lit(1.0), 10.0 / ld50).alias("share"))
    a = shares.withColumnsRenamed({"item": "item_a", "share": "_sa"})
    b = shares.withColumnsRenamed({"item": "item_b", "share": "_sb"})
    risk = 0.2 + 0.6 * F.greatest("_sa", "_sb")
    return kinds.join(a, "item_a").join(b, "item_b").select(
        *kinds.columns, F.when(risk > 0.5, words.high).otherwise(words.medium).alias("risk_level"),
        F.lit(words.overlap_type).alias("interaction_type"), F.round(risk * 100, 2).alias("risk_score"), F.lit(False).alias("inferred"), F.lit(2).alias("priority"))


def _inference_rules(kinds: DataFrame, pairs: DataFrame, families: DataFrame, reactions: DataFrame, words: RiskWords) -> DataFrame:
    """(a) same toxic family; (b) families analogous to those of a known pair, in the order the pair names them;
    (c) a shared liver or kidney reaction."""
    fa = families.select(F.col("item").alias("item_a"), F.col("family").alias("_fa"), F.col("base_risk").alias("_base"))
    fb = families.select(F.col("item").alias("item_b"), F.col("family").alias("_fb"))
    fam = kinds.join(fa, "item_a").join(fb, "item_b")
    keys = kinds.columns

    score = F.least(F.lit(1.0), F.when(F.col("_base") == words.high, 0.3).otherwise(0.18) + 0.25)
    same = fam.filter(F.col("_fa") == F.col("_fb")).select(
        *keys, F.when(score > 0.5, words.high).otherwise(words.medium).alias("risk_level"), F.lit(words.family_type).alias("interaction_type"),
        F.round(score * 100, 2).alias("risk_score"), F.lit(True).alias("inferred"), F.lit(3).alias("priority"))

    swapped = F.col("swapped")
    ordered = fam.withColumn("first_family", F.when(swapped, F.col("_fb")).otherwise(F.col("_fa"))).withColumn(
        "second_family", F.when(swapped, F.col("_fa")).otherwise(F.col("_fb")))
    similar = ordered.join(analogous_families(pairs, families), ["first_family", "second_family"], "left_semi").select(
        *keys, F.lit(words.low).alias("risk_level"), F.lit(words.analogy_type).alias("interaction_type"),
        F.lit(20.0).alias("risk_score"), F.lit(True).alias("inferred"), F.lit(4).alias("priority"))

    organ = reactions.filter(_mentions("type", words.organ_words)).select("item", "type").distinct()
    shared = kinds.join(organ.withColumnRenamed("item", "item_a"), "item_a").join(organ.withColumnRenamed("item", "item_b"), ["item_b", "type"])
    organs = shared.select(*keys).distinct().select(
        *keys, F.lit(words.medium).alias("risk_level"), F.lit(words.organ_type).alias("interaction_type"),
        F.lit(35.0).alias("risk_score"), F.lit(True).alias("inferred"), F.lit(5).alias("priority"))
    return same.unionByName(similar).unionByName(organs)


def _with_order(met: DataFrame, basket_items: DataFrame) -> DataFrame:
    """Add ``swapped``: the basket lists item_b before item_a (``item_pos``); false when positions are not given."""
    if "item_pos" not in basket_items.columns:
        return met.withColumn("swapped", F.lit(False))
    pos = basket_items.groupBy("basket_id", "item").agg(F.min("item_pos").alias("_pos"))
    j = (met.join(pos.withColumnsRenamed({"item": "item_a", "_pos": "_pa"}), ["basket_id", "item_a"])
         .join(pos.withColumnsRenamed({"item": "item_b", "_pos": "_pb"}), ["basket_id", "item_b"]))
    return j.select("basket_id", "item_a", "item_b", (F.col("_pb") < F.col("_pa")).alias("swapped"))


KINDS = ["item_a", "item_b", "swapped"]
FOUND = ["basket_id", "item_a", "item_b", "risk_level", "interaction_type", "risk_score", "inferred", "priority"]


def toxic_overlap_pairs(basket_items: DataFrame, toxic: DataFrame, words: RiskWords = RiskWords()) -> DataFrame:
    """Two toxic items in one basket, pairs of the knowledge table included; :func:`detect_risk_pairs` keeps the known rule for those."""
    met = _pairs_among(_items(basket_items), toxic)
    return met.join(_overlap_rules(met.select("item_a", "item_b").distinct(), toxic, words), ["item_a", "item_b"]).select(*FOUND)


def infer_interactions(basket_items: DataFrame, pairs: DataFrame, families: DataFrame, reactions: DataFrame,
                       words: RiskWords = RiskWords()) -> DataFrame:
    """Rule-based inferences for pairs that are not in the knowledge table; a pair may match several rules.

    A rule depends on the two items only, so rules are evaluated once per distinct pair and joined back.
    """
    met = _with_order(_pairs_among(_items(basket_items), families, reactions), basket_items)
    known = pair_scores(pairs, words).select("item_a", "item_b")
    kinds = met.select(*KINDS).distinct().join(known, ["item_a", "item_b"], "left_anti")
    return met.join(_inference_rules(kinds.select(*KINDS), pairs, families, reactions, words), KINDS).select(*FOUND)


def _mentions(column: str, words: tuple[str, ...]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.col(column).contains(w)
    return cond


def analogous_families(pairs: DataFrame, families: DataFrame) -> DataFrame:
    """(first, second) family of every known pair whose two items both belong to a family."""
    a = families.select(F.col("item").alias("herb_a"), F.col("family").alias("first_family"))
    b = families.select(F.col("item").alias("herb_b"), F.col("family").alias("second_family"))
    return pairs.select("herb_a", "herb_b").join(a, "herb_a").join(b, "herb_b").select("first_family", "second_family").distinct()


def detect_risk_pairs(basket_items: DataFrame, toxic: DataFrame, pairs: DataFrame, families: DataFrame | None = None,
                      reactions: DataFrame | None = None, words: RiskWords = RiskWords()) -> DataFrame:
    """All risk pairs, one row per basket and unordered pair: known before toxic overlap before inference.

    The priority is settled on distinct item pairs (a table of the vocabulary, not of the baskets) and joined back to
    the pairs of the baskets, so no basket-sized table is sorted. Both tables are stored: the pairs of the baskets are only shuffled if
    the vocabulary's are too many to broadcast.
    """
    bi = cut_lineage(_items(basket_items))
    scored = _scored(pairs, words)
    tables = [toxic] if families is None or reactions is None else [toxic, families, reactions]
    ordinary, big = _by_size(bi, *tables, _listed(scored))
    pos = basket_items if "item_pos" in basket_items.columns else bi
    met = _with_order(pairs_in_groups(ordinary, "basket_id", "item", counted=True).select("basket_id", "item_a", "item_b"), pos)
    more = None if big is None else _with_order(_pairs_among(big, *tables), pos)
    seen = (met if more is None else met.unionByName(more)).select(*KINDS).distinct()
    kinds = cut_lineage(seen.join(scored.select("item_a", "item_b"), ["item_a", "item_b"], "left_anti").select(*KINDS))
    rules = _overlap_rules(kinds, toxic, words)
    if len(tables) > 1:
        rules = rules.unionByName(_inference_rules(kinds, pairs, families, reactions, words))
    rules = first_per_key(rules, KINDS, [F.asc("priority")])
    # in an ordinary basket the known pairs are formed with the others
    known = _known(scored)
    settled = cut_lineage(rules.unionByName(known.withColumn("swapped", F.lit(None).cast("boolean"))))
    either = settled.withColumnRenamed("swapped", "_s")
    found = met.join(small_side(either.count(), either), ["item_a", "item_b"]).filter((F.col("priority") == 1) | (F.col("swapped") == F.col("_s"))).select(*FOUND)
    if more is not None:
        found = found.unionByName(more.join(settled.filter(F.col("priority") > 1), KINDS).select(*FOUND))
    return found.unionByName(rest) if (rest := _looked_up(ordinary, big, known)) is not None else found


def expand_profiles(items: DataFrame, toxic: DataFrame, families: DataFrame, reactions: DataFrame, type_rules: DataFrame,
                    words: RiskWords = RiskWords()) -> tuple[DataFrame, DataFrame]:
    """Reactions inferred from the family's toxicity type: (profile per item, reactions known and inferred).

    ``type_rules(word, type, severity)``: a toxicity type that contains the word adds the reaction, unless known.
    """
    fam = items.select("item").join(families, "item")
    inferred = fam.join(type_rules, F.col("toxicity_type").contains(F.col("word"))).select("item", "type", "severity").distinct()
    inferred = inferred.join(reactions.select("item", "type"), ["item", "type"], "left_anti").withColumn("inferred", F.lit(True))
    known = reactions.join(items.select("item"), "item", "left_semi").select("item", "type", "severity").withColumn("inferred", F.lit(False))
    n = inferred.groupBy("item").agg(F.count(F.lit(1)).alias("inferred_count"))
    base = items.select("item").join(toxic.select("item", F.col("pregnancy").alias("_p"), F.lit(True).alias("_t")), "item", "left").join(
        families.select("item", "family"), "item", "left").join(n, "item", "left")
    has_p = F.col("_p").isNotNull() & (F.col("_p") != "")
    profile = base.select(
        "item", F.coalesce("_t", F.lit(False)).alias("base_known"), "family",
        F.when(has_p, F.col("_p")).when(F.col("family").isNotNull(), words.banned[0]).otherwise(words.unknown).alias("pregnancy_risk"),
        F.coalesce("inferred_count", F.lit(0).cast("long")).alias("inferred_count"),
        F.when(F.col("_t"), 0.7).otherwise(0.4).alias("confidence"))
    return profile, known.unionByName(inferred)


def pregnancy_risk(basket_items: DataFrame, toxic: DataFrame, families: DataFrame, words: RiskWords = RiskWords()) -> DataFrame:
    """Per basket: overall level and how many items are banned, inferred from their family, or need caution.

    The item lists themselves are rows of :func:`pregnancy_items`, so a long basket makes no long array.
    """
    kinds = pregnancy_items(basket_items, toxic, families, words)
    counts = kinds.groupBy("basket_id").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("banned", "caution", "inferred")])
    all_ids = basket_items.select("basket_id").distinct()
    out = all_ids.join(counts, "basket_id", "left").na.fill(0, ["banned", "caution", "inferred"])
    overall = F.when(F.col("banned") > 0, words.banned[0]).when(F.col("inferred") > 0, words.inferred).when(
        F.col("caution") > 0, words.caution).otherwise(words.safe)
    return out.select("basket_id", overall.alias("overall_risk"), "banned", "caution", "inferred")


def pregnancy_items(basket_items: DataFrame, toxic: DataFrame, families: DataFrame, words: RiskWords = RiskWords()) -> DataFrame:
    """``basket_id, item, kind`` for items that matter in pregnancy (banned, caution, inferred)."""
    known = toxic.select("item", F.when(F.col("pregnancy").isin(*words.banned), "banned").when(F.col("pregnancy") == words.caution, "caution").alias("kind")).filter("kind is not null")
    inferred = families.select("item").distinct().join(known, "item", "left_anti").withColumn("kind", F.lit("inferred"))
    return _items(basket_items).join(known.unionByName(inferred), "item").select("basket_id", "item", "kind")


def overdose(basket_doses: DataFrame, toxic: DataFrame) -> DataFrame:
    """Doses above the safe maximum: ``basket_id, item, dose, max_dose, percent_over``."""
    safe = toxic.filter(F.col("max_dose") > 0).select("item", "max_dose")
    return basket_doses.join(safe, "item").filter(F.col("dose") > F.col("max_dose")).select(
        "basket_id", "item", "dose", "max_dose", ((F.col("dose") / F.col("max_dose") - 1) * 100).alias("percent_over"))


def assess_risk(basket_items: DataFrame, toxic: DataFrame, pairs: DataFrame, families: DataFrame | None = None,
                reactions: DataFrame | None = None, basket_doses: DataFrame | None = None, words: RiskWords = RiskWords(),
                risk_pairs: DataFrame | None = None) -> DataFrame:
    """One row per basket: counts, overall score (0-100), level. ``risk_pairs`` reuses a stored detection."""
    found = detect_risk_pairs(basket_items, toxic, pairs, families, reactions, words) if risk_pairs is None else risk_pairs
    tox = toxic.select("item", F.lit(1).cast("long").alias("_t")).distinct()
    severe = ~F.col("inferred") & F.col("risk_level").isin(words.high, words.extreme)
    # one row per item, pair or overdose of a basket, added up in one grouping: nothing basket-sized is joined or sorted
    rows = _items(basket_items).join(tox, "item", "left").select("basket_id", F.lit(1).cast("long").alias("n_items"), F.col("_t").alias("n_toxic"))
    rows = rows.unionByName(found.filter(F.col("basket_id").isNotNull()).select(
        "basket_id", F.when(~F.col("inferred"), F.col("risk_score")).alias("_max"), F.when(F.col("inferred"), 1).alias("n_inferred"),
        F.when(~F.col("inferred"), 1).alias("n_known"), F.when(severe, 1).alias("n_severe")), allowMissingColumns=True)
    if basket_doses is None:
        rows = rows.withColumn("n_overdose", F.lit(0).cast("long"))
    else:
        over = overdose(basket_doses, toxic).filter(F.col("basket_id").isNotNull())
        rows = rows.unionByName(over.select("basket_id", F.lit(1).cast("long").alias("n_overdose")), allowMissingColumns=True)
    sums = ("n_items", "n_toxic", "n_inferred", "n_known", "n_severe", "n_overdose")
    out = rows.groupBy("basket_id").agg(F.coalesce(F.max("_max"), F.lit(0.0)).alias("_max"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in sums])
    out = out.filter(F.col("n_items") > 0)
    score = F.least(F.lit(1.0), 0.3 * F.col("_max") / 100.0 + 0.3 * F.col("n_toxic") / F.greatest(F.col("n_items"), F.lit(1))
                    + 0.12 * F.least(F.lit(0.3), F.col("n_toxic") * 0.12) + 0.13 * F.least(F.lit(0.15), F.col("n_inferred") * 0.08)
                    + 0.15 * (F.col("n_overdose") * 0.15))
    level = tier("_score", [(0.7, words.extreme), (0.5, words.high), (0.25, words.medium), (0.1, words.low)], words.safe)
    return out.withColumn("_score", score).select(
        "basket_id", "n_items", "n_toxic", "n_known", "n_severe", "n_inferred", "n_overdose",
        (F.col("_score") * 100).alias("risk_score"), level.alias("risk_level"))


def warnings(assessed: DataFrame, found: DataFrame, over: DataFrame, pregnant: DataFrame, words: RiskWords = RiskWords()) -> DataFrame:
    """Warnings as rows ``basket_id, kind, text``: overdoses, severe known pairs, inferred risks, pregnancy."""
    doses = over.select("basket_id", F.lit("overdose").alias("kind"), F.format_string(
        "%s: dose %.1f g is above the safe %.1f g (by %.1f%%)", "item", F.col("dose").cast("double"), F.col("max_dose").cast("double"), "percent_over").alias("text"))
    severe = found.filter(~F.col("inferred") & F.col("risk_level").isin(words.high, words.extreme)).select(
        "basket_id", F.lit("pair").alias("kind"), F.format_string("%s: %s with %s (%s)", "interaction_type", "item_a", "item_b", "risk_level").alias("text"))
    inferred = assessed.filter(F.col("n_inferred") > 0).select(
        "basket_id", F.lit("inferred").alias("kind"), F.format_string("%d inferred risks need verification", F.col("n_inferred")).alias("text"))
    preg = pregnant.filter(F.col("kind").isin("banned", "inferred")).select(
        "basket_id", F.lit("pregnancy").alias("kind"), F.format_string("%s: not in pregnancy (%s)", "item", "kind").alias("text"))
    return doses.unionByName(severe).unionByName(inferred).unionByName(preg)


def guidance(assessed: DataFrame, pregnant: DataFrame, texts: dict[str, str], words: RiskWords = RiskWords()) -> DataFrame:
    """Guidance list per basket. ``texts`` keys: dose, start_low, not_long, monitor, pregnancy, vulnerable, stop, inferred."""
    p = pregnant.select("basket_id", (F.col("overall_risk") != words.safe).alias("_p"))
    rows = assessed.join(p, "basket_id", "left")
    rules = [
        ("dose", F.col("risk_score") > 10), ("start_low", F.col("risk_score") > 10), ("not_long", F.col("n_toxic") > 0), ("monitor", F.col("n_toxic") > 0),
        ("pregnancy", F.coalesce("_p", F.lit(False))), ("vulnerable", F.col("n_items") >= 10), ("stop", F.col("risk_score") >= 50), ("inferred", F.col("n_inferred") > 0),
    ]
    return rows.select("basket_id", F.array_compact(F.array(*[F.when(c, texts[k]) for k, c in rules if k in texts])).alias("guidance"))


def profile_reactions(basket_items: DataFrame, reactions: DataFrame) -> DataFrame:
    """Known reactions of a basket's items per basket, reaction type and severity."""
    return _items(basket_items).join(reactions, "item").groupBy("basket_id", "type", "severity").agg(F.count(F.lit(1)).alias("count"))


def item_reactions(basket_items: DataFrame, reactions: DataFrame) -> DataFrame:
    """Every known reaction of every item of a basket, with all that the table says of it (symptoms, frequency, onset)."""
    return _items(basket_items).join(reactions, "item").select("basket_id", *reactions.columns)


def risk_edges(found: DataFrame) -> DataFrame:
    """Best-scored risk per unordered item pair over all baskets (``herb_a, herb_b, risk_level, risk_score, interaction_type``)."""
    kinds = found.select("item_a", "item_b", "risk_level", "risk_score", "interaction_type").distinct()  # few, and told apart before anything is sorted
    best = first_per_key(kinds, ["item_a", "item_b"], [F.desc("risk_score"), F.asc("risk_level"), F.asc("interaction_type")])
    return best.select(F.col("item_a").alias("herb_a"), F.col("item_b").alias("herb_b"), "risk_level", "risk_score", "interaction_type")


def level_rank(words: RiskWords = RiskWords(), column: str = "risk_level") -> Column:
    """Position of a level among the vocabulary's, the lightest first (0: no such level)."""
    return F.array_position(F.array(*[F.lit(x) for x in sorted(words.levels, key=words.levels.get)]), F.col(column))


def list_risk_pairs(edges: DataFrame, min_level: str | None = None, limit: int = 50, words: RiskWords = RiskWords()) -> DataFrame:
    """Risk pairs at or above a level (the vocabulary's low one when not given), highest score first, with the size of the whole listing."""
    order = sorted(words.levels, key=words.levels.get)
    kept = edges.filter(level_rank(words) > order.index(min_level or words.low))
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.orderBy(F.desc("risk_score"), "herb_a", "herb_b").limit(limit).withColumn("total", total)


def interaction_types(edges: DataFrame) -> DataFrame:
    return edges.select("interaction_type").distinct()


def enrich_baskets(baskets: DataFrame, profiles: DataFrame, assessed: DataFrame) -> DataFrame:
    """Write-back: scores and risk as columns of the basket table (null where a basket has none)."""
    p = profiles.select("basket_id", F.col("avg_efficacy_score").alias("efficacy_score"), F.col("avg_days_to_effect").alias("efficacy_days"))
    return baskets.join(p, "basket_id", "left").join(assessed.select("basket_id", "risk_score", "risk_level"), "basket_id", "left")
