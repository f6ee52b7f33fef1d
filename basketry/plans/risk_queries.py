"""Interaction-risk scoring of orders; the knowledge tables are derived from the part table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage
from ..operators import meta as M, profiles as P, risk as R
from . import bindings as Bd
from .catalog import Tables, query, with_ctes
from .evidence_queries import NMA, POOL, _arms, _studies
from .text_queries import _evaluated, GRADED

NAMES = ("nm", "SELECT p_name AS item, count(*) AS c FROM part GROUP BY p_name")
TOXIC = ("toxic", "SELECT item, CAST(c % 50 + 5 AS DOUBLE) AS ld50, CAST(30.0 + c % 20 AS DOUBLE) AS max_dose, CASE c % 4 WHEN 0 THEN 'banned' WHEN 1 THEN 'caution' ELSE '' END AS pregnancy FROM nm WHERE c % 3 = 0")
FAMILIES = ("families", "SELECT item, split_part(item, ' ', 2) AS family, CASE WHEN split_part(item, ' ', 2) < 'm' THEN 'heart+nerve' ELSE 'liver+gut' END AS toxicity_type, "
                        "CASE WHEN split_part(item, ' ', 2) < 'h' THEN 'high' ELSE 'medium' END AS base_risk FROM nm WHERE c % 2 = 0")
REACTIONS = ("reactions", "SELECT p_name AS item, CASE p_type WHEN 'PROMO' THEN 'liver' WHEN 'SMALL' THEN 'kidney' WHEN 'LARGE' THEN 'heart' ELSE 'skin' END || ' ' || lower(p_type) AS type, "
                          "CASE WHEN count(*) % 2 = 0 THEN 'mild' ELSE 'severe' END AS severity FROM part GROUP BY p_name, p_type HAVING count(*) % 3 = 0")
PAIRS = [("adj", "SELECT least(a.p_name, b.p_name) AS herb_a, greatest(a.p_name, b.p_name) AS herb_b, count(*) AS c FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_name <> b.p_name GROUP BY 1, 2"),
         ("pairs", "SELECT herb_a, herb_b, CASE length(herb_a) % 3 WHEN 0 THEN 'extreme' WHEN 1 THEN 'high' ELSE 'medium' END AS risk_level, CASE length(herb_b) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS evidence_level, "
                   "'adjacent' AS interaction_type FROM adj WHERE c % 4 = 1")]
KNOWLEDGE = [Bd.BI, NAMES, TOXIC, FAMILIES, REACTIONS, *PAIRS,
             ("known", "SELECT herb_a AS item_a, herb_b AS item_b, risk_level, interaction_type, round(CASE risk_level WHEN 'extreme' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.45 WHEN 'low' THEN 0.2 ELSE 0.3 END * "
                       "CASE evidence_level WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 WHEN 'C' THEN 0.5 ELSE 0.3 END * 100, 2)::DOUBLE AS risk_score FROM pairs")]
COLS = "basket_id, item_a, item_b, risk_level, interaction_type, risk_score, inferred, priority"
DETECTED = [
    *KNOWLEDGE,
    ("bp", "SELECT a.basket_id, a.item AS item_a, b.item AS item_b FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item"),
    ("r_known", "SELECT basket_id, bp.item_a, bp.item_b, risk_level, interaction_type, CAST(risk_score AS DOUBLE) AS risk_score, false AS inferred, 1 AS priority FROM bp JOIN known ON known.item_a = bp.item_a AND known.item_b = bp.item_b"),
    ("r_toxic0", "SELECT basket_id, item_a, item_b, 0.2 + 0.6 * greatest(least(1.0, 10.0 / x.ld50), least(1.0, 10.0 / y.ld50)) AS risk FROM bp JOIN toxic x ON x.item = item_a JOIN toxic y ON y.item = item_b"),
    ("r_toxic", "SELECT basket_id, item_a, item_b, CASE WHEN risk > 0.5 THEN 'high' ELSE 'medium' END AS risk_level, 'toxic overlap' AS interaction_type, round(risk * 100, 2) AS risk_score, false AS inferred, 2 AS priority FROM r_toxic0"),
    ("unk", "SELECT bp.* FROM bp LEFT JOIN known ON known.item_a = bp.item_a AND known.item_b = bp.item_b WHERE known.item_a IS NULL"),
    ("fam", "SELECT unk.*, x.family AS fa, y.family AS fb, x.base_risk AS br FROM unk JOIN families x ON x.item = item_a JOIN families y ON y.item = item_b"),
    ("r_same", "SELECT basket_id, item_a, item_b, CASE WHEN br = 'high' THEN 'high' ELSE 'medium' END AS risk_level, 'inferred family toxicity' AS interaction_type, CASE WHEN br = 'high' THEN CAST(55.0 AS DOUBLE) ELSE 43.0 END AS risk_score, true AS inferred, 3 AS priority FROM fam WHERE fa = fb"),
    ("ana", "SELECT DISTINCT x.family AS f1, y.family AS f2 FROM pairs JOIN families x ON x.item = herb_a JOIN families y ON y.item = herb_b"),
    ("r_ana", "SELECT basket_id, item_a, item_b, 'low' AS risk_level, 'inferred analogy' AS interaction_type, CAST(20.0 AS DOUBLE) AS risk_score, true AS inferred, 4 AS priority FROM fam JOIN ana ON f1 = fa AND f2 = fb"),
    ("org", "SELECT DISTINCT x.item AS oa, y.item AS ob FROM reactions x JOIN reactions y ON x.type = y.type AND x.item < y.item WHERE x.type LIKE '%liver%' OR x.type LIKE '%kidney%'"),
    ("r_org", "SELECT basket_id, item_a, item_b, 'medium' AS risk_level, 'inferred shared organ' AS interaction_type, CAST(35.0 AS DOUBLE) AS risk_score, true AS inferred, 5 AS priority FROM unk JOIN org ON oa = item_a AND ob = item_b"),
    ("every", " UNION ALL ".join(f"SELECT {COLS} FROM {x}" for x in ("r_known", "r_toxic", "r_same", "r_ana", "r_org"))),
    ("found", "SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY basket_id, item_a, item_b ORDER BY priority) = 1"),
]
DOSES = ("doses", "SELECT l_orderkey AS basket_id, p_name AS item, sum(l_quantity) AS dose FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
OVER = ("over", "SELECT basket_id, doses.item, dose, max_dose, (dose / max_dose - 1) * 100 AS percent_over FROM doses JOIN toxic ON toxic.item = doses.item WHERE dose > max_dose")
ASSESSED = [
    *DETECTED, DOSES, OVER,
    ("tx", "SELECT basket_id, count(*) AS n_items, count(toxic.item) AS n_toxic FROM bi LEFT JOIN toxic ON toxic.item = bi.item GROUP BY basket_id"),
    ("fp", "SELECT basket_id, max(CASE WHEN NOT inferred THEN risk_score END) AS mx, count(*) FILTER (inferred) AS n_inferred, count(*) FILTER (NOT inferred) AS n_known, "
           "count(*) FILTER (NOT inferred AND risk_level IN ('high', 'extreme')) AS n_severe FROM found GROUP BY basket_id"),
    ("ov", "SELECT basket_id, count(*) AS n_overdose FROM over GROUP BY basket_id"),
    ("sc", "SELECT tx.basket_id, n_items, n_toxic, coalesce(n_known, 0) AS n_known, coalesce(n_severe, 0) AS n_severe, coalesce(n_inferred, 0) AS n_inferred, coalesce(n_overdose, 0) AS n_overdose, "
           "least(1.0, 0.3 * coalesce(mx, 0) / 100 + 0.3 * n_toxic / n_items + 0.12 * least(0.3, n_toxic * 0.12) + 0.13 * least(0.15, coalesce(n_inferred, 0) * 0.08) + 0.15 * (coalesce(n_overdose, 0) * 0.15)) AS score "
           "FROM tx LEFT JOIN fp ON fp.basket_id = tx.basket_id LEFT JOIN ov ON ov.basket_id = tx.basket_id"),
    ("assessed", "SELECT *, CASE WHEN score >= 0.7 THEN 'extreme' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.25 THEN 'medium' WHEN score >= 0.1 THEN 'low' ELSE 'safe' END AS risk_level FROM sc"),
]


class Knowledge:
    """The knowledge tables; each is stored because several rules read it."""

    def __init__(self, t: Tables):
        c = F.col("c")
        names = t.part.groupBy(F.col("p_name").alias("item")).agg(F.count(F.lit(1)).alias("c"))
        self.toxic = cut_lineage(names.filter(c % 3 == 0).select(
            "item", (c % 50 + 5).cast("double").alias("ld50"), (30.0 + c % 20).alias("max_dose"),
            F.when(c % 4 == 0, "banned").when(c % 4 == 1, "caution").otherwise("").alias("pregnancy")))
        family = F.split_part("item", F.lit(" "), F.lit(2))
        self.families = cut_lineage(names.filter(c % 2 == 0).select(
            "item", family.alias("family"), F.when(family < "m", "heart+nerve").otherwise("liver+gut").alias("toxicity_type"), F.when(family < "h", "high").otherwise("medium").alias("base_risk")))
        kind = F.when(F.col("p_type") == "PROMO", "liver").when(F.col("p_type") == "SMALL", "kidney").when(F.col("p_type") == "LARGE", "heart").otherwise("skin")
        self.reactions = cut_lineage(t.part.groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("c")).filter(c % 3 == 0).select(
            F.col("p_name").alias("item"), F.concat_ws(" ", kind, F.lower("p_type")).alias("type"), F.when(c % 2 == 0, "mild").otherwise("severe").alias("severity")))
        following = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
        adjacent = t.part.select("p_partkey", "p_name").join(following, "p_partkey").filter(F.col("p_name") != F.col("next"))
        adjacent = adjacent.groupBy(F.least("p_name", "next").alias("herb_a"), F.greatest("p_name", "next").alias("herb_b")).agg(F.count(F.lit(1)).alias("c"))
        la, lb = F.length("herb_a") % 3, F.length("herb_b") % 4
        self.pairs = cut_lineage(adjacent.filter(c % 4 == 1).select(
            "herb_a", "herb_b", F.when(la == 0, "extreme").when(la == 1, "high").otherwise("medium").alias("risk_level"),
            F.when(lb == 0, "A").when(lb == 1, "B").when(lb == 2, "C").otherwise("D").alias("evidence_level"), F.lit("adjacent").alias("interaction_type")))
        self.type_rules = self.toxic.sparkSession.createDataFrame(
            [("heart", "heart toxicity", "severe"), ("nerve", "nerve toxicity", "medium"), ("liver", "liver promo", "severe"), ("gut", "gut reaction", "mild")],
            "word string, type string, severity string")


def _doses(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("basket_id"), F.col("p_name").alias("item")).agg(F.sum("l_quantity").alias("dose"))


def _detect(t: Tables, k: Knowledge) -> DataFrame:
    return R.detect_risk_pairs(Bd.basket_items(t), k.toxic, k.pairs, k.families, k.reactions)


def _assess(t: Tables, k: Knowledge) -> DataFrame:
    return R.assess_risk(Bd.basket_items(t), k.toxic, k.pairs, k.families, k.reactions, _doses(t))


@query("risk_pair_scores", with_ctes(*KNOWLEDGE, body="SELECT item_a, item_b, risk_level, risk_score FROM known"))
def risk_pair_scores(t: Tables) -> DataFrame:
    return R.pair_scores(Knowledge(t).pairs).select("item_a", "item_b", "risk_level", "risk_score")


@query("known_risk_pairs", with_ctes(*DETECTED, body="SELECT basket_id, item_a, item_b, risk_level, risk_score FROM r_known"))
def known_risk_pairs(t: Tables) -> DataFrame:
    return R.known_risk_pairs(Bd.basket_items(t), Knowledge(t).pairs).select("basket_id", "item_a", "item_b", "risk_level", "risk_score")


@query("toxic_overlap_pairs", with_ctes(*DETECTED, body="SELECT basket_id, item_a, item_b, risk_level, risk_score FROM r_toxic"))
def toxic_overlap_pairs(t: Tables) -> DataFrame:
    return R.toxic_overlap_pairs(Bd.basket_items(t), Knowledge(t).toxic).select("basket_id", "item_a", "item_b", "risk_level", "risk_score")


@query("inferred_interactions", with_ctes(*DETECTED, stored=("bp", "unk", "fam", "pairs", "families", "reactions", "known"), body=" UNION ALL ".join(f"SELECT {COLS} FROM {x}" for x in ("r_same", "r_ana", "r_org"))))
def inferred_interactions(t: Tables) -> DataFrame:
    k = Knowledge(t)
    return R.infer_interactions(Bd.basket_items(t), k.pairs, k.families, k.reactions).select(*COLS.split(", "))


@query("detected_risk_pairs", with_ctes(*DETECTED, body=f"SELECT {COLS} FROM found"))
def detected_risk_pairs(t: Tables) -> DataFrame:
    return _detect(t, Knowledge(t)).select(*COLS.split(", "))


TYPE_RULES = ("rules", "SELECT * FROM (VALUES ('heart', 'heart toxicity', 'severe'), ('nerve', 'nerve toxicity', 'medium'), ('liver', 'liver promo', 'severe'), ('gut', 'gut reaction', 'mild')) v(word, type, severity)")


@query("expanded_reactions", with_ctes(*KNOWLEDGE, TYPE_RULES, body=(
    "SELECT item, type, severity, false AS inferred FROM reactions UNION ALL SELECT families.item, rules.type, rules.severity, true FROM families JOIN rules ON strpos(toxicity_type, word) > 0 "
    "WHERE NOT EXISTS (SELECT 1 FROM reactions r WHERE r.item = families.item AND r.type = rules.type)")))
def expanded_reactions(t: Tables) -> DataFrame:
    k = Knowledge(t)
    items = t.part.select(F.col("p_name").alias("item")).distinct()
    return R.expand_profiles(items, k.toxic, k.families, k.reactions, k.type_rules)[1]


@query("expanded_profiles", with_ctes(*KNOWLEDGE, TYPE_RULES, (
    "inf", "SELECT families.item, count(*) AS n FROM families JOIN rules ON strpos(toxicity_type, word) > 0 WHERE NOT EXISTS (SELECT 1 FROM reactions r WHERE r.item = families.item AND r.type = rules.type) GROUP BY 1"), body=(
    "SELECT nm.item, toxic.item IS NOT NULL AS base_known, family, CASE WHEN coalesce(pregnancy, '') <> '' THEN pregnancy WHEN family IS NOT NULL THEN 'banned' ELSE 'unknown' END AS pregnancy_risk, "
    "coalesce(n, 0) AS inferred_count, CASE WHEN toxic.item IS NOT NULL THEN CAST(0.7 AS DOUBLE) ELSE 0.4 END AS confidence FROM nm LEFT JOIN toxic ON toxic.item = nm.item LEFT JOIN families ON families.item = nm.item LEFT JOIN inf ON inf.item = nm.item")))
def expanded_profiles(t: Tables) -> DataFrame:
    k = Knowledge(t)
    items = t.part.select(F.col("p_name").alias("item")).distinct()
    return R.expand_profiles(items, k.toxic, k.families, k.reactions, k.type_rules)[0]


PREG = ("preg", "SELECT basket_id, bi.item, CASE WHEN pregnancy = 'banned' THEN 'banned' WHEN pregnancy = 'caution' THEN 'caution' WHEN family IS NOT NULL THEN 'inferred' END AS kind FROM bi "
                "LEFT JOIN toxic ON toxic.item = bi.item LEFT JOIN families ON families.item = bi.item")


@query("pregnancy_risk", with_ctes(*KNOWLEDGE, PREG, ("pc", "SELECT basket_id, count(*) FILTER (kind = 'banned') AS banned, count(*) FILTER (kind = 'caution') AS caution, count(*) FILTER (kind = 'inferred') AS inferred FROM preg GROUP BY basket_id"), body=(
    "SELECT basket_id, CASE WHEN banned > 0 THEN 'banned' WHEN inferred > 0 THEN 'avoid (inferred)' WHEN caution > 0 THEN 'caution' ELSE 'safe' END AS overall_risk, banned, caution, inferred FROM pc")))
def pregnancy_risk(t: Tables) -> DataFrame:
    k = Knowledge(t)
    return R.pregnancy_risk(Bd.basket_items(t), k.toxic, k.families)


@query("overdoses", with_ctes(NAMES, TOXIC, DOSES, OVER, body="SELECT basket_id, item, dose, max_dose, round(percent_over, 4) AS percent_over FROM over"))
def overdoses(t: Tables) -> DataFrame:
    return R.overdose(_doses(t), Knowledge(t).toxic).withColumn("percent_over", F.round("percent_over", 4))


@query("risk_assessment", with_ctes(*ASSESSED, body="SELECT basket_id, n_items, n_toxic, n_known, n_severe, n_inferred, n_overdose, round(score * 100, 6) AS risk_score, risk_level FROM assessed"))
def risk_assessment(t: Tables) -> DataFrame:
    return _assess(t, Knowledge(t)).withColumn("risk_score", F.round("risk_score", 6))


@query("risk_level_counts", with_ctes(*ASSESSED, body="SELECT risk_level, count(*) AS count FROM assessed GROUP BY risk_level"))
def risk_level_counts(t: Tables) -> DataFrame:
    return _assess(t, Knowledge(t)).groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))


@query("risk_warnings", with_ctes(*ASSESSED, PREG, body=(
    "SELECT basket_id, 'overdose' AS kind, printf('%s: dose %.1f g is above the safe %.1f g (by %.1f%%)', item, dose, max_dose, percent_over) AS text FROM over UNION ALL "
    "SELECT basket_id, 'pair', interaction_type || ': ' || item_a || ' with ' || item_b || ' (' || risk_level || ')' FROM found WHERE NOT inferred AND risk_level IN ('high', 'extreme') UNION ALL "
    "SELECT basket_id, 'inferred', CAST(n_inferred AS VARCHAR) || ' inferred risks need verification' FROM assessed WHERE n_inferred > 0 UNION ALL "
    "SELECT basket_id, 'pregnancy', item || ': not in pregnancy (' || kind || ')' FROM preg WHERE kind IN ('banned', 'inferred')")))
def risk_warnings(t: Tables) -> DataFrame:
    k = Knowledge(t)
    bi, doses = Bd.basket_items(t), _doses(t)
    found = cut_lineage(_detect(t, k))
    assessed = R.assess_risk(bi, k.toxic, k.pairs, basket_doses=doses, risk_pairs=found)
    return R.warnings(assessed, found, R.overdose(doses, k.toxic), R.pregnancy_items(bi, k.toxic, k.families))


GUIDE = {"dose": "keep to the set dose", "start_low": "start low", "not_long": "not for long use", "monitor": "monitor organs", "pregnancy": "not in pregnancy",
         "vulnerable": "reduce for the old and the young", "stop": "stop on numbness or nausea", "inferred": "confirm inferred risks"}


@query("risk_guidance", with_ctes(*ASSESSED, PREG, ("pn", "SELECT basket_id, count(kind) AS n FROM preg GROUP BY basket_id"), body=(
    "SELECT a.basket_id, concat_ws('; ', CASE WHEN score > 0.1 THEN 'keep to the set dose' END, CASE WHEN score > 0.1 THEN 'start low' END, CASE WHEN n_toxic > 0 THEN 'not for long use' END, "
    "CASE WHEN n_toxic > 0 THEN 'monitor organs' END, CASE WHEN n > 0 THEN 'not in pregnancy' END, CASE WHEN n_items >= 10 THEN 'reduce for the old and the young' END, "
    "CASE WHEN score >= 0.5 THEN 'stop on numbness or nausea' END, CASE WHEN n_inferred > 0 THEN 'confirm inferred risks' END) AS guidance FROM assessed a JOIN pn ON pn.basket_id = a.basket_id")))
def risk_guidance(t: Tables) -> DataFrame:
    k = Knowledge(t)
    out = R.guidance(_assess(t, k), R.pregnancy_risk(Bd.basket_items(t), k.toxic, k.families), GUIDE)
    return out.withColumn("guidance", F.array_join("guidance", "; "))


@query("risk_pair_details", with_ctes(*DETECTED, body=(
    "SELECT basket_id, item_a, item_b, r.risk_level, r.risk_score, evidence_level, split_part(herb_a, ' ', 1) || ' on ' || split_part(herb_b, ' ', 2) AS mechanism, 'ref ' || length(herb_a) || ', ref ' || length(herb_b) AS refs "
    "FROM r_known r JOIN pairs ON herb_a = item_a AND herb_b = item_b")))
def risk_pair_details(t: Tables) -> DataFrame:
    pairs = Knowledge(t).pairs.withColumns({
        "mechanism": F.concat(F.split_part("herb_a", F.lit(" "), F.lit(1)), F.lit(" on "), F.split_part("herb_b", F.lit(" "), F.lit(2))),
        "references": F.array(*[F.concat(F.lit("ref "), F.length(c).cast("string")) for c in ("herb_a", "herb_b")])})
    found = R.with_pair_details(R.known_risk_pairs(Bd.basket_items(t), pairs), pairs)
    return found.select("basket_id", "item_a", "item_b", "risk_level", "risk_score", "evidence_level", "mechanism", F.array_join("references", ", ").alias("refs"))


@query("basket_item_reactions", with_ctes(*KNOWLEDGE, body=(
    "SELECT basket_id, reactions.item, type, severity, array_to_string(string_split(type, ' '), ', ') AS symptoms, length(type) % 10 / 10.0::DOUBLE AS frequency, length(reactions.item)::DOUBLE AS onset_hours FROM bi JOIN reactions ON reactions.item = bi.item")))
def basket_item_reactions(t: Tables) -> DataFrame:
    known = Knowledge(t).reactions.withColumns({"symptoms": F.split("type", " "), "frequency": F.length("type") % 10 / F.lit(10.0), "onset_hours": F.length("item").cast("double")})
    return R.item_reactions(Bd.basket_items(t), known).withColumn("symptoms", F.array_join("symptoms", ", "))


@query("basket_reactions", with_ctes(*KNOWLEDGE, body="SELECT basket_id, type, severity, count(*) AS count FROM bi JOIN reactions ON reactions.item = bi.item GROUP BY 1, 2, 3"))
def basket_reactions(t: Tables) -> DataFrame:
    return R.profile_reactions(Bd.basket_items(t), Knowledge(t).reactions)


RISK_EDGES = ("redges", "SELECT item_a AS herb_a, item_b AS herb_b, risk_level, risk_score, interaction_type FROM found QUALIFY row_number() OVER (PARTITION BY item_a, item_b ORDER BY risk_score DESC, risk_level, interaction_type) = 1")
LEVELS = "CASE risk_level WHEN 'minimal' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'extreme' THEN 5 ELSE 0 END"


@query("risk_edges", with_ctes(*DETECTED, RISK_EDGES, body="SELECT * FROM redges"))
def risk_edges(t: Tables) -> DataFrame:
    return R.risk_edges(_detect(t, Knowledge(t)))


@query("risk_pair_listing", with_ctes(*DETECTED, RISK_EDGES, body=(
    f"SELECT herb_a, herb_b, risk_level, risk_score, interaction_type, (SELECT count(*) FROM redges WHERE {LEVELS} >= 4) AS total FROM redges WHERE {LEVELS} >= 4 ORDER BY risk_score DESC, herb_a, herb_b LIMIT 40")))
def risk_pair_listing(t: Tables) -> DataFrame:
    return R.list_risk_pairs(R.risk_edges(_detect(t, Knowledge(t))), "high", 40)


@query("risk_interaction_types", with_ctes(*DETECTED, RISK_EDGES, body="SELECT DISTINCT interaction_type FROM redges"))
def risk_interaction_types(t: Tables) -> DataFrame:
    return R.interaction_types(R.risk_edges(_detect(t, Knowledge(t))))


@query("risk_overlay", with_ctes(*DETECTED, RISK_EDGES, body=(
    "SELECT 'item_' || herb_a AS source, 'item_' || herb_b AS target, risk_score AS weight FROM redges WHERE split_part(herb_a, ' ', 1) <> 'red' AND split_part(herb_b, ' ', 1) <> 'red'")))
def risk_overlay(t: Tables) -> DataFrame:
    from ..operators import graph as G

    shown = G.nodes_of(Bd.items(t).filter("category <> 'red'"), "item")
    nothing = G.co_occurrence_edges(Bd.co_occurrence(t)).limit(0)
    return G.risk_overlay(shown, nothing, R.risk_edges(_detect(t, Knowledge(t)))).select("source", "target", "weight")


CASE_PROFILE = ("prof", "SELECT doc_id % 500 AS basket_id, avg(grade * 25 + (gs + 1) * 12.5) AS m, coalesce(avg(CASE WHEN gd <> 0 THEN gd END), 0) AS d FROM g2 GROUP BY 1")


def _case_profiles(t: Tables) -> DataFrame:
    cases = _evaluated(t).select((F.col("doc_id") % 500).alias("basket_id"), F.col("grade").alias("efficacy_grade"), "sentiment_score", "days_to_effect")
    return P.efficacy_profile(cases, ["basket_id"])


@query("enriched_baskets", with_ctes(*ASSESSED, *[(n + "_g" if n == "ana" else n, s.replace("FROM ana", "FROM ana_g")) for n, s in GRADED], CASE_PROFILE, body=(
    "SELECT o_orderkey AS basket_id, round(m, 8) AS efficacy_score, round(d, 4) AS efficacy_days, round(score * 100, 6) AS risk_score, risk_level FROM orders "
    "LEFT JOIN prof ON prof.basket_id = o_orderkey LEFT JOIN assessed ON assessed.basket_id = o_orderkey")))
def enriched_baskets(t: Tables) -> DataFrame:
    """Documents are cases of orders (500 order ids share them), written back with the risk assessment."""
    out = R.enrich_baskets(Bd.baskets(t).select("basket_id"), _case_profiles(t), _assess(t, Knowledge(t)))
    return out.select("basket_id", F.round("efficacy_score", 8).alias("efficacy_score"), F.round("efficacy_days", 4).alias("efficacy_days"),
                      F.round("risk_score", 6).alias("risk_score"), "risk_level")


@query("value_ranking", with_ctes(*ASSESSED, *[(n + "_g" if n == "ana" else n, s.replace("FROM ana", "FROM ana_g")) for n, s in GRADED], CASE_PROFILE, body=(
    "SELECT prof.basket_id, round(m - coalesce(score, 0) * 100 / 5, 6) AS value FROM prof LEFT JOIN assessed ON assessed.basket_id = prof.basket_id ORDER BY m - coalesce(score, 0) * 100 / 5 DESC, prof.basket_id LIMIT 8")))
def value_ranking(t: Tables) -> DataFrame:
    out = P.value_ranking(_case_profiles(t), _assess(t, Knowledge(t)), "basket_id", 8)
    return out.select("basket_id", F.round("value", 6).alias("value"))


VALUED = [*ASSESSED, *[(n + "_g" if n == "ana" else n, s.replace("FROM ana", "FROM ana_g")) for n, s in GRADED], CASE_PROFILE]
#: The trials' parts, under other names where the risk parts have the same.
TRIALS = [tuple(re.sub(r"\b(sides|sc)\b", r"trial_\1", x) for x in part) for part in dict([*POOL, *NMA]).items()]
SUMMARY = [
    *dict(VALUED).items(), *TRIALS,
    ("placed", "SELECT o_orderkey AS basket_id, r_name AS indication FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    ("best", "SELECT indication, prof.basket_id, m - coalesce(score, 0) * 100 / 5 AS value FROM prof JOIN placed ON placed.basket_id = prof.basket_id LEFT JOIN assessed ON assessed.basket_id = prof.basket_id "
             "QUALIFY row_number() OVER (PARTITION BY indication ORDER BY value DESC, prof.basket_id) <= 8"),
    ("tops", "SELECT indication, string_agg(CAST(basket_id AS VARCHAR), ',' ORDER BY value DESC, basket_id) AS top_baskets, round(max(value), 6) AS top_value FROM best GROUP BY indication"),
    ("nets", "SELECT indication, string_agg(treatment, ',' ORDER BY rank) AS treatments FROM rk GROUP BY indication"),
    ("runs", "SELECT indication, count(DISTINCT trial_id) AS trials, min(year) AS first_year, max(year) AS last_year, CAST(sum(sample_size) AS BIGINT) AS total_patients FROM arms GROUP BY indication"),
]


@query("indication_summary", with_ctes(*SUMMARY, body=(
    "SELECT runs.*, round(es, 6) AS pooled_effect_size, k AS trials_included, coalesce(treatments, '') AS treatments, coalesce(top_baskets, '') AS top_baskets, top_value "
    "FROM runs LEFT JOIN pooled ON pooled.indication = runs.indication LEFT JOIN nets ON nets.indication = runs.indication LEFT JOIN tops ON tops.indication = runs.indication")))
def indication_summary(t: Tables) -> DataFrame:
    """An order belongs to the region of its customer."""
    arms = cut_lineage(_arms(t))
    placed = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(
        t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("o_orderkey").alias("basket_id"), F.col("r_name").alias("indication"))
    out = P.indication_summary(arms.select("trial_id", "indication", "year").distinct(), arms, M.meta_analysis(_studies(t), ["indication"]), M.treatment_ranking(arms),
                               _case_profiles(t), _assess(t, Knowledge(t)), placed, "basket_id", 8)
    top = F.col("top_by_value")
    return out.select(
        "indication", "trials", "first_year", "last_year", "total_patients", F.round("meta.pooled_effect_size", 6).alias("pooled_effect_size"), "meta.trials_included",
        F.array_join(F.transform("network", lambda x: x["treatment"]), ",").alias("treatments"),
        F.array_join(F.transform(top, lambda x: x["basket_id"].cast("string")), ",").alias("top_baskets"), F.round(F.try_element_at(top, F.lit(1))["value"], 6).alias("top_value"))


@query("score_lookup", with_ctes(*VALUED, body=(
    "SELECT o_orderkey AS basket_id, round(m, 6) AS avg_efficacy_score, m IS NOT NULL AS known FROM orders LEFT JOIN prof ON prof.basket_id = o_orderkey")))
def score_lookup(t: Tables) -> DataFrame:
    """The stored profile of every order asked for, null where there is none."""
    asked = t.orders.select(F.col("o_orderkey").alias("basket_id"))
    found = P.score_lookup(asked, cut_lineage(_case_profiles(t)), "basket_id")
    return found.select("basket_id", F.round("avg_efficacy_score", 6).alias("avg_efficacy_score"), F.col("avg_efficacy_score").isNotNull().alias("known"))
