"""Lexicon sentiment, uncertainty, grades and pattern extraction over a text column.

Everything is a Column expression on the row that holds the text: no UDF, no shuffle, the whole text is read.
Lexicons and patterns are small Python sequences that become literals of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import as_col, clamp, once, tier

HIT = "struct<keyword:string,weight:double,type:string,position:int>"
STATE = f"struct<score:double,n:int,hits:array<{HIT}>>"


@dataclass(frozen=True)
class Lexicon:
    """Keywords with weights; prefixes that intensify or negate a positive keyword; time patterns."""

    positive: dict[str, float]
    negative: dict[str, float]
    intensifiers: dict[str, float] = field(default_factory=dict)
    negations: Sequence[str] = ()
    time_patterns: Sequence[tuple[str, float]] = ()

    def ordered(self) -> list[tuple[str, float, str]]:
        """Longest keyword first; equal lengths keep list order, positives before negatives."""
        words = [(k, w, "pos") for k, w in self.positive.items()] + [(k, w, "neg") for k, w in self.negative.items()]
        return sorted(words, key=lambda x: -len(x[0]))


def _array(values: list[Column], element_type: str) -> Column:
    return F.array(*values) if values else F.array().cast(f"array<{element_type}>")


def lexicon_hits(text, lexicon: Lexicon) -> Column:
    """STRUCT ``score, n, hits``: keywords found, in lexicon order, at their first occurrence.

    A keyword whose first occurrence overlaps one already taken is skipped. The first listed intensifier that
    stands before the keyword anywhere multiplies a positive weight; a negation character right before the first
    occurrence makes it -0.8 times the weight instead.
    """
    text = F.coalesce(as_col(text), F.lit(""))
    words = _array([
        F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w"), F.lit(t).alias("t")) for k, w, t in lexicon.ordered()
    ], "struct<k:string,w:double,t:string>")
    boosts = _array([F.struct(F.lit(p).alias("p"), F.lit(float(m)).alias("m")) for p, m in lexicon.intensifiers.items()], "struct<p:string,m:double>")
    negations = _array([F.lit(n) for n in lexicon.negations], "string")
    present = F.filter(F.transform(words, lambda x: F.struct(x["k"].alias("k"), x["w"].alias("w"), x["t"].alias("t"), F.position(x["k"], text).alias("p"))), lambda x: x["p"] > 0)

    def add(acc: Column, x: Column) -> Column:
        start, end = x["p"] - 1, x["p"] - 1 + F.length(x["k"])
        overlaps = F.exists(acc["hits"], lambda h: (h["position"] < end) & (start < h["position"] + F.length(h["keyword"])))
        boost = F.try_element_at(F.filter(boosts, lambda b: F.position(F.concat(b["p"], x["k"]), text) > 0), F.lit(1))["m"]
        before = F.substring(text, start, F.lit(1))
        negated = (start > 0) & F.array_contains(negations, before)
        modifier = F.when(x["t"] != "pos", 1.0).when(negated, -0.8).otherwise(F.coalesce(boost, F.lit(1.0)))
        weight = x["w"] * modifier
        hit = F.struct(x["k"].alias("keyword"), weight.alias("weight"), x["t"].alias("type"), start.alias("position"))
        taken = F.struct((acc["score"] + weight).alias("score"), (acc["n"] + 1).alias("n"), F.concat(acc["hits"], F.array(hit)).alias("hits"))
        return F.when(overlaps, acc).otherwise(taken.cast(STATE))

    zero = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("n"), F.array().cast(f"array<{HIT}>").alias("hits")).cast(STATE)
    return F.aggregate(present, zero, add)


def sentiment_of(hits: Column) -> Column:
    """``clamp(score / n * 1.2, -1, 1)``, 0 without a hit."""
    return F.when(hits["n"] == 0, 0.0).otherwise(clamp(hits["score"] / F.greatest(hits["n"], F.lit(1)) * 1.2, -1, 1))


def lexicon_sentiment(text, lexicon: Lexicon) -> Column:
    return sentiment_of(lexicon_hits(text, lexicon))


def keyword_entropy(hits: Column) -> Column:
    """Entropy (bits) of the absolute weight between the two keyword types; 1 when there is no weight."""
    def total(kind: str) -> Column:
        return F.aggregate(F.filter(hits["hits"], lambda h: h["type"] == kind), F.lit(0.0), lambda a, h: a + F.abs(h["weight"]))

    pos, neg = total("pos"), total("neg")

    def term(part: Column) -> Column:
        share = part / (pos + neg)
        return F.when(part > 0, -share * F.log2(share)).otherwise(0.0)

    return F.when(pos + neg == 0, 1.0).otherwise(term(pos) + term(neg))


def match_confidence(n, length) -> Column:
    n, length = as_col(n), as_col(length)
    density = F.least(F.lit(1.0), n / F.greatest(length / 3.0, F.lit(1.0)))
    return F.when(n == 0, 0.0).otherwise(0.6 * (1.0 - F.exp(-n / 2.0)) + 0.4 * density)


def _weight_spread(hits: Column) -> Column:
    n = F.greatest(hits["n"], F.lit(1))
    mean = F.aggregate(hits["hits"], F.lit(0.0), lambda a, h: a + F.abs(h["weight"])) / n
    var = F.aggregate(hits["hits"], F.lit(0.0), lambda a, h: a + F.pow(F.abs(h["weight"]) - mean, F.lit(2.0))) / n
    return F.when(hits["n"] > 1, F.least(F.lit(1.0), F.sqrt(var))).otherwise(0.0)


def analyze_texts(df: DataFrame, text: str, lexicon: Lexicon, levels: tuple[str, str, str] = ("low", "medium", "high")) -> DataFrame:
    """Sentiment with uncertainty: score, hits, entropy, sparsity, weight spread, level, confidences, review flag.

    The hits are computed in a projection of their own, so the fold runs once per text.
    """
    low, medium, high = levels
    h = F.col("_h")
    base = once(df, "_h", lexicon_hits(text, lexicon)).withColumn("_len", F.length(F.coalesce(F.col(text), F.lit(""))))
    base = once(base, "_m", F.struct(
        keyword_entropy(h).alias("entropy"), match_confidence(h["n"], F.col("_len")).alias("match"), _weight_spread(h).alias("spread")))
    m = F.col("_m")
    ambiguity = 0.4 * m["entropy"] + 0.35 * (1.0 - m["match"]) + 0.25 * m["spread"]
    base = once(base, "_conf", F.when(h["n"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - ambiguity)))
    return base.withColumns({
        "sentiment_score": F.round(sentiment_of(h), 4),
        "matched_keywords": h["hits"],
        "match_count": h["n"],
        "entropy": F.round(m["entropy"], 4),
        "sparsity_penalty": F.round(1.0 - m["match"], 4),
        "weight_variance": F.round(m["spread"], 4),
        "ambiguity_level": tier("_conf", [(0.7, low), (0.45, medium)], high, strict=True),
        "match_confidence": F.round(m["match"], 4),
        "overall_confidence": F.round("_conf", 4),
        "needs_human_review": (F.col("_conf") < 0.5) | (h["n"] <= 1),
    }).drop("_h", "_len", "_m", "_conf")


def extract_days(text, time_patterns: Sequence[tuple[str, float]]) -> Column:
    """Days of the first pattern, in list order, that occurs in the text; null when none does."""
    out = F.lit(None).cast("double")
    for pattern, days in reversed(list(time_patterns)):
        out = F.when(as_col(text).rlike(pattern), F.lit(float(days))).otherwise(out)
    return out


def extract_patterns(df: DataFrame, text: str, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per text and matching pattern ``(regex with one group, type, severity)``: the first match and its
    0-based position. Texts without a match give no row."""
    found = F.filter(F.array(*[
        F.when(F.col(text).rlike(p), F.struct(
            F.lit(t).alias("reaction_type"), F.lit(s).alias("severity"), F.regexp_extract(F.col(text), p, 1).alias("matched_term"),
            (F.regexp_instr(F.col(text), F.lit(p)) - 1).alias("position")))
        for p, t, s in patterns
    ]), lambda x: x.isNotNull())
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.explode(found).alias("_x")).select(*keep, "_x.*")


def aggregate_reactions(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of extracted reactions by type and severity (and the given keys), in one pass."""
    return found.groupBy(*by, "reaction_type", "severity").agg(F.count(F.lit(1)).alias("count"))


def reaction_totals(found: DataFrame, by: Sequence[str] = (), kind: str = "reaction_type", severity: str = "severity") -> DataFrame:
    """Per key: ``total_reactions``, and ``severity_distribution`` and ``by_reaction_type`` as maps to counts.

    Counts are combined map-side per key, type and severity; the maps hold as many entries as there are types.
    """
    counted = found.groupBy(*by, F.col(kind).alias("_t"), F.col(severity).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))

    def folded(column: str) -> Column:
        names = F.array_sort(F.collect_set(column))
        rows = F.collect_list(F.struct(F.col(column).alias("k"), F.col("_c").alias("c")))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.aggregate(F.filter(rows, lambda r: r["k"] == n), F.lit(0).cast("long"), lambda a, r: a + r["c"])))

    out = counted.groupBy(*by).agg(F.sum("_c").alias("total_reactions"), folded("_s").alias("severity_distribution"), folded("_t").alias("by_reaction_type"))
    return out.select(*by, F.coalesce("total_reactions", F.lit(0)).alias("total_reactions"), "severity_distribution", "by_reaction_type")


#: Upper bounds of the grades 0..3 on the score scale -1..1.
GRADE_CUTS = (-0.3, 0.2, 0.55, 0.80)


def base_score(sentiment, days) -> Column:
    s, d = as_col(sentiment), as_col(days).cast("double")
    speed = F.greatest(F.lit(0.0), 1.0 - F.log1p(d) / 4.5)
    return F.when(d.isNull(), s * 0.75).otherwise(s * 0.65 + F.when(s > 0, 0.35).otherwise(-0.35) * speed)


def ordinal_grade(sentiment, days) -> Column:
    """STRUCT ``grade`` (0..4) and ``score`` (0..100, two digits)."""
    b = base_score(sentiment, days)
    grade = F.when(b > GRADE_CUTS[3], 4).when(b > GRADE_CUTS[2], 3).when(b > GRADE_CUTS[1], 2).when(b > GRADE_CUTS[0], 1).otherwise(0)
    return F.struct(grade.alias("grade"), F.round(F.round(clamp((b + 1.0) * 50.0, 0, 100), 9), 2).alias("score"))


def grade_texts(df: DataFrame, sentiment: str, days: str, confidence, levels: tuple[str, str, str] = ("low", "medium", "high")) -> DataFrame:
    """Grade, score, grade probabilities, best two grades, margin, uncertainty level and review flag."""
    low, medium, high = levels
    bounds = [-1.0, *GRADE_CUTS, 1.0]
    out = once(df, "_g", F.struct(ordinal_grade(sentiment, days).alias("o"), as_col(confidence).alias("conf")))
    conf = F.col("_g.conf")
    b = F.col("_g.o.score") / 100.0 * 2.0 - 1.0
    out = once(out, "_raw", F.array(*[
        F.greatest(F.lit(0.01), 1.0 - F.abs(b - (lo + hi) / 2) / (hi - lo)) * conf for lo, hi in zip(bounds, bounds[1:])]))
    total = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)
    out = once(out, "_sum", total)
    out = once(out, "_probs", F.when(F.col("_sum") > 0, F.transform("_raw", lambda x: x / F.col("_sum"))).otherwise(F.col("_raw")))
    out = once(out, "_r", F.sort_array(F.transform("_probs", lambda p, i: F.struct((-p).alias("p"), i.alias("g")))))
    out = out.withColumn("_margin", -F.col("_r")[0]["p"] + F.col("_r")[1]["p"])
    out = once(out, "_unc", 0.4 * (1.0 - F.col("_margin")) + 0.6 * (1.0 - conf))
    level = F.when(F.col("_unc") < 0.25, low).when(F.col("_unc") < 0.45, medium).otherwise(high)
    return out.withColumns({
        "grade": F.col("_g.o.grade"), "score": F.col("_g.o.score"), "base_score": F.round(b, 4),
        "grade_probabilities": F.transform("_probs", lambda p: F.round(p, 4)),
        "top2_grades": F.array(F.col("_r")[0]["g"], F.col("_r")[1]["g"]),
        "confidence_margin": F.round("_margin", 4), "uncertainty_level": level,
        "grade_needs_review": (level == high) | (conf < 0.5),
    }).drop("_g", "_raw", "_sum", "_probs", "_r", "_margin", "_unc")


def evaluate_texts(df: DataFrame, text: str, lexicon: Lexicon, days: str | None = None) -> DataFrame:
    """Full evaluation: sentiment with uncertainty, days to effect (given or extracted), grade distribution."""
    out = analyze_texts(df, text, lexicon)
    out = out.withColumn("days_to_effect", F.col(days).cast("double") if days else extract_days(text, lexicon.time_patterns))
    return grade_texts(out, "sentiment_score", "days_to_effect", "overall_confidence")


def extraction_metrics(predicted: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of predicted (key, label) rows against expected ones; a single row."""
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    n = p.join(e, list(keys), "full_outer").agg(
        F.coalesce(F.sum(F.col("_p") * F.col("_e")), F.lit(0)).alias("true_positive"),
        F.coalesce(F.sum(F.when(F.col("_e").isNull(), 1)), F.lit(0)).alias("false_positive"),
        F.coalesce(F.sum(F.when(F.col("_p").isNull(), 1)), F.lit(0)).alias("false_negative"))
    tp, fp, fn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative"))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return n.select("*", precision.alias("precision"), recall.alias("recall"),
                    F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))
