"""Efficacy profiles of scored cases, rankings and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .rows import top_k_per_group


def efficacy_profile(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: mean score ``grade * 25 + (sentiment + 1) * 12.5``, its 95% interval within 0..100, cases, grade
    counts as a map, and the mean of the non-zero days to effect (0 when there is none).

    Sums only, combined map-side; the five grade counts are conditional sums, so the map needs no collection.
    """
    score = F.col("efficacy_grade") * 25 + (F.col("sentiment_score") + 1) * 12.5
    days = F.when(F.col("days_to_effect") != 0, F.col("days_to_effect"))
    agg = cases.withColumn("_s", score).groupBy(*keys).agg(
        F.avg("_s").alias("_m"), F.var_samp("_s").alias("_v"), F.count(F.lit(1)).alias("total_cases"), F.avg(days).alias("_d"),
        *[F.sum((F.col("efficacy_grade") == g).cast("long")).alias(f"_g{g}") for g in range(5)])
    se = F.when(F.col("total_cases") > 1, F.sqrt(F.coalesce("_v", F.lit(0.0)) / F.col("total_cases"))).otherwise(0.0)
    grades = F.map_filter(F.create_map(*[x for g in range(5) for x in (F.lit(g), F.col(f"_g{g}"))]), lambda _, n: n > 0)
    return agg.select(
        *keys, F.col("_m").alias("avg_efficacy_score"), grades.alias("grade_distribution"), "total_cases",
        F.coalesce("_d", F.lit(0.0)).alias("avg_days_to_effect"),
        F.greatest(F.lit(0.0), F.col("_m") - 1.96 * se).alias("ci_low"), F.least(F.lit(100.0), F.col("_m") + 1.96 * se).alias("ci_high"))


def grade_histogram(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cases.groupBy(*keys, "efficacy_grade").agg(F.count(F.lit(1)).alias("count"))


def rank_profiles(profiles: DataFrame, key: str, min_total_cases: int = 1, skip: int = 0, limit: int = 20) -> DataFrame:
    """Profiles with enough cases, best score first, one page, with the size of the whole ranking."""
    kept = profiles.filter(F.col("total_cases") >= min_total_cases)
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.orderBy(F.desc("avg_efficacy_score"), F.asc(key)).offset(skip).limit(limit).withColumn("total", total)


def values(profiles: DataFrame, assessed: DataFrame, key: str) -> DataFrame:
    """Profiles with their risk and ``value`` = mean score - risk score / 5 (no risk known: 0)."""
    j = profiles.join(assessed.select(key, "risk_score", "risk_level"), key, "left").na.fill({"risk_score": 0.0})
    return j.withColumn("value", F.col("avg_efficacy_score") - F.col("risk_score") / 5)


def value_ranking(profiles: DataFrame, assessed: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """Best by value."""
    return values(profiles, assessed, key).orderBy(F.desc("value"), F.asc(key)).limit(limit)


def trials_summary(trials: DataFrame, arms: DataFrame) -> DataFrame:
    """Per indication: trials, first and last year, patients."""
    n = arms.groupBy("trial_id").agg(F.sum("sample_size").alias("_n"))
    return trials.join(n, "trial_id", "left").groupBy("indication").agg(
        F.count(F.lit(1)).alias("trials"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("_n").alias("total_patients"))


def indication_summary(trials: DataFrame, arms: DataFrame, pooled: DataFrame, ranking: DataFrame, profiles: DataFrame, assessed: DataFrame,
                       labels: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """Everything known of an indication in one row: its trials (``trials_summary``), the pooled comparison, the treatments of the network in
    the order of their rank, and its ``limit`` best profiles by value (of those ``labels(key, indication)`` puts there).

    ``pooled`` and ``ranking`` are ``meta_analysis`` per indication and ``treatment_ranking``. An indication is listed when it has a trial; what
    is not known of it is null, its lists are then empty. Only the best profiles of an indication are collected, never its whole group.
    """
    best = top_k_per_group(values(profiles, assessed, key).join(labels.select(key, "indication").distinct(), key), ["indication"], [F.desc("value"), F.asc(key)], limit)
    fields = ("rank", key, "value", "avg_efficacy_score", "avg_days_to_effect", "risk_score", "risk_level")
    top = best.groupBy("indication").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("top_by_value"))
    treatments = ranking.groupBy("indication").agg(F.sort_array(F.collect_list(F.struct("rank", "treatment", "net_score"))).alias("network"))
    meta = pooled.select("indication", F.struct(*[c for c in pooled.columns if c != "indication"]).alias("meta"))
    out = trials_summary(trials, arms).join(meta, "indication", "left").join(treatments, "indication", "left").join(top, "indication", "left")
    return out.withColumns({"network": F.coalesce("network", F.array()), "top_by_value": F.coalesce("top_by_value", F.array())})


def item_profile(items: DataFrame, toxic: DataFrame, dose_fit: DataFrame) -> DataFrame:
    """Item attributes with toxicity and dose-response summary (null where unknown)."""
    t = toxic.withColumn("is_toxic", F.lit(True))
    return items.join(t, "item", "left").join(dose_fit, "item", "left").withColumn("is_toxic", F.coalesce("is_toxic", F.lit(False)))


def evidence_lookup(names: DataFrame, evidence: DataFrame) -> DataFrame:
    """Which of the asked names have evidence, and for which labels, in order: ``evidence(name, label)``."""
    found = names.select("name").distinct().join(evidence.select("name", "label").distinct(), "name", "left")
    return found.groupBy("name").agg(F.count("label").alias("n_labels"), F.min("label").alias("first_label"), F.sort_array(F.collect_set("label")).alias("labels")).withColumn(
        "has_evidence", F.col("n_labels") > 0)


def score_lookup(names: DataFrame, profiles: DataFrame, key: str = "name") -> DataFrame:
    """Stored profile of each asked name (null when there is none)."""
    return names.select(key).distinct().join(profiles, key, "left")
