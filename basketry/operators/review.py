"""Human review of uncertain results: append-only tables ``review_queue`` and ``annotations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .rows import first_per_key


def review_candidates(evaluated: DataFrame, case_id: str, text: str, submitted_at) -> DataFrame:
    """Queue rows for the evaluated texts that need review, with the reason."""
    reason = F.when(F.col("needs_human_review") & F.col("grade_needs_review"), "sentiment and grade").when(
        F.col("needs_human_review"), "sentiment").otherwise("grade")
    return evaluated.filter(F.col("needs_human_review") | F.col("grade_needs_review")).select(
        F.col(case_id).alias("case_id"), F.col(text).alias("text"), F.col("grade").alias("auto_grade"), F.col("score").alias("auto_score"),
        F.col("uncertainty_level").alias("uncertainty"), reason.alias("reason"), submitted_at.alias("submitted_at"))


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """Newest annotation per case (the table itself is the history)."""
    return first_per_key(annotations, ["case_id"], [F.desc("ts"), F.desc("human_score"), F.desc("human_grade")])


def pending_reviews(queue: DataFrame, annotations: DataFrame) -> DataFrame:
    """Queue rows without an annotation made at or after their submission. Only the newest one per case matters."""
    newest = annotations.groupBy("case_id").agg(F.max("ts").alias("_ts"))
    return queue.join(newest, "case_id", "left").filter(F.col("_ts").isNull() | (F.col("_ts") < F.col("submitted_at"))).drop("_ts")


def annotation_stats(queue: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: annotated cases, pending reviews, latest grades as five counts, mean latest score (0 when none)."""
    latest = latest_annotations(annotations)
    done = latest.agg(
        F.count(F.lit(1)).alias("total_annotated"), F.coalesce(F.avg("human_score"), F.lit(0.0)).alias("avg_human_score"),
        *[F.coalesce(F.sum((F.col("human_grade") == g).cast("long")), F.lit(0)).alias(f"grade_{g}") for g in range(5)])
    pending = pending_reviews(queue, annotations).agg(F.count(F.lit(1)).alias("pending_review"))
    return done.withColumn("pending_review", pending.scalar())
