"""Structured Streaming jobs: text-mining tasks, basket changes, incremental co-occurrence and communities.

The library transforms streaming DataFrames and starts queries; sources, sinks and triggers are the caller's. A task is
answered however late it comes, so the ids of answered tasks are kept as state (a key each; use the RocksDB state store).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lineage import cut_lineage
from ..operators import communities as C, text as X
from ..operators.baskets import co_occurrence
from ..operators.rows import first_per_key
from .buckets import BucketedTable

REACTION_TASKS = ("adverse_extract", "batch_adverse")
SENTIMENT_TASKS = ("efficacy_analyze", "batch_efficacy")


def distinct_tasks(tasks: DataFrame) -> DataFrame:
    """Each task id once, however late a task comes: no watermark, as that would drop late tasks unanswered."""
    return tasks.dropDuplicates(["task_id"])


def with_status(tasks: DataFrame) -> DataFrame:
    known = F.col("task_type").isin(*REACTION_TASKS, *SENTIMENT_TASKS)
    return tasks.withColumn("status", F.when(known, "completed").otherwise("failed")).withColumn(
        "error", F.when(~known, F.concat(F.lit("unknown task type: "), F.coalesce("task_type", F.lit("")))))


def stream_text_mining(tasks: DataFrame, lexicon: X.Lexicon, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Results of ``tasks(task_id, task_type, texts, ts)``, one row per text (append mode).

    Reaction tasks get the extracted reactions, sentiment tasks the sentiment columns; an unknown type gives one row
    with status ``failed``.
    """
    rows = with_status(distinct_tasks(tasks))
    texts = F.when(F.col("status") == "completed", F.col("texts")).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("task_id", "task_type", "ts", "status", "error", F.posexplode_outer(texts).alias("text_index", "text"))
    return scored_texts(rows, lexicon, patterns)


def scored_texts(rows: DataFrame, lexicon: X.Lexicon, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``rows(task_id, task_type, ts, ..., text_index, text)`` with their reactions or sentiment, by the type of their task."""
    kept = [c for c in ("task_id", "task_type", "ts", "status", "error", "text_index") if c in rows.columns]
    out = X.analyze_texts(rows, "text", lexicon)
    reaction, sentiment = F.col("task_type").isin(*REACTION_TASKS), F.col("task_type").isin(*SENTIMENT_TASKS)
    found = F.filter(F.array(*[
        F.when(reaction & F.col("text").rlike(p), F.struct(
            F.lit(t).alias("reaction_type"), F.lit(s).alias("severity"), F.regexp_extract("text", p, 1).alias("matched_term"),
            (F.regexp_instr(F.col("text"), F.lit(p)) - 1).alias("position")))
        for p, t, s in patterns]), lambda x: x.isNotNull())
    return out.select(
        *kept, F.when(reaction, found).alias("reactions"),
        *[F.when(sentiment, F.col(c)).alias(c) for c in ("sentiment_score", "match_count", "overall_confidence", "needs_human_review")])


def stream_status(tasks: DataFrame) -> DataFrame:
    """Number of tasks per status (complete mode)."""
    return with_status(tasks).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def drop_old_results(results: DataFrame, now, max_age_seconds: int = 3600) -> DataFrame:
    """Results not older than the age (the batch form of the clean-up)."""
    age = F.unix_timestamp(now) - F.unix_timestamp("completed_at")
    return results.filter(F.col("completed_at").isNull() | (age <= max_age_seconds))


def basket_pairs(baskets: DataFrame, items: str = "items") -> DataFrame:
    """Pairs of baskets that arrive whole (``items`` array, ``frequency``): stateless, so it streams."""
    rows = baskets.select("frequency", F.sort_array(F.array_distinct(items)).alias("_i")).select(
        "frequency", "_i", F.posexplode("_i").alias("_p", "item_a"))
    return rows.select("frequency", "item_a", F.explode(F.slice("_i", F.col("_p") + 2, F.greatest(F.size("_i"), F.lit(1)))).alias("item_b"))


def stream_co_occurrence(baskets: DataFrame) -> DataFrame:
    """Running pair counts and weights (update mode); after the last batch equal to the batch operator."""
    return basket_pairs(baskets).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("count"), F.sum("frequency").alias("weight"))


class VersionedTable:
    """A parquet table rewritten as numbered versions, so that a batch replayed after a failure is harmless.

    Batch n reads the newest version below n and overwrites version n.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        done = [p for p in names if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self, before: int | None = None) -> DataFrame:
        found = [v for v in self._versions() if before is None or v < before]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{found[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")


def apply_changes(baskets: DataFrame, changes: DataFrame) -> DataFrame:
    """Baskets after a batch of ``changes(action, basket_id, items, frequency, ts)``: the last change of a basket wins.

    Create and update replace the row, delete removes it.
    """
    last = first_per_key(changes, ["basket_id"], [F.desc("ts"), F.desc("action")])
    kept = baskets.join(last.select("basket_id"), "basket_id", "left_anti")
    return kept.unionByName(last.filter(F.col("action") != "delete").select(*baskets.columns))


def pair_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What baskets that changed from ``before`` to ``after`` add to and take from the pair sums; one row per pair."""
    minus = basket_pairs(before).select("item_a", "item_b", F.lit(-1).cast("long").alias("count"), (-F.col("frequency")).alias("weight"))
    plus = basket_pairs(after).select("item_a", "item_b", F.lit(1).cast("long").alias("count"), F.col("frequency").alias("weight"))
    return minus.unionByName(plus).groupBy("item_a", "item_b").agg(F.sum("count").alias("count"), F.sum("weight").alias("weight"))


def changed_pairs(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Pair table after baskets changed from ``before`` to ``after`` (only those baskets are paired again)."""
    return pairs.unionByName(pair_changes(before, after)).groupBy("item_a", "item_b").agg(
        F.sum("count").alias("count"), F.sum("weight").alias("weight")).filter(F.col("count") > 0)


BASKET_STATE = "basket_id long, items array<string>, frequency double"
PAIR_STATE = "item_a string, item_b string, count long, weight double"


def basket_tables(spark: SparkSession, path: str, **options: int) -> tuple[BucketedTable, BucketedTable]:
    """The state that :func:`basket_change_writer` keeps: baskets by id, and the sums of their pairs."""
    return (BucketedTable(spark, f"{path}/baskets", BASKET_STATE, ["basket_id"], **options),
            BucketedTable(spark, f"{path}/pairs", PAIR_STATE, ["item_a", "item_b"], ["count", "weight"], **options))


def basket_change_writer(spark: SparkSession, path: str, **options: int) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the tables of :func:`basket_tables` current.

    A batch reads the buckets of its baskets and writes rows for these baskets and their pairs alone. ``options`` are
    ``buckets`` and ``max_parts`` of the tables.
    """
    baskets, pairs = basket_tables(spark, path, **options)

    def write(changes: DataFrame, batch_id: int) -> None:
        last = cut_lineage(first_per_key(changes, ["basket_id"], [F.desc("ts"), F.desc("action")]))
        rows = last.select("basket_id", "items", "frequency", (F.col("action") == "delete").alias("deleted"))
        before = baskets.read(batch_id, last)
        delta = cut_lineage(pair_changes(before, rows.filter(~F.col("deleted"))).filter((F.col("count") != 0) | (F.col("weight") != 0)))
        baskets.write(rows, batch_id)
        pairs.write(delta, batch_id)

    return write


EDGE_STATE = "src string, dst string, weight double"
COMMUNITY_STATE = "node string, community string"


def community_writer(spark: SparkSession, path: str, resolution: float = 1.0) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: new edge weights are added to ``<path>/edges``, ``<path>/communities`` follows.

    Nodes of the batch's edges restart on their own; all others keep their community and are refined.
    """
    edges, parts = VersionedTable(spark, f"{path}/edges", EDGE_STATE), VersionedTable(spark, f"{path}/communities", COMMUNITY_STATE)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = cut_lineage(batch.select("src", "dst", F.col("weight").cast("double").alias("weight")))
        edges.write(edges.read(batch_id).unionByName(new).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), batch_id)
        changed = new.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        parts.write(C.louvain_incremental(edges.read(batch_id + 1), parts.read(batch_id), changed, resolution), batch_id)

    return write


def co_occurrence_of(baskets: DataFrame) -> DataFrame:
    """Batch twin of :func:`stream_co_occurrence` for the same whole-basket rows."""
    long = baskets.select("basket_id", F.explode("items").alias("item"))
    return co_occurrence(long, baskets.select("basket_id", "frequency"))
