"""Life of text-mining tasks as keyed state: submitted, being answered, completed or failed, then forgotten.

A task is submitted with a list of texts, each text is answered by a row of its own (many at once, in any order, in any micro-batch), and the
state of a task is what has come so far:

* ``pending``: submitted, nothing answered; ``processing``: something answered; ``completed``: all its texts answered; ``failed``: an error came, or its
  type is unknown. Completed and failed tasks never change again.
* A result of an id is there until ``max_age`` after the task ended; a timer then deletes it and the id is answered with ``expired`` as long as the
  time to live of its marker, so that a repeated submission in that time does not start the task anew. Nothing is kept for ever.

All of it is replay-safe: state and timers are in the state store's checkpoint, repeated rows change nothing, and the order of
rows does not matter. The store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``). Times are processing
times, as no late row may be dropped. A query with the available-now trigger ends only without batches that have no data
(``spark.sql.streaming.noDataMicroBatches.enabled``), as timers of processing time ask for ever more of them; :func:`settings` says both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import text as X
from .jobs import REACTION_TASKS, SENTIMENT_TASKS, scored_texts, with_status

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "task_id string, kind string, task_type string, n_texts int, text_index int, result string, error string, ts timestamp"
CHANGES = "task_id string, status string, n_texts int, n_results int, error string, result string"
PENDING, PROCESSING, COMPLETED, FAILED, EXPIRED = "pending", "processing", "completed", "failed", "expired"


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """What a query of task states needs while it is started and run with the available-now trigger."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def submissions(tasks: DataFrame) -> DataFrame:
    """Events of ``tasks(task_id, task_type, texts, ts)``: one ``submit`` row each; an unknown type carries its error."""
    rows = with_status(tasks)
    return rows.select("task_id", F.lit("submit").alias("kind"), "task_type", F.coalesce(F.size("texts"), F.lit(0)).alias("n_texts"), F.lit(None).cast("int").alias("text_index"),
                       F.lit(None).cast("string").alias("result"), "error", "ts")


def answers(tasks: DataFrame, lexicon: X.Lexicon, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Events of ``tasks(task_id, task_type, texts, ts)``: one ``result`` row per text of a known type, its result as JSON."""
    known = tasks.filter(F.col("task_type").isin(*REACTION_TASKS, *SENTIMENT_TASKS))
    rows = known.select("task_id", "task_type", "ts", F.posexplode("texts").alias("text_index", "text"))
    out = scored_texts(rows, lexicon, patterns)
    result = F.to_json(F.struct("reactions", "sentiment_score", "match_count", "overall_confidence", "needs_human_review"))
    return out.select("task_id", F.lit("result").alias("kind"), "task_type", F.lit(None).cast("int").alias("n_texts"), "text_index", result.alias("result"), F.lit(None).cast("string").alias("error"), "ts")


def lifecycle(max_age_ms: int, marker_ms: int) -> StatefulProcessor:
    """The processor; made here, so that it is sent to the workers by value."""

    class TaskLifecycle(StatefulProcessor):
        """Keeps the state of one task per key; emits a row whenever its status or a number of texts or results changes."""

        def __init__(self, max_age_ms: int, marker_ms: int):
            self.max_age_ms, self.marker_ms = max_age_ms, marker_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.task = handle.getValueState("task", "status string, task_type string, n_texts int, n_results int, error string, submitted_at timestamp, ended_ms bigint")
            self.results = handle.getMapState("results", "text_index int", "result string")
            self.marker = handle.getValueState("marker", "expired_ms bigint", self.marker_ms)

        def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
            if self.marker.exists():
                for _ in rows:
                    pass
                yield Row(task_id=key[0], status=EXPIRED, n_texts=None, n_results=None, error=None, result=None)
                return
            old = self.task.get() if self.task.exists() else None
            status, kind, n_texts, n_results, error, at, ended = old or (None, None, None, 0, None, None, None)
            before, fresh = (status, n_texts, n_results), []
            for r in rows:
                if status in (COMPLETED, FAILED):
                    continue
                kind = r.task_type if kind is None else kind
                if r.kind == "submit" and n_texts is None:
                    n_texts, at = r.n_texts, r.ts
                if r.kind == "result" and not self.results.containsKey((r.text_index,)):
                    self.results.updateValue((r.text_index,), (r.result,))
                    fresh.append(r.result)
                    n_results += 1
                if r.error is not None:
                    status, error = FAILED, r.error
                elif n_texts is not None and n_results >= n_texts:
                    status = COMPLETED
                else:
                    status = PROCESSING if n_results else PENDING
            if (status, n_texts, n_results) != before:
                if status in (COMPLETED, FAILED) and ended is None:
                    ended = timerValues.getCurrentProcessingTimeInMs()
                    self.handle.registerTimer(ended + self.max_age_ms)
                self.task.update((status, kind, n_texts, n_results, error, at, ended))
                yield Row(task_id=key[0], status=status, n_texts=n_texts, n_results=n_results, error=error, result=fresh[-1] if fresh else None)

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
            self.task.clear()
            self.results.clear()
            self.marker.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield Row(task_id=key[0], status=EXPIRED, n_texts=None, n_results=None, error=None, result=None)

        def close(self) -> None:
            pass

    return TaskLifecycle(max_age_ms, marker_ms)


def task_states(events: DataFrame, max_age_seconds: float = 3600, marker_seconds: float = 7 * 24 * 3600) -> DataFrame:
    """Changes of the tasks' states (update mode) from a stream of ``EVENTS`` rows; rows without an id are left out."""
    processor = lifecycle(int(max_age_seconds * 1000), int(marker_seconds * 1000))
    return events.filter("task_id is not null").groupBy("task_id").transformWithState(statefulProcessor=processor, outputStructType=CHANGES, outputMode="Update", timeMode="ProcessingTime")


def _state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)


def current_tasks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``task_id, status, task_type, n_texts, n_results, error, submitted_at, ended_ms`` of every task the state holds, read from the checkpoint."""
    return _state(spark, checkpoint, "task").load().select(F.col("key.task_id").alias("task_id"), "value.*")


def task_results(spark: SparkSession, checkpoint: str, task_ids: DataFrame | None = None) -> DataFrame:
    """``task_id, text_index, result`` of all tasks in the state, or of those of ``task_ids(task_id)``."""
    rows = _state(spark, checkpoint, "results").option("flattenCollectionTypes", "true").load().select(
        F.col("key.task_id").alias("task_id"), F.col("user_map_key.text_index").alias("text_index"), F.col("user_map_value.result").alias("result"))
    return rows if task_ids is None else rows.join(task_ids.select("task_id").distinct(), "task_id", "left_semi")


def status_counts(tasks: DataFrame) -> DataFrame:
    """Tasks per status, with a row for a status that none has."""
    names = tasks.sparkSession.createDataFrame([(s,) for s in (PENDING, PROCESSING, COMPLETED, FAILED)], "status string")
    return names.join(tasks.groupBy("status").agg(F.count(F.lit(1)).alias("count")), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("count"))
