import json
import time

from pyspark.sql import functions as F

from basketry.functions import defaults as D
from basketry.streaming import tasks as T


def ran(spark, folder, **ages):
    """The stream over all event files so far, from its checkpoint: each call is a restart."""
    source = spark.readStream.schema(T.EVENTS).parquet(f"{folder}/in")
    out = []
    with T.settings(spark):
        q = T.task_states(source, **ages).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def put(spark, folder, rows):
    """Event rows: task, kind, type, texts, index, result, error."""
    spark.createDataFrame([(*r, None) for r in rows], T.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_states_over_restarts(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, [("a", "submit", "batch_adverse", 2, None, None, None), ("b", "submit", "guess", 1, None, None, "unknown task type: guess"), ("c", "result", "x", None, 0, "early", None),
                        ("e", "submit", "x", 0, None, None, None), (None, "submit", "x", 1, None, None, None)])
    first = {r.task_id: r.status for r in ran(spark, folder)}
    assert first == {"a": "pending", "b": "failed", "c": "processing", "e": "completed"}
    put(spark, folder, [("a", "result", "batch_adverse", None, 1, "r1", None), ("a", "result", "batch_adverse", None, 1, "again", None), ("d", "submit", "x", 3, None, None, None), ("b", "result", "x", None, 0, "late", None)])
    assert {r.task_id: (r.status, r.n_results) for r in ran(spark, folder)} == {"a": ("processing", 1), "d": ("pending", 0)}
    put(spark, folder, [("a", "result", "batch_adverse", None, 0, "r0", None), ("c", "submit", "x", 1, None, None, None), ("a", "submit", "other", 9, None, None, None), ("f", "result", "x", None, 2, "r2", None)])
    assert {r.task_id: (r.status, r.n_results) for r in ran(spark, folder)} == {"a": ("completed", 2), "c": ("completed", 1), "f": ("processing", 1)}
    put(spark, folder, [("f", "submit", "x", 3, None, None, None)])
    ran(spark, folder)
    state = {r.task_id: (r.status, r.n_texts, r.n_results, r.error) for r in T.current_tasks(spark, f"{folder}/cp").collect()}
    assert state == {"a": ("completed", 2, 2, None), "b": ("failed", 1, 0, "unknown task type: guess"), "c": ("completed", 1, 1, None), "d": ("pending", 3, 0, None), "e": ("completed", 0, 0, None), "f": ("processing", 3, 1, None)}
    one = T.task_results(spark, f"{folder}/cp", spark.createDataFrame([("a",)], "task_id string"))
    assert sorted(map(tuple, one.collect())) == [("a", 0, "r0"), ("a", 1, "r1")]
    assert {r.status: r["count"] for r in T.status_counts(T.current_tasks(spark, f"{folder}/cp")).collect()} == {"pending": 1, "processing": 1, "completed": 3, "failed": 1}


def test_results_age(spark, tmp_path):
    folder, ages = str(tmp_path), {"max_age_seconds": 0.2, "marker_seconds": 3600}
    put(spark, folder, [("old", "submit", "x", 0, None, None, None), ("open", "submit", "x", 1, None, None, None)])
    ran(spark, folder, **ages)
    time.sleep(1)
    put(spark, folder, [("new", "submit", "x", 2, None, None, None)])
    assert ("old", "expired") in {(r.task_id, r.status) for r in ran(spark, folder, **ages)}
    assert {r.task_id for r in T.current_tasks(spark, f"{folder}/cp").collect()} == {"open", "new"}
    put(spark, folder, [("old", "submit", "x", 0, None, None, None)])  # an id whose result is gone does not start anew
    assert {(r.task_id, r.status) for r in ran(spark, folder, **ages)} == {("old", "expired")}
    assert {r.task_id for r in T.current_tasks(spark, f"{folder}/cp").collect()} == {"open", "new"}


def test_events_of_tasks(spark):
    rows = [("1", "batch_adverse", ["恶心", "正常"]), ("2", "efficacy_analyze", ["一剂而愈"]), ("3", "guess", ["x"]), ("4", "batch_efficacy", None)]
    tasks = spark.createDataFrame(rows, "task_id string, task_type string, texts array<string>").withColumn("ts", F.lit(None).cast("timestamp"))
    sent = {r.task_id: (r.n_texts, r.error) for r in T.submissions(tasks).collect()}
    assert sent["1"] == (2, None) and sent["4"] == (0, None) and sent["3"][0] == 1 and "guess" in sent["3"][1]
    got = {(r.task_id, r.text_index): json.loads(r.result) for r in T.answers(tasks, D.CASE_LEXICON, D.REACTION_PATTERNS).collect()}
    assert set(got) == {("1", 0), ("1", 1), ("2", 0)}
    assert got["1", 0]["reactions"] and not got["1", 1].get("reactions") and got["2", 0]["sentiment_score"] > 0
    assert set(T.submissions(tasks).columns) == set(T.answers(tasks, D.CASE_LEXICON, D.REACTION_PATTERNS).columns)
