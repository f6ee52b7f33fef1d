from pyspark.sql import functions as F

from basketry.functions import defaults as D
from basketry.operators import graph as G
from basketry.streaming import jobs as J


def start(df, f, tmp_path, mode="append"):
    df.writeStream.foreachBatch(f).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()


def test_tasks_once_and_unknown_type(spark, tmp_path):
    rows = [("1", "adverse_extract", ["恶心", "正常"], 0), ("1", "adverse_extract", ["恶心"], 1), ("2", "efficacy_analyze", ["一剂而愈"], 2), ("3", "guess", ["x"], 3)]
    spark.createDataFrame(rows, "task_id string, task_type string, texts array<string>, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("task_id string, task_type string, texts array<string>, ts timestamp").parquet(str(tmp_path / "in"))
    out = J.stream_text_mining(src, D.CASE_LEXICON, D.REACTION_PATTERNS)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.task_id for r in got} == {"1", "2", "3"}
    failed = [r for r in got if r.status == "failed"]
    assert len(failed) == 1 and "guess" in failed[0].error
    assert [r.sentiment_score > 0 for r in got if r.task_id == "2"] == [True]


def test_changes_over_batches_equal_the_batch_result(spark, tmp_path):
    schema = "action string, basket_id long, items array<string>, frequency double, ts timestamp"
    batches = [
        [("create", 1, ["a", "b", "c"], 2.0, 1), ("create", 2, ["a", "b"], 1.0, 2)],
        [("update", 1, ["a", "c"], 3.0, 3), ("delete", 2, ["a"], 0.0, 4), ("create", 3, ["b", "c"], 5.0, 5)],
        [("update", 3, ["c", "a"], 1.0, 6)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "action string, basket_id long, items array<string>, frequency double, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    writer = J.basket_change_writer(spark, str(tmp_path / "tables"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start(src, writer, tmp_path)
    baskets, pairs = J.basket_tables(spark, str(tmp_path / "tables"))
    state = {r.basket_id: (sorted(r["items"]), r.frequency) for r in baskets.read().collect()}
    assert state == {1: (["a", "c"], 3.0), 3: (["a", "c"], 1.0)}
    got = {(r.item_a, r.item_b): (r["count"], r.weight) for r in pairs.read().collect()}
    want = {(r.item_a, r.item_b): (r["count"], r.weight) for r in J.co_occurrence_of(baskets.read()).collect()}
    assert got == want == {("a", "c"): (2, 4.0)}
    writer(spark.createDataFrame([], schema), 2)  # replay of the last batch starts from version 1
    assert pairs.read().count() == pairs.read(2).count() == 2


def test_incremental_communities(spark, tmp_path):
    first = [("a1", "a2", 5.0), ("a2", "a3", 5.0), ("a1", "a3", 5.0)]
    second = [("b1", "b2", 5.0), ("b2", "b3", 5.0), ("b1", "b3", 5.0), ("a1", "b1", 0.5)]
    w = J.community_writer(spark, str(tmp_path))
    for i, rows in enumerate((first, second)):
        w(spark.createDataFrame(rows, "src string, dst string, weight double"), i)
    parts = J.VersionedTable(spark, str(tmp_path / "communities"), J.COMMUNITY_STATE).read()
    assert {r.node: r.community for r in parts.collect()} == {n: n[0] + "1" for n in ("a1", "a2", "a3", "b1", "b2", "b3")}
    edges = J.VersionedTable(spark, str(tmp_path / "edges"), J.EDGE_STATE).read()
    assert G.modularity(edges, parts).first()[0] > 0.4


def test_late_tasks_are_answered(spark, tmp_path):
    for name, at in (("a", 100_000), ("b", 200_000), ("late", 5)):
        spark.createDataFrame([(name, "efficacy_analyze", ["一剂而愈"], at)], "task_id string, task_type string, texts array<string>, s long").withColumn(
            "ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("task_id string, task_type string, texts array<string>, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = J.stream_text_mining(src, D.CASE_LEXICON, D.REACTION_PATTERNS)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r.task_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b", "late"}
