"""Streams over tables that are folders of files say what those over one file say."""

import pytest
from pyspark.sql import functions as F

from basketry.plans import stream_queries as S
from basketry.plans.catalog import Tables


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_every_file_of_a_table(spark, tmp_path, files):
    turns = [(c, t, ("user", "assistant", "system")[t], "text") for c in range(20) for t in range(3)]
    conversations = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    conversations.repartition(files, "conv_id").write.parquet(str(tmp_path / "conversations.parquet"))
    # the last change of a user comes first
    events = spark.createDataFrame([(u, ("view", "click")[k == 0], float(k), 1000 - k) for k in range(3) for u in range(10)], "user_id long, event_type string, value double, s long")
    events.select("user_id", "event_type", "value", F.timestamp_seconds("s").alias("ts")).repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    assert {r.status: r["count"] for r in S.stream_status(t).collect()} == {"completed": 40, "failed": 20}
    assert S.stream_text_mining(t).count() == 60
    assert sorted((r.basket_id, r.frequency) for r in S.stream_basket_changes(t).collect()) == [(u, 0.0) for u in range(10)]


def test_a_table_of_one_file(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "text")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("part-*")).rename(tmp_path / "conversations.parquet")
    assert [(r.status, r["count"]) for r in S.stream_status(Tables(spark, str(tmp_path))).collect()] == [("completed", 1)]
