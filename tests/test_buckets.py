import os
import random

from pyspark.sql import functions as F

from basketry.streaming import jobs as J
from basketry.streaming.buckets import BucketedTable

SCHEMA = "k long, v string"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA + ", deleted boolean")


def test_last_rows_replay_and_compaction(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=3, max_parts=2)
    rng, want, batches, states = random.Random(4), {}, [], []
    for n in range(4):
        batch = {rng.randrange(12): (f"v{n}", rng.random() < 0.3) for _ in range(6)}
        batches.append(batch)
        for k, (v, gone) in batch.items():
            want.pop(k, None) if gone else want.__setitem__(k, v)
        states.append(dict(want))
        table.write(rows(spark, [(k, v, gone) for k, (v, gone) in batch.items()]), n)
    assert dict(map(tuple, table.read().collect())) == want and dict(map(tuple, table.read(3).collect())) == states[2]
    assert max(sum(p.bucket == b for p in table.parts()) for b in range(3)) <= 3 and any(p.base for p in table.parts())
    table.write(rows(spark, [(k, v, gone) for k, (v, gone) in batches[3].items()]), 3)  # the last batch once more
    assert dict(map(tuple, table.read().collect())) == want
    some = spark.createDataFrame([(1,), (7,), (99,)], "k long")
    assert dict(map(tuple, table.read(of=some).collect())) == {k: v for k, v in want.items() if k in (1, 7)}
    assert table.vacuum(4) > 0
    assert dict(map(tuple, table.read().collect())) == want


def test_a_bucket_emptied_by_compaction_stays_empty(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=1, max_parts=1)
    table.write(rows(spark, [(1, "a", False)]), 0)
    table.write(rows(spark, [(1, "a", True)]), 1)
    assert table.read().count() == 0 and table.read(1).count() == 1
    table.write(rows(spark, []), 2)
    assert table.read().count() == 0


def test_sums(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "a string, b string, n long, w double", ["a", "b"], ["n", "w"], buckets=2, max_parts=2)
    for n, data in enumerate([[("x", "y", 2, 1.0), ("x", "z", 1, 1.0)], [("x", "y", -1, -0.5), ("x", "z", -1, -1.0)], [("x", "y", 4, 2.0), ("x", "y", 1, 1.0)], [("q", "r", 1, 1.0)]]):
        table.write(spark.createDataFrame(data, "a string, b string, n long, w double"), n)
    assert sorted(map(tuple, table.read().collect())) == [("q", "r", 1, 1.0), ("x", "y", 6, 3.5)]


def test_bytes_follow_the_batch(spark, tmp_path):
    """A batch of three baskets on 20,000 writes a small part of the state, and leaves what a batch computation says."""
    items = F.array(*[F.concat(F.lit(f"i{k}-"), (F.xxhash64("id", F.lit(k)) % 40).cast("string")) for k in range(4)])
    first = spark.range(20000).select(F.lit("create").alias("action"), F.col("id").alias("basket_id"), items.alias("items"), F.lit(1.0).alias("frequency"), F.timestamp_seconds(F.lit(1)).alias("ts"))
    write = J.basket_change_writer(spark, str(tmp_path), buckets=16, max_parts=4)
    write(first, 0)
    small = spark.createDataFrame([("update", 5, ["p", "q"], 2.0), ("delete", 6, ["p"], 0.0), ("create", 30000, ["q", "p"], 3.0)], "action string, basket_id long, items array<string>, frequency double").withColumn("ts", F.timestamp_seconds(F.lit(2)))
    for n in (1, 1, 2):  # batch 1 is replayed, batch 2 changes nothing more
        write(small, n)
    state = size(tmp_path / "baskets/data/v0") + size(tmp_path / "pairs/data/v0")
    assert size(tmp_path / "baskets/data/v1") + size(tmp_path / "pairs/data/v1") < 0.1 * state
    baskets, pairs = J.basket_tables(spark, str(tmp_path), buckets=16, max_parts=4)
    assert baskets.read().count() == 20000
    got = {(r.item_a, r.item_b): (r["count"], r.weight) for r in pairs.read().collect()}
    assert got == {(r.item_a, r.item_b): (r["count"], r.weight) for r in J.co_occurrence_of(baskets.read()).collect()}
    assert got["p", "q"] == (2, 5.0)
