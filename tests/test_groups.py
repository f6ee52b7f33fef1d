"""Pairs, ranks and lineage helpers, with the hot-group branches forced by small limits."""

from itertools import combinations
import random

from pyspark.sql import functions as F

from basketry.functions.groups import pairs_in_groups
from basketry.functions.ranks import global_rank, ranked, upper_median


def _brute(rows):
    groups = {}
    for g, i in rows:
        groups.setdefault(g, set()).add(i)
    return sorted((g, a, b, len(s)) for g, s in groups.items() for a, b in combinations(sorted(s), 2))


def test_pairs_with_a_hot_group_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot", f"i{k:03d}") for k in range(57)] + [("hot", "i001")] * 40
    rows += [(f"g{rng.randrange(20)}", f"i{rng.randrange(30):03d}") for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, i string")
    for limit in (2048, 10, 3):
        got = sorted(tuple(r) for r in pairs_in_groups(df, "g", "i", limit).select("g", "item_a", "item_b", "group_size").collect())
        assert got == _brute(rows), limit


def test_pairs_of_structs_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), (None, 3)], "g string, i int")
    assert [tuple(r) for r in pairs_in_groups(df, "g", "i").collect()] == [("a", 1, 2, 2)]


def test_rank_of_a_split_group_equals_sorting(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.randrange(40)), i) for i in range(3000)] + [("hot", 7.0, 10_000 + i) for i in range(1500)] + [("cold", float(i % 3), i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(5)
    got = {(r.g, r.id): (r.r, r.r_n) for r in ranked(df, ["g"], "v", "id", "r").collect()}
    assert len(got) == len(rows)
    for g in ("hot", "cold"):
        want = sorted((v, i) for k, v, i in rows if k == g)
        for pos, (_, i) in enumerate(want):
            assert got[(g, i)] == (pos, len(want)), (g, i)


def test_names_with_one_prefix_spread_over_ranges(spark):
    names = spark.range(50_000).select(F.format_string("Customer#%09d", "id").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(names.withColumn("g", F.lit(1)), ["g"], "n", "n", "r").cache()
        assert out.filter(F.col("r") != F.substring("n", 10, 9).cast("long")).count() == 0
        sizes = [r["count"] for r in names.repartitionByRange("n").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_values_ties_and_null_keys_are_ranked(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, None, "b"), ("k", 2.0, "c"), ("k", 2.0, "c")], "g string, v double, t string")
    assert sorted((r.g or "", r.t, r.r, r.r_n) for r in ranked(df, ["g"], "v", "t", "r").collect()) == [("", "a", 1, 2), ("", "b", 0, 2), ("k", "c", 0, 2), ("k", "c", 1, 2)]


def test_carried_columns(spark):
    rows = [(1, i) for i in range(8)] + [(2, 1), (2, 2)]
    df, w = spark.createDataFrame(rows, "g int, i int"), spark.createDataFrame([(1, 5.0), (2, 7.0)], "g int, w double")
    for limit in (2048, 3):
        got = pairs_in_groups(df, "g", "i", limit, carry=w).groupBy("g", "w").count().collect()
        assert sorted(map(tuple, got)) == [(1, 5.0, 28), (2, 7.0, 1)]


def test_rank_by_string_in_a_split_group(spark):
    names = [f"node{i % 97:03d}x{i}" for i in range(700)]
    df = spark.createDataFrame([("a", n) for n in names], "g string, n string")
    got = [r.n for r in ranked(df, ["g"], "n", "n", "r").orderBy("r").collect()]
    assert got == sorted(names)
    whole = global_rank(df.select("n"), "n", "n", "r")
    assert [r.n for r in whole.orderBy("r").collect()] == sorted(names)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(v), v) for v in (5, 1, 4, 2)] + [("b", 3.0, 9)], "g string, v double, id long")
    assert {r.g: r.median for r in upper_median(df, ["g"], "v", "id").collect()} == {"a": 4.0, "b": 3.0}


def test_checkpoint_folder_comes_from_the_session(spark):
    import os

    from basketry.functions.lineage import checkpoint_dir, cut_lineage

    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == folder
    before = set(os.listdir(folder))
    assert cut_lineage(spark.range(5).select(F.col("id"))).count() == 5
    assert len(set(os.listdir(folder)) - before) == 1
