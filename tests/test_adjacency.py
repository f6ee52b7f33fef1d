"""Edges stored in buckets by either end give what the edge table gives, and only the buckets of a frontier are read."""

import random

import pytest

from basketry.operators import graph as G

HOPS = {"label": ["treats", "contains"], "item": ["contains", "treats"], "basket": ["contains"]}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    baskets, items, labels = [f"b{k}" for k in range(60)], [f"i{k}" for k in range(25)], ["x", "y", "z"]
    rows = [(f"basket_{b}", f"item_{i}", "contains", 1.0) for b in baskets for i in rng.sample(items, 4)]
    rows += [(f"basket_{b}", f"label_{rng.choice(labels)}", "treats", None) for b in baskets]
    rows += [(f"basket_{b}", "item_hot", "contains", 1.0) for b in baskets] + rows[:30] + [("item_i1", "item_i1", "contains", 1.0)]
    edges = spark.createDataFrame(rows, "source string, target string, type string, weight double")
    names = [("basket", b) for b in baskets] + [("item", i) for i in [*items, "hot", "alone"]] + [("label", x) for x in labels]
    nodes = spark.createDataFrame([(f"{t}_{n}", n, t) for t, n in names], "id string, label string, type string")
    path = str(tmp_path_factory.mktemp("adjacency") / "edges")
    return nodes, edges, path, G.store_adjacency(edges, path, rows_per_bucket=40)


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind,name", [("label", "y"), ("item", "i3"), ("item", "hot"), ("item", "i1"), ("basket", "b7"), ("item", "alone"), ("item", "unknown")])
def test_stored_expansion_equals_the_edge_table(stored, kind, name):
    nodes, edges, path, buckets = stored
    assert buckets > 10
    want, got = G.expand(nodes, edges, name, kind, HOPS[kind]), G.expand_stored(nodes, path, buckets, name, kind, HOPS[kind])
    assert rows(got[0]) == rows(want[0]) and rows(got[1]) == rows(want[1])


def test_one_node_reads_one_bucket_and_shuffles_nothing(spark, stored):
    _, _, path, buckets = stored
    one = G.stored_neighbours(spark, path, buckets, "item_i3", "contains")
    assert one.count() > 0 and len(one.select("bucket").distinct().collect()) == 1
    one.collect()
    plan = one._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and plan.collectLeaves().head().metrics().apply("numFiles").value() == 1


def test_a_frontier_reads_its_buckets_only(spark, stored):
    _, _, path, buckets = stored
    frontier = spark.createDataFrame([("basket_b1",), ("basket_b2",)], "id string")
    some = G.stored_neighbours(spark, path, buckets, frontier, "treats")
    assert some.count() == 2
    pruned = some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("DataFilters")[0]
    touched = {r.bucket for r in some.select("bucket").distinct().collect()}
    assert touched and all(str(b) in pruned for b in touched)


def test_no_edges(spark, tmp_path):
    edges = spark.createDataFrame([], "source string, target string, type string")
    assert G.store_adjacency(edges, str(tmp_path / "none")) == 1
