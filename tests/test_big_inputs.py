"""Steps that must not grow with the table: what is dealt out, what is broadcast, what is never sorted."""

import pytest

from basketry.functions import groups
from basketry.operators import graph as G, risk as R

TOXIC = "item string, ld50 double, max_dose double, pregnancy string"
PAIRS = "herb_a string, herb_b string, risk_level string, evidence_level string, interaction_type string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_by_the_size_of_their_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k % 7, f"i{k % 5}") for k in range(500)], "basket_id long, item string").repartition(3).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    assert groups.dealt(df, "basket_id") is df
    monkeypatch.setattr(groups, "DEALT_BYTES", 100)
    assert groups.dealt(df, "basket_id").rdd.getNumPartitions() > 10
    assert R._items(df).count() == 35
    assert "repartition_by_num" in plan(R.profile_reactions(df, spark.createDataFrame([("i1", "t", "s")], "item string, type string, severity string"))).lower()


def test_links_are_not_sorted_for_their_names(spark):
    links = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "a"), (None, "a")], "basket_id long, item string")
    baskets, items = spark.createDataFrame([("1",), ("2",), ("2",)], "name string"), spark.createDataFrame([("a",)], "name string")
    edges = G.membership_edges(links, "basket_id", "item", "basket", "item", "contains", baskets, items)
    assert "ShuffledHashJoin" in plan(edges)
    assert [(r.source, r.target) for r in edges.collect()] == [("basket_1", "item_a")]


def test_contraction_moves_no_edge_to_its_node(spark, monkeypatch):
    monkeypatch.setattr(G, "cut_lineage", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([("item_a", "a", "item", "g", "x"), ("item_b", "b", "item", "g", "x"), ("basket_1", "1", "basket", None, None)], "id string, label string, type string, category string, nature string")
        edges = spark.createDataFrame([("basket_1", "item_a", "contains", None), ("basket_1", "item_b", "contains", None), ("item_a", "item_b", "co", 1.0)], "source string, target string, type string, weight double")
        moved = G.contract_graph(nodes, edges, "item")[1]
        assert plan(moved).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan(moved)
        assert [tuple(r) for r in moved.collect()] == [("basket_1", "group_g", "contains", 2.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def baskets(spark):
    rows = [(1, "a"), (1, "b"), (1, "c"), (2, "b"), (2, "a"), (3, "c"), (None, "a"), (None, "b")] + [(9, f"x{k}") for k in range(groups.BLOCK_ITEMS + 50)] + [(9, "a"), (9, "b")]
    return spark.createDataFrame(rows, "basket_id long, item string")


def test_known_pairs_of_ordinary_and_big_baskets(spark, baskets):
    pairs = spark.createDataFrame([("b", "a", "high", "A", "t"), ("c", "c", "low", "A", "t"), ("x7", "a", "high", "A", "t")]
                                  + [(f"x{k}", "z", "high", "A", "t") for k in range(groups.BLOCK_ITEMS + 50)], PAIRS)
    want = [(1, "a", "b"), (1, "c", "c"), (2, "a", "b"), (3, "c", "c"), (9, "a", "b"), (9, "a", "x7")]
    toxic = spark.createDataFrame([("a", 10.0, 1.0, ""), ("b", 10.0, 1.0, ""), ("c", 10.0, 1.0, "")], TOXIC)
    for found in (R.known_risk_pairs(baskets, pairs), R.detect_risk_pairs(baskets, toxic, pairs).filter("priority = 1")):
        assert sorted((r.basket_id, r.item_a, r.item_b) for r in found.collect()) == want
    other = R.detect_risk_pairs(baskets, toxic, pairs).filter("priority = 2")
    assert sorted((r.basket_id, r.item_a, r.item_b) for r in other.collect()) == [(1, "a", "c"), (1, "b", "c")]


def test_pairs_of_baskets_are_not_shuffled(spark, baskets):
    toxic = spark.createDataFrame([("a", 10.0, 1.0, ""), ("b", 10.0, 1.0, "")], TOXIC)
    found = R.detect_risk_pairs(baskets.filter("basket_id < 9"), toxic, spark.createDataFrame([("a", "c", "high", "A", "t")], PAIRS))
    assert "SortMergeJoin" not in plan(found) and "hashpartitioning(item_a" not in plan(found)


def test_an_assessment_is_one_grouping(spark, baskets):
    toxic = spark.createDataFrame([("a", 10.0, 1.0, ""), ("b", 10.0, 1.0, "")], TOXIC)
    doses = spark.createDataFrame([(1, "a", 2.0), (2, "a", 0.5), (None, "a", 5.0), (77, "a", 9.0)], "basket_id long, item string, dose double")
    got = R.assess_risk(baskets, toxic, spark.createDataFrame([("a", "b", "high", "A", "t")], PAIRS), basket_doses=doses)
    assert "SortMergeJoin [basket_id" not in plan(got)
    rows = {r.basket_id: (r.n_items, r.n_toxic, r.n_known, r.n_severe, r.n_inferred, r.n_overdose) for r in got.collect()}
    assert rows == {None: (2, 2, 0, 0, 0, 0), 1: (3, 2, 1, 1, 0, 1), 2: (2, 2, 1, 1, 0, 0), 3: (1, 0, 0, 0, 0, 0), 9: (groups.BLOCK_ITEMS + 52, 2, 1, 1, 0, 0)}
