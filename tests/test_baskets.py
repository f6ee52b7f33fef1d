import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from basketry.operators import baskets as B, rows as R
from basketry.sources import tables as S

T5 = [["甘草", "桂枝", "白芍"], ["甘草", "桂枝", "生姜"], ["甘草", "白芍", "大枣"], ["桂枝", "白芍", "生姜"], ["甘草", "桂枝", "白芍", "生姜"]]


def long(spark, baskets):
    return spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "basket_id long, item string")


def brute(baskets, min_support, k):
    sets, n = [set(b) for b in baskets], len(baskets)
    items = sorted(set().union(*sets))
    return {c: cnt for size in range(1, k + 1) for c in combinations(items, size) for cnt in [sum(set(c) <= s for s in sets)] if cnt / n >= min_support}


@pytest.mark.parametrize("method", ["levelwise", "fpgrowth", "vertical"])
def test_itemsets_have_exact_supports(spark, method):
    for k in (2, 3):
        out = B.frequent_itemsets(long(spark, T5), 0.4, k, method).collect()
        assert {tuple(r["itemset"]): r["count"] for r in out} == brute(T5, 0.4, k)
        assert all(abs(r["support"] - r["count"] / 5) < 1e-12 for r in out)


def test_supports_and_lift_of_the_small_guard(spark):
    df = long(spark, [["a", "b"], ["a"], ["b"]])
    rules = B.association_rules(B.frequent_itemsets(df, 0.1, 2), 0.0, 0.0).collect()
    assert {(r.antecedent[0], round(r.lift, 6)) for r in rules} == {("a", 0.75), ("b", 0.75)}


def test_repeated_items_count_once(spark):
    df = long(spark, [["a", "a", "b"]])
    assert [tuple(r) for r in B.co_occurrence(df).collect()] == [("a", "b", 1, 1.0)]
    assert {r.item: r["count"] for r in B.item_counts(df).collect()} == {"a": 1, "b": 1}


def test_rules_cover_all_subsets(spark):
    sets = B.frequent_itemsets(long(spark, T5), 0.4, 3)
    rules = {(tuple(r.antecedent), tuple(r.consequent)): r for r in B.association_rules(sets, 0.0, 0.0).collect()}
    want = brute(T5, 0.4, 3)
    expected = {(a, tuple(x for x in s if x not in a)) for s in want if len(s) > 1 for m in range(1, len(s)) for a in combinations(s, m)}
    assert set(rules) == expected
    for (a, c), r in rules.items():
        s = tuple(sorted(a + c))
        assert abs(r.confidence - want[s] / want[a]) < 1e-12 and abs(r.lift - want[s] / want[a] / (want[c] / 5)) < 1e-12


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        B.frequent_itemsets(long(spark, T5), method="guess")


def test_empty_input(spark):
    empty = spark.createDataFrame([], "basket_id long, item string")
    assert B.frequent_itemsets(empty).count() == 0 and B.pair_stats(empty).count() == 0
    assert B.pair_support(empty, "a", "b").first().support == 0.0


def test_nested_documents(spark):
    docs = spark.createDataFrame([(1, "f", "d", 2.0, [("a", "9g", ""), ("a", "3两", ""), ("b", "x", "")], ["flu"], "s")], S.BASKET_SCHEMA)
    assert S.transactions(docs).first()["items"] == ["a", "b"]
    assert S.basket_items_from_documents(docs).count() == 3
    assert S.documents_with_label(docs, "flu").count() == 1 and docs.filter(R.has_struct_member("items", "name", "b")).count() == 1


def test_table_changes(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "name string, v int")
    table, rejected = S.insert_unique(old, new, "name", ["v"])
    assert sorted(map(tuple, table.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted((r.name, r.reason) for r in rejected.collect()) == [("b", "exists"), ("c", "duplicate")]
    assert sorted(map(tuple, S.upsert(old, spark.createDataFrame([("b", 7)], old.schema), "name").collect())) == [("a", 1), ("b", 7)]
    S.write_table(table, str(tmp_path / "t"), "json")
    assert S.load_table(spark, str(tmp_path / "t"), table.schema, "json").count() == 3
    with pytest.raises(ValueError):
        S.load_table(spark, str(tmp_path / "t"), fmt="json")
    S.export_graph(table, table, str(tmp_path / "g"))
    assert spark.read.schema("kind string, total long").json(str(tmp_path / "g/totals")).agg(F.sum("total")).first()[0] == 6


def test_upsert_takes_the_last_change_of_a_key(spark):
    old = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "id int, v string, at int")
    changes = spark.createDataFrame([(1, "b", 5), (1, "c", 9), (3, "n", 1)], "id int, v string, at int")
    assert sorted(map(tuple, S.upsert(old, changes, "id", order=["at"]).collect())) == [(1, "c", 9), (2, "y", 0), (3, "n", 1)]
    assert sorted(map(tuple, S.upsert(old, changes, "id", insert=False).collect())) == [(1, "c", 9), (2, "y", 0)]


def test_vertical_mining_of_multiplicities_and_several_slices(spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE", 64)
    rng = random.Random(5)
    baskets = [["a", "b", "c"]] * 13 + [["a", "c", "d", "e"]] * 6 + [rng.sample("abcdefghijk", rng.randint(1, 6)) for _ in range(400)]
    df = long(spark, baskets).repartition(3)
    for support, k in ((0.05, 4), (0.03, None)):
        got = {tuple(r["itemset"]): r["count"] for r in B.frequent_itemsets(df, support, k, "vertical").collect()}
        assert got == brute(baskets, support, k or 11)
    levelwise = {tuple(r["itemset"]): r["count"] for r in B.frequent_itemsets(df, 0.05, 4).collect()}
    assert levelwise == brute(baskets, 0.05, 4)


def test_vertical_mining_of_one_very_long_basket(spark):
    """250 frequent items in one basket have 2.6 million triples; only those with all pairs frequent are counted."""
    items = [f"i{k:03d}" for k in range(250)]
    baskets = [items] + [[i] for i in items] + [items[:4]] * 2
    got = {tuple(r["itemset"]): r["count"] for r in B.frequent_itemsets(long(spark, baskets), 1.5 / len(baskets), 3, "vertical").collect()}
    assert {s: c for s, c in got.items() if len(s) > 1} == {c: 3 for k in (2, 3) for c in combinations(items[:4], k)}
    assert sum(len(s) == 1 for s in got) == 250


def test_vertical_mining_of_numbers_and_of_nothing(spark):
    numbers = long(spark, [["9", "10", "11"]] * 2).select("basket_id", F.col("item").cast("int").alias("item"))
    assert [9, 10, 11] in [list(r["itemset"]) for r in B.frequent_itemsets(numbers, 0.5, None, "vertical").collect()]
    assert B.frequent_itemsets(long(spark, []), 0.5, None, "vertical").count() == 0
    with pytest.raises(ValueError):
        B.frequent_itemsets(long(spark, T5), 0.5, None)
