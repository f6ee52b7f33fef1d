"""Co-occurrence, itemsets, rules and pair statistics over orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import checkpoint_dir
from ..operators import baskets as B
from ..sources import tables as S
from . import bindings as Bd
from .catalog import Tables, query, with_ctes

SUPPORT = 0.002
N = ("n", "SELECT count(DISTINCT basket_id) AS n FROM bi")


def _frequent(items=Bd.BRANDS, support: float = SUPPORT) -> tuple:
    """CTEs f1, f2, f3 (itemset as ' | '-joined text, count) and f over all of them, for sizes 1 to 3."""
    keep = f"HAVING count(*) >= {support} * (SELECT n FROM n)"
    return (
        items, N,
        ("f1", f"SELECT item AS i1, count(*) AS c FROM bi GROUP BY item {keep}"),
        ("k", "SELECT bi.basket_id, bi.item FROM bi JOIN f1 ON bi.item = f1.i1"),
        ("f2", f"SELECT a.item AS i1, b.item AS i2, count(*) AS c FROM k a JOIN k b ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY 1, 2 {keep}"),
        ("f3", "SELECT a.item AS i1, b.item AS i2, d.item AS i3, count(*) AS c FROM k a JOIN k b ON a.basket_id = b.basket_id AND a.item < b.item "
               f"JOIN k d ON d.basket_id = a.basket_id AND b.item < d.item GROUP BY 1, 2, 3 {keep}"),
        ("f", "SELECT i1 AS s, 1 AS size, c FROM f1 UNION ALL SELECT i1 || ' | ' || i2, 2, c FROM f2 UNION ALL SELECT i1 || ' | ' || i2 || ' | ' || i3, 3, c FROM f3"),
    )


def _joined(column: str):
    return F.array_join(column, " | ")


def _flat(itemsets: DataFrame) -> DataFrame:
    return itemsets.select(_joined("itemset").alias("itemset"), "size", "count", F.round("support", 6).alias("support"))


@query("pair_stats", with_ctes(Bd.BI, N, ("one", "SELECT item, count(*) AS c FROM bi GROUP BY item"), (
    "co", "SELECT a.item AS item_a, b.item AS item_b, count(*) AS count FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY 1, 2"), body=(
    "SELECT item_a, item_b, count, a.c AS count_a, b.c AS count_b, round(count / n, 6) AS support, round(count / a.c, 6) AS confidence_a_to_b, "
    "round(count / b.c, 6) AS confidence_b_to_a, round(CAST(count AS DOUBLE) * n / (CAST(a.c AS DOUBLE) * b.c), 6) AS lift "
    "FROM co JOIN one a ON a.item = item_a JOIN one b ON b.item = item_b CROSS JOIN n")))
def pair_stats(t: Tables) -> DataFrame:
    out = B.pair_stats(Bd.basket_items(t))
    return out.select("item_a", "item_b", "count", "count_a", "count_b",
                      *[F.round(c, 6).alias(c) for c in ("support", "confidence_a_to_b", "confidence_b_to_a", "lift")])


@query("co_occurrence", with_ctes(Bd.BI, Bd.BASKETS, Bd.CO, body="SELECT item_a, item_b, count, weight FROM co"))
def co_occurrence(t: Tables) -> DataFrame:
    return Bd.co_occurrence(t).withColumn("weight", F.round("weight", 2))


@query("stored_co_occurrence", with_ctes(Bd.BI, Bd.BASKETS, Bd.CO, body="SELECT item_a, item_b, count, weight FROM co WHERE count >= 3"))
def stored_co_occurrence(t: Tables) -> DataFrame:
    """The pairs of three baskets or more, written as a table and read back."""
    path = f"{checkpoint_dir(t.spark)}/co-occurrence-{uuid.uuid4().hex}"
    S.write_table(B.co_occurrence(Bd.basket_items(t), Bd.baskets(t), min_count=3).withColumn("weight", F.round("weight", 2)), path)
    return S.load_table(t.spark, path)


@query("item_counts", with_ctes(Bd.BI, body="SELECT item, count(*) AS count FROM bi GROUP BY item"))
def item_counts(t: Tables) -> DataFrame:
    return B.item_counts(Bd.basket_items(t))


@query("frequent_itemsets", with_ctes(*_frequent(), body="SELECT s AS itemset, size, c AS count, round(c / n, 6) AS support FROM f CROSS JOIN n"))
def frequent_itemsets(t: Tables) -> DataFrame:
    return _flat(B.frequent_itemsets(Bd.basket_brands(t), SUPPORT, 3))


@query("frequent_itemsets_vertical", with_ctes(*_frequent(), body="SELECT s AS itemset, size, c AS count, round(c / n, 6) AS support FROM f CROSS JOIN n"))
def frequent_itemsets_vertical(t: Tables) -> DataFrame:
    return _flat(B.frequent_itemsets(Bd.basket_brands(t), SUPPORT, 3, "vertical"))


@query("frequent_itemsets_fpgrowth", with_ctes(*_frequent(), body="SELECT s AS itemset, size, c AS count, round(c / n, 6) AS support FROM f CROSS JOIN n"))
def frequent_itemsets_fpgrowth(t: Tables) -> DataFrame:
    return _flat(B.frequent_itemsets(Bd.basket_brands(t), SUPPORT, 3, method="fpgrowth"))


@query("itemsets_by_size", with_ctes(*_frequent(), body=(
    "SELECT s AS itemset, size, c AS count, CAST(row_number() OVER (PARTITION BY size ORDER BY c DESC, s) AS INTEGER) AS rank FROM f QUALIFY rank <= 15")))
def itemsets_by_size(t: Tables) -> DataFrame:
    out = B.itemsets_by_size(B.frequent_itemsets(Bd.basket_brands(t), SUPPORT, 3), 15)
    return out.select(_joined("itemset").alias("itemset"), "size", "count", "rank")


def _rules_cte(conf: float, lift: float) -> tuple:
    split2 = ("SELECT i1 AS a, i2 AS b, c FROM f2 UNION ALL SELECT i2, i1, c FROM f2")
    split3 = " UNION ALL ".join(
        f"SELECT {a} AS a, {b} AS b, c FROM f3" for a, b in [
            ("i1", "i2 || ' | ' || i3"), ("i2", "i1 || ' | ' || i3"), ("i3", "i1 || ' | ' || i2"),
            ("i2 || ' | ' || i3", "i1"), ("i1 || ' | ' || i3", "i2"), ("i1 || ' | ' || i2", "i3")])
    return (
        ("parts", split2 + " UNION ALL " + split3),
        ("rules", "SELECT a AS antecedent, b AS consequent, parts.c AS count, parts.c / n AS support, "
                  "(parts.c / n) / (x.c / n) AS confidence, (parts.c / n) / (x.c / n) / (y.c / n) AS lift "
                  "FROM parts JOIN f x ON x.s = a JOIN f y ON y.s = b CROSS JOIN n "
                  f"WHERE (parts.c / n) / (x.c / n) >= {conf} AND (parts.c / n) / (x.c / n) / (y.c / n) >= {lift}"),
    )


def _flat_rules(rules: DataFrame) -> DataFrame:
    return rules.select(_joined("antecedent").alias("antecedent"), _joined("consequent").alias("consequent"), "count",
                        *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


RULE_COLS = "antecedent, consequent, count, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift"


@query("association_rules", with_ctes(*_frequent(), *_rules_cte(0.05, 0.95), body=f"SELECT {RULE_COLS} FROM rules"))
def association_rules(t: Tables) -> DataFrame:
    return _flat_rules(B.association_rules(B.frequent_itemsets(Bd.basket_brands(t), SUPPORT, 3), 0.05, 0.95))


@query("top_pairs", with_ctes(Bd.BRANDS, N, body=(
    "SELECT a.item AS item_a, b.item AS item_b, count(*) AS count, round(count(*) / any_value(n), 6) AS support FROM bi a "
    "JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item CROSS JOIN n GROUP BY 1, 2 ORDER BY count DESC, 1, 2 LIMIT 20")))
def top_pairs(t: Tables) -> DataFrame:
    return B.top_pairs(Bd.basket_brands(t), 20).withColumn("support", F.round("support", 6))


@query("top_triplets", with_ctes(*_frequent(support=0.002), body=(
    "SELECT s AS itemset, c AS count, round(c / n, 6) AS support FROM f CROSS JOIN n WHERE size = 3 ORDER BY c DESC, s LIMIT 20")))
def top_triplets(t: Tables) -> DataFrame:
    sets = B.frequent_itemsets(Bd.basket_brands(t), 0.002, 3)
    return B.top_itemsets(sets, 3, 20).select(_joined("itemset").alias("itemset"), "count", F.round("support", 6).alias("support"))


_LABEL_BRANDS = ("bi", "SELECT DISTINCT l_orderkey AS basket_id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey "
                       "JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '2-HIGH'")


def _label(t: Tables) -> DataFrame:
    return S.with_label(Bd.basket_brands(t), Bd.basket_labels(t), "2-HIGH")


@query("label_mining", with_ctes(*_frequent(_LABEL_BRANDS), *_rules_cte(0.05, 0.9), body=(
    "(SELECT 'pair' AS kind, s AS left_items, '' AS right_items, c AS count FROM f WHERE size = 2 ORDER BY c DESC, s LIMIT 20) UNION ALL "
    "(SELECT 'triplet', s, '', c FROM f WHERE size = 3 ORDER BY c DESC, s LIMIT 10) UNION ALL "
    "(SELECT 'rule', antecedent, consequent, count FROM rules ORDER BY support DESC, confidence DESC, antecedent, consequent LIMIT 30)")))
def label_mining(t: Tables) -> DataFrame:
    found = B.mine_label(_label(t), SUPPORT, 0.05, 0.9)
    none = F.lit("").alias("right_items")
    pairs = found["pairs"].select(F.lit("pair").alias("kind"), _joined("itemset").alias("left_items"), none, "count")
    triplets = found["triplets"].select(F.lit("triplet").alias("kind"), _joined("itemset").alias("left_items"), none, "count")
    rules = found["rules"].select(F.lit("rule").alias("kind"), _joined("antecedent").alias("left_items"), _joined("consequent").alias("right_items"), "count")
    return pairs.unionByName(triplets).unionByName(rules)


@query("pair_support", with_ctes(Bd.BI, ("fl", "SELECT basket_id, max(CASE WHEN item = 'red ring' THEN 1 ELSE 0 END) AS a, "
                                              "max(CASE WHEN item = 'small ring' THEN 1 ELSE 0 END) AS b FROM bi GROUP BY basket_id"),
                                 ("s", "SELECT count(*) AS total, CAST(sum(a) AS BIGINT) AS count_a, CAST(sum(b) AS BIGINT) AS count_b, CAST(sum(a * b) AS BIGINT) AS count_ab FROM fl"), body=(
    "SELECT total, count_a, count_b, count_ab, round(count_ab / total, 6) AS support, round(count_ab / count_a, 6) AS confidence_a_to_b, "
    "round(count_ab / count_b, 6) AS confidence_b_to_a, round((count_ab / total) / ((count_a / total) * (count_b / total)), 6) AS lift FROM s")))
def pair_support(t: Tables) -> DataFrame:
    out = B.pair_support(Bd.basket_items(t), "red ring", "small ring").drop("item_a", "item_b")
    return out.select("total", "count_a", "count_b", "count_ab", *[F.round(c, 6).alias(c) for c in ("support", "confidence_a_to_b", "confidence_b_to_a", "lift")])


_REC = (Bd.BI, Bd.BASKETS, ("mine", "SELECT bi.basket_id, item FROM bi JOIN baskets USING (basket_id) WHERE label = '3-MEDIUM'"),
        ("cnt", "SELECT item, count(*) AS c FROM mine GROUP BY item"),
        ("pr", "SELECT a.item AS item_a, b.item AS item_b, count(*) AS count FROM mine a JOIN mine b ON a.basket_id = b.basket_id AND a.item < b.item "
               "GROUP BY 1, 2 ORDER BY count DESC, 1, 2 LIMIT 10"))


@query("recommend_core_items", with_ctes(*_REC, body="SELECT item, c AS count FROM cnt ORDER BY c DESC, item LIMIT 10"))
def recommend_core_items(t: Tables) -> DataFrame:
    return B.recommend_for_label(Bd.basket_items(t), Bd.basket_labels(t), "3-MEDIUM")["core_items"]


@query("recommend_pairs", with_ctes(*_REC, (
    "rel", "SELECT pr.item_a, pr.item_b, label, count(DISTINCT x.basket_id) AS n FROM pr JOIN bi x ON x.item = pr.item_a JOIN bi y ON y.item = pr.item_b AND y.basket_id = x.basket_id "
           "JOIN baskets ON baskets.basket_id = x.basket_id GROUP BY 1, 2, 3"),
    ("top", "SELECT item_a, item_b, label, row_number() OVER (PARTITION BY item_a, item_b ORDER BY n DESC, label) AS r FROM rel QUALIFY r <= 3"), body=(
    "SELECT pr.item_a, pr.item_b, any_value(pr.count) AS count, round(any_value(pr.count) / any_value(cnt.c), 6) AS confidence, "
    "string_agg(top.label, ',' ORDER BY r) AS related_labels FROM pr JOIN cnt ON cnt.item = pr.item_a JOIN top ON top.item_a = pr.item_a AND top.item_b = pr.item_b GROUP BY 1, 2")))
def recommend_pairs(t: Tables) -> DataFrame:
    out = B.recommend_for_label(Bd.basket_items(t), Bd.basket_labels(t), "3-MEDIUM", n_labels=3)["pairs"]
    return out.select("item_a", "item_b", "count", F.round("confidence", 6).alias("confidence"), F.array_join("related_labels", ",").alias("related_labels"))
