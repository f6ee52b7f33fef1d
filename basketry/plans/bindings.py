"""Roles of the engine bound to the supplied tables, each with the same thing said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage
from ..operators import baskets as B, graph as G
from .catalog import Tables

# --- baskets ------------------------------------------------------------------------------------------------

BI = ("bi", "SELECT DISTINCT l_orderkey AS basket_id, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey")
BRANDS = ("bi", "SELECT DISTINCT l_orderkey AS basket_id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey")
BASKETS = ("baskets", "SELECT o_orderkey AS basket_id, o_totalprice AS frequency, CAST(year(o_orderdate) AS INTEGER) AS period, "
                      "o_orderpriority AS label, o_orderstatus AS status FROM orders")
ITEMS = ("items", "SELECT p_name AS name, min(split_part(p_name, ' ', 1)) AS category, "
                  "CASE WHEN avg(p_size) >= 25.5 THEN 'warm' ELSE 'cool' END AS nature, count(*) AS parts, min(p_size) AS min_size, "
                  "max(p_retailprice) AS max_price FROM part GROUP BY p_name")
TARGETS = ("targets", "SELECT p_name AS item, p_brand || '/' || CAST(p_size AS VARCHAR) AS target, "
                      "round(avg(p_retailprice) / 1000, 6) AS affinity, min(p_type) AS effect_type FROM part GROUP BY 1, 2")


def basket_items(t: Tables) -> DataFrame:
    """Order x part name (64 names), with repeats as they come; operators de-duplicate."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("basket_id"), F.col("p_name").alias("item"))


def basket_brands(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("basket_id"), F.col("p_brand").alias("item"))


def baskets(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("basket_id"), F.col("o_totalprice").alias("frequency"),
        F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("status"))


def basket_labels(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderpriority").alias("label"))


def items(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("name")).agg(
        F.min(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("category"),
        F.when(F.avg("p_size") >= 25.5, "warm").otherwise("cool").alias("nature"),
        F.count(F.lit(1)).alias("parts"), F.min("p_size").alias("min_size"), F.max("p_retailprice").alias("max_price"))


def item_targets(t: Tables) -> DataFrame:
    target = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"))
    return t.part.groupBy(F.col("p_name").alias("item"), target.alias("target")).agg(
        F.round(F.avg("p_retailprice") / 1000, 6).alias("affinity"), F.min("p_type").alias("effect_type"))


# --- graph --------------------------------------------------------------------------------------------------

CO = ("co", "SELECT a.item AS item_a, b.item AS item_b, count(*) AS count, round(sum(frequency), 2) AS weight "
            "FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item JOIN baskets ON baskets.basket_id = a.basket_id GROUP BY 1, 2")
#: Edges are pairs clearly above the mean count, so that unlinked pairs remain at every scale.
EDGE_FACTOR = 1.05
EDGES = ("edges", f"SELECT item_a AS src, item_b AS dst, weight, count FROM co WHERE count >= {EDGE_FACTOR} * (SELECT avg(count) FROM co)")
SYM = ("sym", "SELECT src AS u, dst AS v, weight AS w FROM edges UNION ALL SELECT dst, src, weight FROM edges")
DEG = ("deg", "SELECT u AS node, count(*) AS degree FROM sym GROUP BY u")
GRAPH = (BI, BASKETS, CO, EDGES, SYM, DEG)


def co_occurrence(t: Tables) -> DataFrame:
    return B.co_occurrence(basket_items(t), baskets(t))


def graph_edges(t: Tables) -> DataFrame:
    """Thresholded co-occurrence graph, stored once because every graph operator reads it several times."""
    pairs = cut_lineage(co_occurrence(t).withColumn("weight", F.round("weight", 2)))
    mean = pairs.agg(F.avg("count")).first()[0] or 0.0
    return cut_lineage(G.threshold_edges(pairs.filter(F.col("count") >= EDGE_FACTOR * mean), 1))
