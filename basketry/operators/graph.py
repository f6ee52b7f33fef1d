"""Property graph as two tables: ``nodes(id, label, type, size, properties)`` and ``edges(source, target, type, weight, count)``.

Node ids are ``<type>_<name>``. Every view is a chain of joins over these tables or the tables behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.groups import dealt, small_side
from ..functions.lineage import cut_lineage
from ..functions.scalars import safe_div
from .rows import top_k_per_group


def _props(df: DataFrame, columns: Sequence[str]):
    """MAP<STRING,STRING> of the given columns; missing values become an empty string, arrays are comma-joined."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    types = dict(df.dtypes)
    kv = []
    for c in columns:
        text = F.array_join(F.col(c), ",") if types[c].startswith("array") else F.col(c).cast("string")
        kv += [F.lit(c), F.coalesce(text, F.lit(""))]
    return F.create_map(*kv)


def nodes_of(df: DataFrame, node_type: str, name: str = "name", size: str | None = None, properties: Sequence[str] = ()) -> DataFrame:
    return df.select(
        F.concat(F.lit(node_type + "_"), F.col(name).cast("string")).alias("id"),
        F.col(name).cast("string").alias("label"),
        F.lit(node_type).alias("type"),
        (F.col(size).cast("double") if size else F.lit(None).cast("double")).alias("size"),
        _props(df, properties).alias("properties"),
    )


def union_nodes(*parts: DataFrame) -> DataFrame:
    """Union of node tables, one row per id; of rows that differ the first in the order of their JSON text."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    row = F.struct("label", "type", "size", "properties")
    return out.groupBy("id").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("id", "_row.*")


def build_nodes(items: DataFrame, baskets: DataFrame, labels: DataFrame, item_props: Sequence[str] = (),
                basket_props: Sequence[str] = (), label_props: Sequence[str] = ()) -> DataFrame:
    """Nodes of the three dimension tables. Names are unique per table, so no de-duplication shuffle is needed."""
    return (
        nodes_of(items, "item", properties=item_props)
        .unionByName(nodes_of(baskets, "basket", size="frequency", properties=basket_props))
        .unionByName(nodes_of(labels, "label", properties=label_props))
    )


def membership_edges(links: DataFrame, left: str, right: str, left_type: str, right_type: str, edge_type: str,
                     left_names: DataFrame | None = None, right_names: DataFrame | None = None) -> DataFrame:
    """Distinct edges of a link table, kept only where both ends exist in the given name tables (column ``name``).

    Repeats go first, and the names of the left ends are hashed, so the links are never sorted.
    """
    out = dealt(links.select(F.col(left).cast("string").alias("_l"), F.col(right).cast("string").alias("_r")), "_l", "_r").distinct()
    if left_names is not None:
        out = out.join(left_names.select(F.col("name").cast("string").alias("_l")).hint("shuffle_hash"), "_l", "left_semi")
    if right_names is not None:
        out = out.join(right_names.select(F.col("name").cast("string").alias("_r")), "_r", "left_semi")
    return out.select(
        F.concat(F.lit(left_type + "_"), "_l").alias("source"),
        F.concat(F.lit(right_type + "_"), "_r").alias("target"),
        F.lit(edge_type).alias("type"),
        F.lit(None).cast("double").alias("weight"),
        F.lit(None).cast("long").alias("count"),
    )


def co_occurrence_edges(pairs: DataFrame) -> DataFrame:
    """Edges of a co-occurrence table (``item_a, item_b, count, weight``)."""
    return pairs.select(
        F.concat(F.lit("item_"), "item_a").alias("source"), F.concat(F.lit("item_"), "item_b").alias("target"),
        F.lit("co_occurs").alias("type"), "weight", "count")


def build_edges(basket_items: DataFrame, basket_labels: DataFrame, items: DataFrame, baskets: DataFrame, labels: DataFrame) -> DataFrame:
    """Contains and treats edges between existing nodes."""
    contains = membership_edges(basket_items, "basket_id", "item", "basket", "item", "contains", baskets, items)
    treats = membership_edges(basket_labels, "basket_id", "label", "basket", "label", "treats", baskets, labels)
    return contains.unionByName(treats)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes per node type and of edges per edge type."""
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("count")).select(F.lit("node").alias("kind"), "type", "count")
    e = edges.groupBy("type").agg(F.count(F.lit(1)).alias("count")).select(F.lit("edge").alias("kind"), "type", "count")
    return n.unionByName(e)


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    ids = nodes.select("id")
    return (edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
            .join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))


def co_occurrence_list(pairs: DataFrame, min_count: int = 1, limit: int = 100) -> DataFrame:
    """Strongest pairs at or above a count."""
    return pairs.filter(F.col("count") >= min_count).orderBy(F.desc("weight"), "item_a", "item_b").limit(limit)


def network_view(nodes: DataFrame, edges: DataFrame, limit_per_type: int = 50, co_limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Whole-network view: the first nodes of every type (largest size, then label), the edges among them, and of
    the co-occurrence edges only the heaviest ``co_limit``."""
    shown = top_k_per_group(nodes, ["type"], [F.desc_nulls_last("size"), F.asc("label")], limit_per_type).drop("rank")
    ids = F.broadcast(shown.select("id"))  # limit_per_type rows per node type
    inside = (edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
              .join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    co = inside.filter(F.col("type") == "co_occurs").orderBy(F.desc("weight"), "source", "target").limit(co_limit)
    return shown, inside.filter(F.col("type") != "co_occurs").unionByName(co)


def expand(nodes: DataFrame, edges: DataFrame, start: str, start_type: str, hops: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges reached from one node along edge types, one hop per entry of ``hops``.

    A hop follows the edges of its type in either direction, from the nodes of the previous hop. The start node
    is part of the result even when it has no edge; an unknown start gives two empty tables.
    """
    root = f"{start_type}_{start}"
    reached = nodes.filter(F.col("id") == root).select("id")
    seen, kept = reached, None
    frontier = reached
    for edge_type in hops:
        e = edges.filter(F.col("type") == edge_type)
        out = e.join(frontier.withColumnRenamed("id", "source"), "source", "left_semi")
        back = e.join(frontier.withColumnRenamed("id", "target"), "target", "left_semi")
        step = out.unionByName(back).distinct()
        frontier = out.select(F.col("target").alias("id")).union(back.select(F.col("source").alias("id"))).distinct()
        seen = seen.union(frontier)
        kept = step if kept is None else kept.unionByName(step)
    shown = nodes.join(seen.distinct(), "id", "left_semi")
    return shown, kept.distinct()


def merge_views(*views: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of several (nodes, edges) results without repeats."""
    edges = views[0][1]
    for _, e in views[1:]:
        edges = edges.unionByName(e)
    return union_nodes(*[n for n, _ in views]), edges.distinct()


def subgraph_from_label(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Label -> its baskets -> their items."""
    return expand(nodes, edges, label, "label", ["treats", "contains"])


def subgraph_from_item(nodes: DataFrame, edges: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Item -> the baskets that hold it -> their labels."""
    return expand(nodes, edges, item, "item", ["contains", "treats"])


def subgraph_from_basket(nodes: DataFrame, edges: DataFrame, basket: str) -> tuple[DataFrame, DataFrame]:
    """Basket -> its items and its labels."""
    return merge_views(expand(nodes, edges, basket, "basket", ["contains"]), expand(nodes, edges, basket, "basket", ["treats"]))


# --- undirected weighted graph: edges(src < dst, weight) ----------------------------------------------------

def threshold_edges(pairs: DataFrame, min_count: int) -> DataFrame:
    """Undirected edges ``src < dst, weight, count`` of the pairs at or above a count."""
    return pairs.filter(F.col("count") >= min_count).select(
        F.col("item_a").alias("src"), F.col("item_b").alias("dst"), F.col("weight").cast("double").alias("weight"), "count")


def symmetric(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Both directions of every edge as ``u, v, w``; one explode, so the edge table is read once."""
    both = F.explode(F.array(
        F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
    return edges.select(F.col(weight).cast("double").alias("w"), both.alias("_e")).select("_e.u", "_e.v", "w")


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and weighted degree of every node that has an edge."""
    return symmetric(edges).groupBy(F.col("u").alias("node")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weighted_degree"))


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of ``partition(node, community)``: one row. Self-loops (``src = dst``) count once in the weight.

    Edges are reduced to community pairs by two joins and one aggregation; nothing per node is collected.
    """
    src = partition.select(F.col("node").alias("src"), F.col("community").alias("_cs"))
    dst = partition.select(F.col("node").alias("dst"), F.col("community").alias("_cd"))
    reduced = (edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(src, "src").join(dst, "dst")
               .groupBy("_cs", "_cd").agg(F.sum("weight").alias("_w")))
    ends = reduced.select(F.explode(F.array(
        F.struct(F.col("_cs").alias("c"), F.when(F.col("_cs") == F.col("_cd"), F.col("_w")).otherwise(0.0).alias("inside"), F.col("_w").alias("tot")),
        F.struct(F.col("_cd").alias("c"), F.lit(0.0).alias("inside"), F.col("_w").alias("tot")),
    )).alias("_s"))
    per = ends.groupBy("_s.c").agg(F.sum("_s.inside").alias("inside"), F.sum("_s.tot").alias("tot"))
    total = per.agg(F.sum("inside").alias("_in"), F.sum("tot").alias("_m2"), F.sum(F.col("tot") * F.col("tot")).alias("_sq"))
    return total.select(F.coalesce(
        safe_div(2.0 * F.col("_in"), "_m2") - resolution * safe_div("_sq", F.col("_m2") * F.col("_m2")), F.lit(0.0)).alias("modularity"))


def community_sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community")


def node_community(partition: DataFrame, names: DataFrame) -> DataFrame:
    """Community of each asked node (column ``node``), null-safe: ``known`` is false for a node that is not in the graph."""
    return names.select("node").join(partition, "node", "left").withColumn("known", F.col("community").isNotNull())


def community_members(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Members with their degree, ordered by community size and degree."""
    sizes = partition.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    out = partition.join(degrees(edges).select("node", "degree"), "node", "left").join(sizes, "community")
    return out.select("community", "size", "node", F.coalesce("degree", F.lit(0).cast("long")).alias("degree")).orderBy(
        F.desc("size"), "community", F.desc("degree"), "node")


def community_detail(edges: DataFrame, partition: DataFrame, community, items: DataFrame | None = None,
                     attributes: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Induced subgraph of one community: (members with inner degree and attributes, inner edges)."""
    members = partition.filter(F.col("community") == community).select("node")
    inner = (edges.join(members.withColumnRenamed("node", "src"), "src", "left_semi")
             .join(members.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    inner_degrees = degrees(inner).withColumnsRenamed({"degree": "inner_degree", "weighted_degree": "inner_weight"})
    rows = members.join(inner_degrees, "node", "left").na.fill({"inner_degree": 0, "inner_weight": 0.0})
    if items is not None:
        dim = items.select(F.col("name").alias("node"), *attributes)
        rows = rows.join(dim, "node", "left")
        for a in attributes:
            if dict(rows.dtypes)[a] == "string":
                rows = rows.withColumn(a, F.coalesce(a, F.lit("")))
    return rows, inner


def contract_graph(nodes: DataFrame, edges: DataFrame, group_type: str, group_default: str = "other",
                   trait: str = "nature", trait_default: str = "neutral") -> tuple[DataFrame, DataFrame]:
    """Merge the nodes of one type into a super-node per category, whatever the size of the graph.

    ``nodes(id, label, type, category, <trait>)``. A super-node has the member count and the most frequent trait
    (first by name among equals); member ids stay a table: ``nodes.member_of`` of :func:`contraction_map`. Edges are re-pointed,
    self-loops dropped and parallel edges summed.
    """
    mapped = cut_lineage(contraction_map(nodes, group_type, group_default))
    mapped = small_side(mapped.count(), mapped)
    of_type = nodes.filter(F.col("type") == group_type)
    cat = F.coalesce("category", F.lit(group_default))
    traits = of_type.groupBy(cat.alias("_c"), F.coalesce(trait, F.lit(trait_default)).alias("trait")).agg(F.count(F.lit(1)).alias("_n"))
    total = traits.groupBy("_c").agg(
        F.sum("_n").alias("count"), F.min_by("trait", F.struct(-F.col("_n"), F.col("trait"))).alias("trait"))
    merged = total.select(
        F.concat(F.lit("group_"), "_c").alias("id"), F.concat("_c", F.lit("("), F.col("count").cast("string"), F.lit(")")).alias("label"),
        F.lit("aggregate").alias("type"), "count", "trait")
    rest = nodes.filter(F.col("type") != group_type).select("id", "label", "type", F.lit(1).cast("long").alias("count"), F.col(trait).alias("trait"))
    s = mapped.withColumnsRenamed({"id": "source", "member_of": "_ms"})
    t = mapped.withColumnsRenamed({"id": "target", "member_of": "_mt"})
    moved = (edges.join(s, "source", "left").join(t, "target", "left")
             .select(F.coalesce("_ms", "source").alias("source"), F.coalesce("_mt", "target").alias("target"), "type", "weight")
             .filter(F.col("source") != F.col("target"))
             .groupBy("source", "target").agg(F.min("type").alias("type"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight")))
    return merged.unionByName(rest), moved.select("source", "target", "type", "weight")


def contraction_map(nodes: DataFrame, group_type: str, group_default: str = "other") -> DataFrame:
    """Which super-node every contracted node belongs to: ``id, member_of``."""
    return nodes.filter(F.col("type") == group_type).select(
        "id", F.concat(F.lit("group_"), F.coalesce("category", F.lit(group_default))).alias("member_of"))


def risk_overlay(nodes: DataFrame, edges: DataFrame, risk_edges: DataFrame) -> DataFrame:
    """Shown edges plus the risk edges (``herb_a, herb_b, risk_score``) between shown item nodes."""
    risk = risk_edges.select(
        F.concat(F.lit("item_"), "herb_a").alias("source"), F.concat(F.lit("item_"), "herb_b").alias("target"),
        F.lit("has_risk_with").alias("type"), F.col("risk_score").alias("weight"), F.lit(None).cast("long").alias("count"))
    return edges.unionByName(edges_among(risk, nodes))


#: Rows of a stored adjacency that one bucket should hold.
BUCKET_EDGES = 1_000_000


def store_adjacency(edges: DataFrame, path: str, rows_per_bucket: int = BUCKET_EDGES) -> int:
    """Write ``edges(source, target, type, ...)`` under either end, in folders per edge type and hash of that end; returns the number of hashes.

    Rows are ``node`` (the end), ``source, target`` and what else the edges hold, repeats dropped. The number of buckets follows the
    counted rows; a bucket of a hot node is written by several tasks (rebalanced by size) in as many files.
    """
    more = [c for c in edges.columns if c not in ("source", "target", "type")]
    ends = dealt(edges, "source", "target").distinct().select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), "source", "target", "type", *more)
    rows = cut_lineage(ends.filter(F.col("node").isNotNull()))
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    rows.withColumn("bucket", _bucket("node", buckets)).hint("rebalance", "type", "bucket").write.partitionBy("type", "bucket").parquet(path)
    return buckets


def _bucket(node, buckets: int):
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def stored_neighbours(spark: SparkSession, path: str, buckets: int, frontier: DataFrame | str, edge_type: str) -> DataFrame:
    """Edges of one type at the nodes of ``frontier(id)``, or at one node, from a stored adjacency of ``buckets``.

    Only the files of the frontier's buckets are read. For one node that is a constant of the plan, and nothing is shuffled; for a
    frontier its distinct buckets (``buckets`` numbers at most) are asked for first.
    """
    stored = spark.read.parquet(path).filter(F.col("type") == edge_type)
    if isinstance(frontier, str):
        return stored.filter((F.col("bucket") == _bucket(F.lit(frontier), buckets)) & (F.col("node") == frontier))
    wanted = frontier.select(F.col("id").alias("node"), _bucket("id", buckets).alias("bucket"))
    touched = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    return stored.filter(F.col("bucket").isin(touched)).join(wanted.hint("shuffle_hash"), ["bucket", "node"], "left_semi")


def expand_stored(nodes: DataFrame, path: str, buckets: int, start: str, start_type: str, hops: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``expand`` over a stored adjacency: the same nodes and edges, but each hop opens the buckets of its frontier alone.

    The frontier of a hop is written before the next one, so its real size decides whether it is broadcast.
    """
    root = f"{start_type}_{start}"
    known = nodes.filter(F.col("id") == root).select("id")
    seen, kept, frontier = known, None, root
    for edge_type in hops:
        step = stored_neighbours(nodes.sparkSession, path, buckets, frontier, edge_type)
        if kept is None:  # a start that is no node has no edges either
            step = step.join(known.withColumnRenamed("id", "node"), "node", "left_semi")
        step = cut_lineage(step.drop("bucket"))
        other = F.when(F.col("node") == F.col("source"), F.col("target")).otherwise(F.col("source"))
        frontier = cut_lineage(step.select(other.alias("id")).distinct())
        seen = seen.union(frontier)
        kept = step if kept is None else kept.unionByName(step)
    return nodes.join(seen.distinct(), "id", "left_semi"), kept.drop("node").distinct()
