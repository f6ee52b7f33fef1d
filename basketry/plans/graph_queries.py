"""Property-graph views, communities and link prediction over the co-occurrence graph of part names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.lineage import checkpoint_dir, cut_lineage
from ..operators import communities as C, graph as G, links as L, rows as R
from ..sources import tables as S
from . import bindings as Bd
from .catalog import Tables, query, with_ctes

LABELS = ("labels_dim", "SELECT DISTINCT o_orderpriority AS name FROM orders")
NODES = ("nodes", "SELECT 'item_' || name AS id, name AS label, 'item' AS type, CAST(NULL AS DOUBLE) AS size FROM items UNION ALL "
                  "SELECT 'basket_' || CAST(basket_id AS VARCHAR), CAST(basket_id AS VARCHAR), 'basket', frequency FROM baskets UNION ALL "
                  "SELECT 'label_' || name, name, 'label', NULL FROM labels_dim")
LINKS = ("links", "SELECT 'basket_' || CAST(basket_id AS VARCHAR) AS source, 'item_' || item AS target, 'contains' AS type FROM bi UNION ALL "
                  "SELECT 'basket_' || CAST(basket_id AS VARCHAR), 'label_' || label, 'treats' FROM baskets")
PROPERTY_GRAPH = (Bd.BI, Bd.BASKETS, Bd.ITEMS, LABELS, NODES, LINKS)


def _baskets(t: Tables) -> DataFrame:
    return Bd.baskets(t).withColumn("name", F.col("basket_id").cast("string"))


def _labels(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("name")).distinct()


def _nodes(t: Tables) -> DataFrame:
    return G.build_nodes(Bd.items(t), _baskets(t), _labels(t), ["nature", "category"], ["period", "status"])


def _edges(t: Tables) -> DataFrame:
    return G.build_edges(Bd.basket_items(t), Bd.basket_labels(t), Bd.items(t), _baskets(t), _labels(t))


@query("graph_nodes", with_ctes(*PROPERTY_GRAPH, body=(
    "SELECT nodes.id, nodes.label, nodes.type, nodes.size, coalesce(items.nature, '') AS nature, coalesce(CAST(baskets.period AS VARCHAR), '') AS period "
    "FROM nodes LEFT JOIN items ON nodes.id = 'item_' || items.name LEFT JOIN baskets ON nodes.id = 'basket_' || CAST(basket_id AS VARCHAR)")))
def graph_nodes(t: Tables) -> DataFrame:
    p = F.col("properties")
    return _nodes(t).select("id", "label", "type", "size", F.coalesce(p["nature"], F.lit("")).alias("nature"), F.coalesce(p["period"], F.lit("")).alias("period"))


@query("graph_edges", with_ctes(*PROPERTY_GRAPH, body="SELECT source, target, type FROM links"))
def graph_edges(t: Tables) -> DataFrame:
    return _edges(t).select("source", "target", "type")


@query("graph_export", with_ctes(*PROPERTY_GRAPH, body=(
    "SELECT source, target, type, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM links) AS n_edges FROM links")))
def graph_export(t: Tables) -> DataFrame:
    """Nodes, edges and totals written as JSON lines; the edges and both totals read back from the files."""
    path = f"{checkpoint_dir(t.spark)}/graph-{uuid.uuid4().hex}"
    S.export_graph(_nodes(t), _edges(t), path)
    totals = S.load_table(t.spark, f"{path}/totals", T.StructType([T.StructField("kind", T.StringType()), T.StructField("total", T.LongType())]), "json")
    edges = S.load_table(t.spark, f"{path}/edges", T.StructType([T.StructField(c, T.StringType()) for c in ("source", "target", "type")]), "json")
    return edges.select("*", *[totals.filter(F.col("kind") == k).select("total").scalar().alias(f"n_{k}") for k in ("nodes", "edges")])


@query("graph_stats", with_ctes(*PROPERTY_GRAPH, body=(
    "SELECT 'node' AS kind, type, count(*) AS count FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM links GROUP BY type")))
def graph_stats(t: Tables) -> DataFrame:
    return G.graph_stats(_nodes(t), _edges(t))


SHOWN = ("shown", "SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY type ORDER BY size DESC NULLS LAST, label) <= 30")


@query("node_set_edges", with_ctes(*PROPERTY_GRAPH, SHOWN, body=(
    "SELECT source, target, type FROM links WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)")))
def node_set_edges(t: Tables) -> DataFrame:
    shown = R.top_k_per_group(_nodes(t), ["type"], [F.desc_nulls_last("size"), F.asc("label")], 30)
    return G.edges_among(_edges(t), shown).select("source", "target", "type")


@query("network_view_edges", with_ctes(*PROPERTY_GRAPH, Bd.CO, SHOWN, body=(
    "SELECT source, target, type, CAST(NULL AS DOUBLE) AS weight FROM links WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown) "
    "UNION ALL (SELECT 'item_' || item_a, 'item_' || item_b, 'co_occurs', weight FROM co WHERE 'item_' || item_a IN (SELECT id FROM shown) "
    "AND 'item_' || item_b IN (SELECT id FROM shown) ORDER BY weight DESC, item_a, item_b LIMIT 40)")))
def network_view_edges(t: Tables) -> DataFrame:
    co = G.co_occurrence_edges(Bd.co_occurrence(t).withColumn("weight", F.round("weight", 2)))
    _, edges = G.network_view(_nodes(t), _edges(t).unionByName(co), 30, 40)
    return edges.select("source", "target", "type", "weight")


@query("network_view_nodes", with_ctes(*PROPERTY_GRAPH, SHOWN, body="SELECT id, label, type, size FROM shown"))
def network_view_nodes(t: Tables) -> DataFrame:
    nodes, _ = G.network_view(_nodes(t), _edges(t), 30, 40)
    return nodes.select("id", "label", "type", "size")


@query("co_occurrence_list", with_ctes(Bd.BI, Bd.BASKETS, Bd.CO, body=(
    "SELECT item_a, item_b, count, weight FROM co WHERE count >= 5 ORDER BY weight DESC, item_a, item_b LIMIT 100")))
def co_occurrence_list(t: Tables) -> DataFrame:
    return G.co_occurrence_list(Bd.co_occurrence(t).withColumn("weight", F.round("weight", 2)), 5, 100)


@query("edge_threshold", with_ctes(*Bd.GRAPH, body="SELECT src, dst, weight, count FROM edges"))
def edge_threshold(t: Tables) -> DataFrame:
    return Bd.graph_edges(t)


def _expand_sql(start: str, first: str, second: str | None) -> str:
    """Edges on the paths start -first-> . -second-> . (basket is always the source side)."""
    parts = [("e1", f"SELECT * FROM links WHERE type = '{first}' AND (source = '{start}' OR target = '{start}')")]
    body = "SELECT * FROM e1"
    if second:
        parts.append(("e2", f"SELECT * FROM links WHERE type = '{second}' AND source IN (SELECT source FROM e1)"))
        body += " UNION SELECT * FROM e2"
    return with_ctes(*PROPERTY_GRAPH, *parts, body=f"SELECT source, target, type FROM ({body})")


@query("subgraph_from_label", _expand_sql("label_1-URGENT", "treats", "contains"))
def subgraph_from_label(t: Tables) -> DataFrame:
    return G.subgraph_from_label(_nodes(t), _edges(t), "1-URGENT")[1].select("source", "target", "type")


@query("subgraph_from_item", _expand_sql("item_red ring", "contains", "treats"))
def subgraph_from_item(t: Tables) -> DataFrame:
    return G.subgraph_from_item(_nodes(t), _edges(t), "red ring")[1].select("source", "target", "type")


@query("subgraph_from_basket", with_ctes(*PROPERTY_GRAPH, body=(
    "SELECT id, label, type FROM nodes WHERE id = 'basket_77' OR id IN (SELECT target FROM links WHERE source = 'basket_77')")))
def subgraph_from_basket(t: Tables) -> DataFrame:
    return G.subgraph_from_basket(_nodes(t), _edges(t), "77")[0].select("id", "label", "type")


def _stored(t: Tables) -> tuple[str, int]:
    path = f"{checkpoint_dir(t.spark)}/adjacency-{uuid.uuid4().hex}"
    return path, G.store_adjacency(_edges(t).select("source", "target", "type"), path)


@query("stored_subgraph_from_label", _expand_sql("label_1-URGENT", "treats", "contains"))
def stored_subgraph_from_label(t: Tables) -> DataFrame:
    """The label's subgraph from edges stored in buckets by either end."""
    return G.expand_stored(_nodes(t), *_stored(t), "1-URGENT", "label", ["treats", "contains"])[1].select("source", "target", "type")


@query("stored_subgraph_from_item", _expand_sql("item_red ring", "contains", "treats"))
def stored_subgraph_from_item(t: Tables) -> DataFrame:
    """The item's subgraph from edges stored in buckets by either end."""
    return G.expand_stored(_nodes(t), *_stored(t), "red ring", "item", ["contains", "treats"])[1].select("source", "target", "type")


@query("node_degrees", with_ctes(*Bd.GRAPH, body="SELECT u AS node, count(*) AS degree, round(sum(w), 2) AS weighted_degree FROM sym GROUP BY u"))
def node_degrees(t: Tables) -> DataFrame:
    return G.degrees(Bd.graph_edges(t)).withColumn("weighted_degree", F.round("weighted_degree", 2))


PART = ("part_of", "SELECT name AS node, category AS community FROM items")


def _categories(t: Tables) -> DataFrame:
    return Bd.items(t).select(F.col("name").alias("node"), F.col("category").alias("community"))


@query("partition_modularity", with_ctes(*Bd.GRAPH, Bd.ITEMS, PART, (
    "inside", "SELECT sum(CASE WHEN a.community = b.community THEN weight ELSE 0 END) AS i, sum(weight) AS m FROM edges JOIN part_of a ON a.node = src JOIN part_of b ON b.node = dst"),
    ("tot", "SELECT community, sum(w) AS s FROM sym JOIN part_of ON node = u GROUP BY community"), body=(
    "SELECT round(any_value(i / m) - 1.5 * sum((s / (2 * m)) * (s / (2 * m))), 8) AS modularity FROM tot CROSS JOIN inside")))
def partition_modularity(t: Tables) -> DataFrame:
    return G.modularity(Bd.graph_edges(t), _categories(t), 1.5).select(F.round("modularity", 8).alias("modularity"))


@query("community_members", with_ctes(*Bd.GRAPH, Bd.ITEMS, PART, body=(
    "SELECT community, count(*) OVER (PARTITION BY community) AS size, part_of.node, coalesce(degree, 0) AS degree FROM part_of LEFT JOIN deg ON deg.node = part_of.node")))
def community_members(t: Tables) -> DataFrame:
    return G.community_members(Bd.graph_edges(t), _categories(t))


@query("node_membership", with_ctes(Bd.ITEMS, body=(
    "SELECT word AS node, max(category) AS community, max(category) IS NOT NULL AS known FROM (SELECT DISTINCT p_name AS word FROM part UNION SELECT DISTINCT p_type FROM part) "
    "LEFT JOIN items ON items.name = word GROUP BY word")))
def node_membership(t: Tables) -> DataFrame:
    asked = t.part.select(F.explode(F.array("p_name", "p_type")).alias("node")).distinct()
    return G.node_community(_categories(t), asked).select("node", "community", "known")


@query("community_detail", with_ctes(*Bd.GRAPH, Bd.ITEMS, ("mem", "SELECT name AS node, nature FROM items WHERE category = 'red'"), (
    "inn", "SELECT * FROM edges WHERE src IN (SELECT node FROM mem) AND dst IN (SELECT node FROM mem)"),
    ("d", "SELECT node, count(*) AS c, sum(weight) AS w FROM (SELECT src AS node, weight FROM inn UNION ALL SELECT dst, weight FROM inn) GROUP BY node"), body=(
    "SELECT mem.node, coalesce(c, 0) AS inner_degree, round(coalesce(w, 0), 2) AS inner_weight, nature FROM mem LEFT JOIN d ON d.node = mem.node")))
def community_detail(t: Tables) -> DataFrame:
    members, _ = G.community_detail(Bd.graph_edges(t), _categories(t), "red", Bd.items(t), ["nature"])
    return members.withColumn("inner_weight", F.round("inner_weight", 2))


CONTRACT = (*PROPERTY_GRAPH, ("m", "SELECT 'item_' || name AS id, 'group_' || category AS g FROM items"))


@query("contracted_edges", with_ctes(*CONTRACT, ("moved", (
    "SELECT coalesce(a.g, source) AS source, coalesce(b.g, target) AS target, links.type FROM links "
    "LEFT JOIN m a ON a.id = source LEFT JOIN m b ON b.id = target")), body=(
    "SELECT source, target, min(type) AS type, CAST(count(*) AS DOUBLE) AS weight FROM moved WHERE source <> target GROUP BY 1, 2")))
def contracted_edges(t: Tables) -> DataFrame:
    return G.contract_graph(_contractible(t), _edges(t), "item")[1]


def _contractible(t: Tables) -> DataFrame:
    p = F.col("properties")
    return _nodes(t).select("id", "label", "type", p["category"].alias("category"), p["nature"].alias("nature"))


@query("contracted_nodes", with_ctes(*CONTRACT, (
    "nat", "SELECT category, nature, count(*) AS n FROM items GROUP BY 1, 2"), body=(
    "SELECT 'group_' || category AS id, category || '(' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || ')' AS label, 'aggregate' AS type, CAST(sum(n) AS BIGINT) AS count, "
    "(SELECT nature FROM nat x WHERE x.category = nat.category ORDER BY n DESC, nature LIMIT 1) AS trait FROM nat GROUP BY category "
    "UNION ALL SELECT id, label, type, 1, NULL FROM nodes WHERE type <> 'item'")))
def contracted_nodes(t: Tables) -> DataFrame:
    return G.contract_graph(_contractible(t), _edges(t), "item")[0]


@query("louvain_communities")
def louvain_communities(t: Tables) -> DataFrame:
    edges = Bd.graph_edges(t)
    return G.community_members(edges, C.louvain(edges, 1.0))


@query("louvain_modularity")
def louvain_modularity(t: Tables) -> DataFrame:
    edges = Bd.graph_edges(t)
    found = cut_lineage(C.louvain(edges, 1.0))
    start = G.modularity(edges, C._singletons(edges)).scalar()
    return G.modularity(edges, found).select("modularity", start.alias("start_modularity"), found.agg(F.count_distinct("community")).scalar().alias("communities"))


@query("louvain_refined")
def louvain_refined(t: Tables) -> DataFrame:
    edges = Bd.graph_edges(t)
    return C.refine(edges, _categories(t).join(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi"))


@query("louvain_incremental")
def louvain_incremental(t: Tables) -> DataFrame:
    """Communities of the graph of half the edges, carried over to the whole graph; nodes that gained an edge start alone."""
    edges = Bd.graph_edges(t)
    previous = C.louvain(edges.filter(F.col("count") % 2 == 0))
    changed = edges.filter(F.col("count") % 2 == 1).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return C.louvain_incremental(edges, previous, changed)


# --- link prediction ----------------------------------------------------------------------------------------

TWO_HOP = ("hop", "SELECT x.v AS a, y.v AS b, count(*) AS cn, sum(CASE WHEN degree > 1 THEN 1 / ln(degree) ELSE 0 END) AS aa, sum(1.0 / degree) AS ra "
                  "FROM sym x JOIN sym y ON x.u = y.u AND x.v < y.v JOIN deg ON deg.node = x.u GROUP BY 1, 2")
SCORED = ("scored", "SELECT hop.*, cn / (da.degree + db.degree - cn) AS jac, da.degree AS dga, db.degree AS dgb FROM hop JOIN deg da ON da.node = a JOIN deg db ON db.node = b "
                    "WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = a AND dst = b)")


@query("neighbour_scores", with_ctes(*Bd.GRAPH, TWO_HOP, SCORED, body=(
    "SELECT a AS item_a, b AS item_b, cn AS common_neighbors, round(jac, 6) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6) AS resource_allocation FROM scored")))
def neighbour_scores(t: Tables) -> DataFrame:
    return L.neighbour_scores(Bd.graph_edges(t)).select(
        "item_a", "item_b", "common_neighbors", *[F.round(c, 6).alias(c) for c in ("jaccard", "adamic_adar", "resource_allocation")])


def _link_sql(score: str, method: str, n: int = 50) -> str:
    return with_ctes(*Bd.GRAPH, TWO_HOP, SCORED, body=(
        f"SELECT a AS item_a, b AS item_b, round({score}, 6) AS score, '{method}' AS method FROM scored ORDER BY round({score}, 6) DESC, a, b LIMIT {n}"))


def _predict(t: Tables, method: str, n: int = 50) -> DataFrame:
    """Scores rounded before ranking, so that ties (and only ties) are ordered by name on both sides."""
    scored = L.neighbour_scores(Bd.graph_edges(t)).select("item_a", "item_b", F.round(F.col(method).cast("double"), 6).alias("score"))
    return R.top_k(scored, [F.desc("score"), F.asc("item_a"), F.asc("item_b")], n).withColumn("method", F.lit(method))


@query("links_common_neighbors", _link_sql("CAST(cn AS DOUBLE)", "common_neighbors"))
def links_common_neighbors(t: Tables) -> DataFrame:
    return L.predict_links(Bd.graph_edges(t), "common_neighbors")


@query("links_jaccard", _link_sql("jac", "jaccard"))
def links_jaccard(t: Tables) -> DataFrame:
    return _predict(t, "jaccard")


@query("links_adamic_adar", _link_sql("aa", "adamic_adar"))
def links_adamic_adar(t: Tables) -> DataFrame:
    return _predict(t, "adamic_adar")


@query("links_resource_allocation", _link_sql("ra", "resource_allocation"))
def links_resource_allocation(t: Tables) -> DataFrame:
    return _predict(t, "resource_allocation")


@query("top_links_common_neighbors", _link_sql("CAST(cn AS DOUBLE)", "common_neighbors"))
def top_links_common_neighbors(t: Tables) -> DataFrame:
    return L.top_links(Bd.graph_edges(t), "common_neighbors", digits=6)


@query("top_links_adamic_adar", _link_sql("aa", "adamic_adar"))
def top_links_adamic_adar(t: Tables) -> DataFrame:
    return L.top_links(Bd.graph_edges(t), "adamic_adar", digits=6)


@query("top_links_resource_allocation", _link_sql("ra", "resource_allocation", 10))
def top_links_resource_allocation(t: Tables) -> DataFrame:
    return L.top_links(Bd.graph_edges(t), "resource_allocation", 10, digits=6)


@query("links_preferential_attachment", with_ctes(*Bd.GRAPH, body=(
    "SELECT a.node AS item_a, b.node AS item_b, CAST(a.degree * b.degree AS DOUBLE) AS score, 'preferential_attachment' AS method FROM deg a JOIN deg b ON a.node < b.node "
    "WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = a.node AND dst = b.node) ORDER BY score DESC, 1, 2 LIMIT 50")))
def links_preferential_attachment(t: Tables) -> DataFrame:
    return L.predict_links(Bd.graph_edges(t), "preferential_attachment")


@query("links_with_zero_scores", with_ctes(*Bd.GRAPH, TWO_HOP, body=(
    "SELECT a.node AS item_a, b.node AS item_b, CAST(coalesce(cn, 0) AS DOUBLE) AS score, 'common_neighbors' AS method FROM deg a JOIN deg b ON a.node < b.node "
    "LEFT JOIN hop ON hop.a = a.node AND hop.b = b.node WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = a.node AND dst = b.node) ORDER BY score DESC, 1, 2 LIMIT 3000")))
def links_with_zero_scores(t: Tables) -> DataFrame:
    return L.predict_links(Bd.graph_edges(t), "common_neighbors", 3000, include_zero=True)


@query("links_katz", with_ctes(*Bd.GRAPH, (
    "w2", "SELECT x.u, y.v, count(*) AS n FROM sym x JOIN sym y ON x.v = y.u GROUP BY 1, 2"),
    ("w3", "SELECT w2.u, y.v, sum(n) AS n FROM w2 JOIN sym y ON w2.v = y.u GROUP BY 1, 2"),
    ("s", "SELECT u, v, n * 0.000001 AS s FROM w2 UNION ALL SELECT u, v, n * 0.000000001 FROM w3"), body=(
    "SELECT u AS item_a, v AS item_b, round(CAST(sum(s) AS DOUBLE), 9) AS score FROM s WHERE u < v AND NOT EXISTS (SELECT 1 FROM edges WHERE src = u AND dst = v) GROUP BY 1, 2")))
def links_katz(t: Tables) -> DataFrame:
    return L.katz(Bd.graph_edges(t)).withColumn("score", F.round("score", 9))


TSIM = (("tn", "SELECT item, count(*) AS n FROM targets GROUP BY item"), (
    "sim", "SELECT x.item AS a, y.item AS b, count(*) AS ct, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS sim FROM targets x JOIN targets y ON x.target = y.target AND x.item < y.item "
           "JOIN tn p ON p.item = x.item JOIN tn q ON q.item = y.item GROUP BY 1, 2"))


@query("target_similarity", with_ctes(Bd.TARGETS, *TSIM, body="SELECT a AS item_a, b AS item_b, ct AS common_targets, round(sim, 6) AS target_similarity FROM sim"))
def target_similarity(t: Tables) -> DataFrame:
    return L.target_similarity(Bd.item_targets(t)).withColumn("target_similarity", F.round("target_similarity", 6))


@query("links_with_targets", with_ctes(*Bd.GRAPH, Bd.TARGETS, TWO_HOP, SCORED, *TSIM, (
    "sim2", "SELECT * FROM sim WHERE a IN (SELECT node FROM deg) AND b IN (SELECT node FROM deg) AND NOT EXISTS (SELECT 1 FROM edges WHERE src = a AND dst = b)"), body=(
    "SELECT coalesce(s.a, k.a) AS item_a, coalesce(s.b, k.b) AS item_b, round(0.4 * coalesce(aa, 0) + 0.3 * coalesce(jac, 0) + 0.3 * coalesce(sim, 0), 6) AS score, "
    "round(coalesce(aa, 0), 6) AS adamic_adar, round(coalesce(jac, 0), 6) AS jaccard, round(coalesce(sim, 0), 6) AS target_similarity, coalesce(ct, 0) AS common_targets "
    "FROM scored s FULL JOIN sim2 k ON s.a = k.a AND s.b = k.b")))
def links_with_targets(t: Tables) -> DataFrame:
    out = L.combined_scores(Bd.graph_edges(t), Bd.item_targets(t))
    return out.select("item_a", "item_b", *[F.round(c, 6).alias(c) for c in ("score", "adamic_adar", "jaccard", "target_similarity")], "common_targets")


@query("items_for_target", with_ctes(Bd.ITEMS, Bd.TARGETS, ("best", "SELECT target FROM targets GROUP BY target ORDER BY count(*) DESC, target LIMIT 1"), body=(
    "SELECT item, category, nature, target, affinity, effect_type FROM targets JOIN items ON items.name = targets.item WHERE target = 'Brand#10/7' ORDER BY affinity DESC, item LIMIT 20")))
def items_for_target(t: Tables) -> DataFrame:
    return L.items_for_target(Bd.item_targets(t), Bd.items(t), "Brand#10/7", 20)


@query("pair_detail", with_ctes(*Bd.GRAPH, Bd.ITEMS, Bd.TARGETS, TWO_HOP, (
    "fl", "SELECT basket_id, max(CASE WHEN item = 'red ring' THEN 1 ELSE 0 END) AS a, max(CASE WHEN item = 'small ring' THEN 1 ELSE 0 END) AS b FROM bi GROUP BY basket_id"),
    ("s", "SELECT count(*) AS total, CAST(sum(a) AS BIGINT) AS ca, CAST(sum(b) AS BIGINT) AS cb, CAST(sum(a * b) AS BIGINT) AS cab FROM fl"),
    ("tg", "SELECT target, max(CASE WHEN item = 'red ring' THEN 1 ELSE 0 END) AS a, max(CASE WHEN item = 'small ring' THEN 1 ELSE 0 END) AS b FROM targets WHERE item IN ('red ring', 'small ring') GROUP BY target"), body=(
    "SELECT ca AS count_a, cb AS count_b, cab AS count_ab, round(cab / total, 6) AS support, (SELECT CAST(sum(a) AS BIGINT) FROM tg) AS targets_a, (SELECT CAST(sum(b) AS BIGINT) FROM tg) AS targets_b, "
    "(SELECT CAST(sum(a * b) AS BIGINT) FROM tg) AS common_target_count, round((SELECT sum(a * b) / count(*) FROM tg), 6) AS target_similarity, "
    "(SELECT count(*) > 0 FROM edges WHERE src = 'red ring' AND dst = 'small ring') AS is_known_pair, "
    "CASE WHEN (SELECT count(*) FROM edges WHERE src = 'red ring' AND dst = 'small ring') > 0 THEN 0 ELSE round(coalesce((SELECT aa FROM hop WHERE a = 'red ring' AND b = 'small ring'), 0), 6) END AS prediction_score, "
    "(SELECT category FROM items WHERE name = 'red ring') AS category_a, (SELECT nature FROM items WHERE name = 'small ring') AS nature_b FROM s")))
def pair_detail(t: Tables) -> DataFrame:
    out = L.pair_detail(Bd.basket_items(t), Bd.baskets(t), Bd.items(t), Bd.item_targets(t), Bd.graph_edges(t), "red ring", "small ring", min_count=1)["summary"]
    return out.select("count_a", "count_b", "count_ab", F.round("support", 6).alias("support"), "targets_a", "targets_b", "common_target_count",
                      F.round("target_similarity", 6).alias("target_similarity"), "is_known_pair", F.round("prediction_score", 6).alias("prediction_score"),
                      "category_a", "nature_b")
