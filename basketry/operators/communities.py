"""Louvain community detection as rounds of joins and aggregations over the edge table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.lineage import cut_lineage
from .graph import modularity, symmetric

#: A move, and a round of moves, must raise modularity by more than this (rounding error).
EPSILON = 1e-12
#: Rounds between two looks at the modularity.
CHECK = 10


def _node_weights(sym: DataFrame, loops: DataFrame) -> DataFrame:
    """Weighted degree per node; a self-loop counts twice."""
    parts = sym.select(F.col("u").alias("node"), "w").unionByName(loops.select("node", (2.0 * F.col("w")).alias("w")))
    return parts.groupBy("node").agg(F.sum("w").alias("k"))


def _move_round(sym: DataFrame, state: DataFrame, m2: float, resolution: float, turn, wake: bool) -> DataFrame:
    """One round of moves: every active node whose ``turn`` it is goes to its best neighbouring community.

    ``state`` has ``node, community, k, moved, pending``. Active are the nodes still pending and, with ``wake``, the neighbours of those that moved in
    the round before; only the edges of active nodes are looked at. Half of the nodes have their turn, and of two single nodes only the
    one with the larger id joins the other, so neighbours do not swap for ever. Ties go to the smallest community id, so a
    round is deterministic.
    """
    flagged = state.select("node", "community", "k", F.col("pending").alias("active"))
    if wake:
        movers = state.filter("moved").select(F.col("node").alias("v"))
        woken = sym.join(movers, "v", "left_semi").select(F.col("u").alias("node"), F.lit(True).alias("_woken")).distinct()
        flagged = state.join(woken, "node", "left").select("node", "community", "k", (F.col("pending") | F.coalesce("_woken", F.lit(False))).alias("active"))
    acting = flagged.filter(F.col("active") & turn).drop("active")
    near = state.select(F.col("node").alias("v"), F.col("community").alias("_c"))
    links = sym.withColumnRenamed("u", "node").join(acting, "node").join(near, "v").select("node", "community", "k", "_c", F.col("w").alias("_kin"))
    own = acting.select("node", "community", "k", F.col("community").alias("_c"), F.lit(0.0).alias("_kin"))
    cand = links.unionByName(own).groupBy("node", "community", "k", "_c").agg(F.sum("_kin").alias("_kin"))
    tot = state.groupBy(F.col("community").alias("_c")).agg(F.sum("k").alias("_tot"), F.count(F.lit(1)).alias("_size"))
    stays = F.col("_c") == F.col("community")
    scored = (
        cand.join(tot, "_c")
        .withColumn("_rest", F.col("_tot") - F.when(stays, F.col("k")).otherwise(0.0))
        .withColumn("_gain", F.col("_kin") - resolution * F.col("k") * F.col("_rest") / m2)
    )
    best = scored.groupBy("node", F.col("community").alias("_old")).agg(
        F.max("_gain").alias("_best"),
        F.min_by(F.struct("_c", "_size"), F.struct(-F.col("_gain"), F.col("_c"))).alias("_to"),
        F.max(F.when(stays, F.col("_gain"))).alias("_stay"), F.max(F.when(stays, F.col("_size"))).alias("_own"))
    to = F.col("_to")
    swap = (F.col("_own") == 1) & (to["_size"] == 1) & (to["_c"] > F.col("_old"))
    go = ~swap & (F.col("_best") > F.col("_stay") + EPSILON * m2)
    done = best.select("node", to["_c"].alias("_c"), go.alias("_go"))
    return flagged.join(done, "node", "left").select(
        "node", F.when(F.col("_go"), F.col("_c")).otherwise(F.col("community")).alias("community"), "k", F.coalesce("_go", F.lit(False)).alias("moved"),
        (F.col("active") & F.col("_go").isNull()).alias("pending"))


def _refine(edges: DataFrame, part: DataFrame, resolution: float, active: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Local moves from a partition until no node wants to move; returns the best partition found and its modularity.

    ``edges`` may hold self-loops. A frontier of active nodes is worked off: a node leaves it when it stays where it is, and the neighbours of a node
    that moves enter it. The frontier starts with all nodes, and when it is empty all nodes are looked at once more (the sum
    of a community can change without a neighbour moving), until that moves nothing. With ``active(node)`` it starts with these and their
    neighbours, and ends when it is empty. A round is one written table and one number, observed while it is written;
    every ``CHECK`` rounds the modularity must have risen.
    """
    plain = edges.filter(F.col("src") != F.col("dst"))
    loops = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"), F.col("weight").alias("w"))
    sym = symmetric(plain)
    nodes = cut_lineage(_node_weights(sym, loops))
    m2 = nodes.agg(F.sum("k")).first()[0] or 0.0
    best, best_q = part, modularity(edges, part, resolution).first()[0]
    if m2 == 0:
        return best, best_q
    no, yes = F.lit(False), F.lit(True)
    weighed = part.join(nodes, "node").select("node", "community", "k")
    if active is None:
        state = cut_lineage(weighed.withColumns({"moved": no, "pending": yes}))
        moved, busy = 0, 1
    else:
        marked = weighed.join(active.select("node", yes.alias("_x")).distinct(), "node", "left").withColumn("moved", F.coalesce("_x", no))
        state = cut_lineage(marked.withColumn("pending", F.col("moved")).drop("_x"))
        moved = busy = 0 if state.filter("moved").isEmpty() else 1
    since = 0
    for number in count():
        if busy == 0:
            if since == 0 or active is not None:
                break
            state, since, moved = state.withColumn("pending", yes), 0, 0
        seen = Observation()
        turn = F.pmod(F.xxhash64("node", F.lit(number // 2)), F.lit(2)) == number % 2
        step = _move_round(sym, state, m2, resolution, turn, moved > 0)
        state = cut_lineage(step.observe(seen, F.sum(F.col("moved").cast("long")).alias("n"), F.sum((F.col("moved") | F.col("pending")).cast("long")).alias("busy")))
        moved, busy = seen.get["n"] or 0, seen.get["busy"] or 0
        since += moved
        if number % CHECK == CHECK - 1:
            q = modularity(edges, state, resolution).first()[0]
            if q <= best_q + EPSILON:
                break
            best, best_q = state, q
    q = modularity(edges, state, resolution).first()[0]
    return (state.select("node", "community"), q) if q > best_q + EPSILON else (best.select("node", "community"), best_q)


def _singletons(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.select("node", F.col("node").alias("community"))


def louvain(edges: DataFrame, resolution: float = 1.0, init: DataFrame | None = None) -> DataFrame:
    """Communities of a weighted undirected graph ``edges(src, dst, weight)``: ``node, community``.

    Rounds of local moves, then the communities become nodes and the moves are repeated on the smaller graph until
    modularity stops rising. The result never has a lower modularity than the start. A community is named by
    its smallest node. ``init(node, community)`` starts from a given partition (refinement).
    """
    base = cut_lineage(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    part = _singletons(base) if init is None else init.select("node", "community")
    level_edges, level_part = base, cut_lineage(part)
    result, best_q = level_part, modularity(base, level_part, resolution).first()[0]
    while True:
        level_part, q = _refine(level_edges, level_part, resolution)
        mapped = level_part.select(F.col("node").alias("community"), F.col("community").alias("_up"))
        if result is None or level_edges is base:
            candidate = level_part
        else:
            candidate = result.join(mapped, "community").select("node", F.col("_up").alias("community"))
        if q <= best_q + EPSILON and level_edges is not base:
            break
        result, improved, best_q = cut_lineage(candidate), q > best_q + EPSILON, max(q, best_q)
        if not improved and level_edges is not base:
            break
        s = result.select(F.col("node").alias("src"), F.col("community").alias("_s"))
        d = result.select(F.col("node").alias("dst"), F.col("community").alias("_d"))
        merged = base.join(s, "src").join(d, "dst").groupBy(
            F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst")).agg(F.sum("weight").alias("weight"))
        level_edges = cut_lineage(merged)
        level_part = cut_lineage(_singletons(level_edges))
    return canonical(result)


def canonical(part: DataFrame) -> DataFrame:
    """Name every community by its smallest node."""
    names = part.groupBy("community").agg(F.min("node").alias("_name"))
    return part.join(names, "community").select("node", F.col("_name").alias("community"))


def refine(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Local moves only, from a given partition (the second half of the partitioned form)."""
    base = cut_lineage(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    return canonical(_refine(base, cut_lineage(partition.select("node", "community")), resolution)[0])


def louvain_incremental(edges: DataFrame, previous: DataFrame, changed: DataFrame | None = None, resolution: float = 1.0) -> DataFrame:
    """Continue from ``previous(node, community)`` on a changed graph.

    New nodes and the nodes of ``changed(node)`` start on their own; nodes that left the graph are dropped. Only these nodes, their
    neighbours and the neighbours of nodes that move are looked at: without a change there is no round at all.
    """
    nodes = _singletons(edges).select("node")
    start = nodes.join(previous.select("node", F.col("community").alias("_p")), "node", "left")
    if changed is not None:
        start = start.join(changed.select("node", F.lit(True).alias("_x")).distinct(), "node", "left")
    else:
        start = start.withColumn("_x", F.lit(None).cast("boolean"))
    # a node that restarts must not take the id of a community that others still use, hence the prefix
    own = F.concat(F.lit("\u0000"), F.col("node").cast("string"))
    fresh = F.coalesce("_x", F.lit(False)) | F.col("_p").isNull()
    start = cut_lineage(start.select("node", F.when(fresh, own).otherwise(F.col("_p").cast("string")).alias("community"), fresh.alias("_fresh")))
    base = cut_lineage(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    return canonical(_refine(base, start.select("node", "community"), resolution, start.filter("_fresh").select("node"))[0])
