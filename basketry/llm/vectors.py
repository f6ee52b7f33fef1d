"""Near-duplicate vectors by collision-counting projections.

1. Vectors are scaled to length one; those that are null, zero or not finite, of another length than ``dimension`` or without
   a label link with nothing. Equal directions (same bytes of the scaled vector) of a label are one node with a count.
2. Each node is projected on ``LINES`` random lines. On each line a pair collides when its two values differ by at most the
   half-width of the window centred on the query's value. At cosine c the difference is normal with variance 2 - 2c, so the
   number of collisions of a pair at the threshold is binomial; a pair is verified from the largest count on that loses
   at most ``LOSS`` of such pairs.
3. Blocks. A label is cut into blocks of at most ``BLOCK`` nodes (as many as its size needs), and each pair of blocks is
   its own task: a hot label is more tasks, not a longer one. In a task every projection of the block is sorted, the
   window of each query is a range of ranks of that order, and collisions are counted per pair by testing ranks.
   Only pairs that pass the count are verified, by cosine in double precision. What leaves the task is a row per node: how
   many vectors it links with here, and the smallest node it is joined to; never the links themselves.
4. Counts are added up over the tasks, and components are found over the nodes' joins.

Comparing all vectors of a label is quadratic in the label by its contract; what grows with the square here is the tasks'
arithmetic, never a table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage
from .components import components

#: Lines, half-width of the window in standard deviations of the difference at the threshold, pairs at the threshold lost at most.
LINES, WIDTH, LOSS = 64, 1.0, 1e-6
THRESHOLD, BLOCK, SEED = 0.93, 1024, 11
#: Queries whose collisions are counted together.
QUERIES = 64


def least_collisions(lines: int = LINES, width: float = WIDTH, loss: float = LOSS) -> int:
    """Largest count that a pair at the threshold misses with probability ``loss`` at most."""
    p = math.erf(width / math.sqrt(2))
    below, k = 0.0, 0
    while True:
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > loss:
            return k
        k += 1


def lines_for(dimension: int, lines: int = LINES) -> np.ndarray:
    """Random lines, the same in every task: independent normal coordinates."""
    return np.random.default_rng(SEED).standard_normal((dimension, lines))


def colliding(query: np.ndarray, base: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, base) with at least ``least`` window collisions, from their projections (rows x lines)."""
    n, m = len(query), len(base)
    count = np.zeros((n, m), np.uint8)
    ranks, low, span = np.empty((query.shape[1], m), np.uint16), np.empty(query.T.shape, np.uint16), np.empty(query.T.shape, np.uint16)
    for line in range(query.shape[1]):
        order = np.argsort(base[:, line])
        values = base[order, line]
        ranks[line, order] = np.arange(m)
        low[line] = np.searchsorted(values, query[:, line] - half, side="left")
        span[line] = np.searchsorted(values, query[:, line] + half, side="right") - low[line]
    # a query's window is a range of the sorted line: a rank is inside if, counted from where the window opens, it is below the
    # window's length (what lies before wraps round to large numbers). A few queries at once keep the arrays in cache.
    for k in range(0, n, QUERIES):
        part = count[k:k + QUERIES]
        for line in range(query.shape[1]):
            part += (ranks[line] - low[line, k:k + QUERIES, None] < span[line, k:k + QUERIES, None]).view(np.uint8)
    return np.nonzero(count >= least)


def joined(a: np.ndarray, b: np.ndarray, copies_a: np.ndarray, copies_b: np.ndarray) -> list[np.ndarray]:
    """Links of a task as one row per node: the node, the smallest node it is joined to here, and vectors linked to it here."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    degree = np.bincount(u, weights=copies_b, minlength=len(nodes)) + np.bincount(v, weights=copies_a, minlength=len(nodes))
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            return [nodes, nodes[root], degree.astype(np.int64)]
        root = new


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Defined cases: rows that repeat a vec_id are vectors of their own until the end, where their links are added and the smaller component is
    reported once; null vec_ids are left out; vectors of different lengths never link; other columns are ignored.
    """
    half = WIDTH * math.sqrt(2 - 2 * threshold)
    least = least_collisions()
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v")).filter("vec_id is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    big = F.array_max(F.transform("v", F.abs))
    usable = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.exists("v", lambda x: x != 0))
    scaled = rows.filter(usable).withColumn("v", F.transform("v", lambda x: x / big)).withColumn("_norm", norm)
    scaled = scaled.withColumn("v", F.transform("v", lambda x: x / F.col("_norm"))).drop("_norm")
    keyed = cut_lineage(scaled.withColumn("key", F.xxhash64("label", "v")))
    nodes = cut_lineage(keyed.groupBy("key", "label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))

    # blocks of each label and length
    sizes = nodes.groupBy("label", F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = nodes.withColumn("d", F.size("v")).join(cut_lineage(sizes), ["label", "d"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    placed = cut_lineage(placed.select("label", "d", "n_blocks", "block", "node", "copies", "v"))
    left = placed.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("n_blocks") - 1)))
    right = placed.withColumn("other", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("other"))))
    columns = ["label", "d", "block", "other", "node", "copies", "v"]

    def compared(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if a.num_rows and b.num_rows:
            d = key[1].as_py()
            x = a.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
            y = b.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
            na, nb = (t.column("node").to_numpy() for t in (a, b))
            ca, cb = (t.column("copies").to_numpy() for t in (a, b))
            axis = lines_for(d)
            i, j = colliding(x @ axis, y @ axis, half, least)
            if key[2].as_py() == key[3].as_py():
                once = na[i] < nb[j]
                i, j = i[once], j[once]
            cosine = np.concatenate([np.einsum("ij,ij->i", x[i[k:k + 65536]], y[j[k:k + 65536]]) for k in range(0, max(len(i), 1), 65536)])
            ok = cosine >= threshold
            i, j = i[ok], j[ok]
            out = joined(na[i], nb[j], ca[i], cb[j])
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["node", "root", "n"])

    by = ["label", "d", "block", "other"]
    links = left.select(columns).groupBy(*by).cogroup(right.select(columns).groupBy(*by)).applyInArrow(compared, "node bigint, root bigint, n bigint")
    links = cut_lineage(links)
    degrees = links.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(degrees, "node", "left").join(groups, "node", "left").select(
        "key", "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = keyed.select("vec_id", "key").join(cut_lineage(known), "key").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").distinct().join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
