"""Hard-negative mining: for each anchor and each of its nearest rows of the same label, the best rows of other labels in a score window.

1. Components are scaled and floored to integers, so that scores are integer inner products and the same everywhere.
2. Each vector is cut into segments, coarsely and ever finer (``LEVELS``). For each segment its mean and deviation are stored, times the root
   of its length. The product of two vectors lies, segment by segment, within the product of the means plus or minus the
   product of the deviations, so the sums over the segments are an upper and a lower bound of the score. Each finer level is tighter.
3. Anchors are a stated query set. They are read in blocks of ``ANCHOR_BLOCK`` at most, each block goes over all rows without any shuffle
   of the rows. A task keeps the best ones of each anchor so far; a row is scored only if its bounds, refined level by level, still allow
   it among them and inside the window.
4. Each task returns its best ones per anchor; they are ranked once more over all tasks. First the positives, whose scores
   are the windows, then the negatives in a second pass.

Scores are computed in double precision where all sums stay below 2^53, else in Python's integers; one beyond 64 bits is the nearest
64-bit integer, and a scaled component beyond doubles the nearest double.

Defined cases: rows with a null id, null label, null vector, or a null or non-finite component take no part; of rows that repeat an id
the smallest by (label, vector) takes part, so equal rows count once; vectors of different lengths never meet; ties go to the smaller
id; an anchor without rows of its label has no positive, a negative positive score leaves an empty window; other
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut_lineage

#: Segments of a vector at each level; anchors sent to the tasks at once, anchors bounded at once in a task.
LEVELS, ANCHOR_BLOCK, STEP = (2, 8, 32), 8192, 256
#: Scale of the components, positives per anchor, negatives per positive, window in hundredths of the positive's score.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Rows in a partition of the prepared table.
ROWS = 8192
_EXACT, _LONG = 1 << 53, (1 << 63) - 1


def summaries(v: np.ndarray, levels: tuple[int, ...] = LEVELS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Means and deviations of each segment at each level, both times the root of the segment's length."""
    means, deviations = [], []
    d = v.shape[1]
    for n in levels:
        n = max(min(n, d), 1)
        cuts = np.arange(n) * d // n
        size = np.diff(np.append(cuts, d))
        total = np.add.reduceat(v, cuts, axis=1) if d else np.zeros((len(v), 1))
        squares = np.add.reduceat(v * v, cuts, axis=1) if d else np.zeros((len(v), 1))
        size = np.maximum(size, 1)
        means.append(total / np.sqrt(size))
        deviations.append(np.sqrt(np.maximum(squares - total * total / size, 0)))
    return means, deviations


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors: exact, held within 64 bits."""
    if not len(rows) or np.abs(rows).max(initial=0) * np.abs(anchor).max(initial=0) * rows.shape[1] < _EXACT:
        return (rows @ anchor).astype(np.int64)
    return np.array([max(min(sum(int(x) * int(y) for x, y in zip(r, anchor)), _LONG), -_LONG) for r in rows], np.int64)


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, then rising id."""
    if len(s) > 4 * k:  # sort only what can be among them
        likely = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, ids = s[likely], ids[likely]
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(-s[order], kind="stable")][:k]
    return s[order], ids[order]


class Search:
    """Best rows so far of a block of anchors, over the rows that ``feed`` is given.

    ``windows`` holds, per anchor, one (lowest, highest) score per list to keep; None is one list without limits.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, same_label: bool, k: int, windows: list[list[tuple]] | None = None, levels: tuple[int, ...] = LEVELS):
        self.ids, self.labels, self.v, self.same, self.k = ids, labels, v, same_label, k
        self.levels = levels
        self.means, self.deviations = summaries(v, levels)
        self.windows = windows
        self.found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in (windows[i] if windows else [0])] for i in range(len(ids))]
        self.floor = np.array([min((float(w[0]) for w in ws if w[0] <= w[1]), default=np.inf) for ws in windows] if windows else [-np.inf] * len(ids))
        self.ceiling = np.array([max((float(w[1]) for w in ws if w[0] <= w[1]), default=-np.inf) for ws in windows] if windows else [np.inf] * len(ids))
        self.scored = self.met = 0

    def feed(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        if v.shape[1] != self.v.shape[1] or not len(ids):
            return
        order = np.argsort(labels, kind="stable")
        ids, labels, v = ids[order], labels[order], v[order]
        with np.errstate(over="ignore", invalid="ignore"):
            self._feed(ids, labels, v)

    def _feed(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        means, deviations = summaries(v, self.levels)
        # room for rounding: far above the error of these sums, far below one score on the usual scale
        norm, own = np.sqrt((v * v).sum(axis=1)), np.sqrt((self.v * self.v).sum(axis=1))
        first, last = np.searchsorted(labels, self.labels, side="left"), np.searchsorted(labels, self.labels, side="right")
        for a in range(0, len(self.ids), STEP):
            part = slice(a, a + STEP)
            middle = self.means[0][part] @ means[0].T
            spread = self.deviations[0][part] @ deviations[0].T + 1e-9 * np.outer(own[part], norm)
            allowed = ~((middle + spread < self.floor[part, None]) | (middle - spread > self.ceiling[part, None]))  # a bound beyond doubles rules out nothing
            for i, left in enumerate(allowed, a):
                if self.same:
                    left[:first[i]] = left[last[i]:] = False
                else:
                    left[first[i]:last[i]] = False
                left[ids == self.ids[i]] = False
                self.met += len(left)
                at = np.flatnonzero(left)
                for level in range(1, len(self.levels)):
                    if not len(at):
                        break
                    mid = means[level][at] @ self.means[level][i]
                    far = deviations[level][at] @ self.deviations[level][i] + 1e-9 * own[i] * norm[at]
                    at = at[~((mid + far < self.floor[i]) | (mid - far > self.ceiling[i]))]
                if len(at):
                    self.scored += len(at)
                    self._keep(i, scores(v[at], self.v[i]), ids[at])

    def _keep(self, i: int, s: np.ndarray, ids: np.ndarray) -> None:
        floors = []
        for p, (old_s, old_ids) in enumerate(self.found[i]):
            low, high = self.windows[i][p] if self.windows else (None, None)
            if low is not None and low > high:
                continue
            ok = np.ones(len(s), bool) if low is None else (s >= low) & (s <= high)
            kept = best(np.concatenate([old_s, s[ok]]), np.concatenate([old_ids, ids[ok]]), self.k)
            self.found[i][p] = kept
            full = len(kept[0]) == self.k
            floors.append(float(kept[0][-1]) if full else -np.inf if low is None else float(low))
        low = min(floors, default=np.inf)
        self.floor[i] = low - abs(low) * 1e-12 if np.isfinite(low) else low  # a large integer may round up


def prepared(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, components floored to integers; each id once."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = rows.filter(usable).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_r"))
    largest = F.lit(float(np.finfo(float).max))
    scaled = F.transform("_r.v", lambda x: F.greatest(F.least(x * scale, largest), -largest))
    floored = F.transform(scaled, lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x))  # larger doubles are integers
    return one.select("vec_id", F.col("_r.label").alias("label"), floored.alias("v"))


def _arrays(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of a batch, for each length of vector in it."""
    sizes = np.asarray(pc.list_value_length(table.column("v")))
    for d in np.unique(sizes):
        part = table.filter(pa.array(sizes == d)) if (sizes != d).any() else table
        v = part.column("v")
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, int(d))


def _searched(rows: DataFrame, anchors: pa.Table, same_label: bool, k: int, windows: dict[int, list[tuple]] | None) -> DataFrame:
    """``anchor_id, place, score, id``: each task's best rows of each anchor; ``place`` numbers the windows of the anchor."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, limits = sent.value
        searches = {v.shape[1]: Search(ids, labels, v, same_label, k, [limits.get(int(i), []) for i in ids] if limits is not None else None) for ids, labels, v in _arrays(block)}
        for batch in batches:
            for ids, labels, v in _arrays(batch):
                if v.shape[1] in searches:
                    searches[v.shape[1]].feed(ids, labels, v)
        for s in searches.values():
            out = [(int(s.ids[i]), p, int(x), int(y)) for i, lists in enumerate(s.found) for p, (a, b) in enumerate(lists) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                             names=["anchor_id", "place", "score", "id"])

    return rows.mapInArrow(run, "anchor_id bigint, place int, score bigint, id bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and place over all tasks, numbered from 1."""
    by = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``anchors`` among ``rows``, both ``vec_id, label, v``.

    A negative's score, times 100, lies between ``low`` and ``high`` times the positive's score.
    """
    anchors = cut_lineage(anchors)
    n_blocks = max(-(-anchors.count() * 5 // (4 * ANCHOR_BLOCK)), 1)
    out = None
    for b in range(n_blocks):
        # a block of anchors: bounded by ANCHOR_BLOCK but for the hash's spread
        block = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow()
        near = cut_lineage(_first(_searched(rows, block, True, positives, None), positives).select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        windows: dict[int, list[tuple]] = {}
        for r in sorted(near.collect(), key=lambda r: r.place):  # bounded as the block is
            windows.setdefault(r.anchor_id, []).append((-(-low * r.positive_score // 100), high * r.positive_score // 100))
        far = _first(_searched(rows, block, False, negatives, windows), negatives)
        part = cut_lineage(far.withColumn("place", F.col("place") + 1).join(near, ["anchor_id", "place"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        out = part if out is None else out.unionByName(part)
    return out


def mined(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = 100, moved: int = 7, labels: int = 10) -> DataFrame:
    """Hard negatives of the rows whose id ``every`` divides; before that, rows whose id ``moved`` divides get the next of ``labels`` labels."""
    rows = prepared(vectors, vec_id, embedding, label, SCALE)
    rows = rows.withColumn("label", F.when(F.pmod("vec_id", F.lit(moved)) == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")))
    # partitions follow the rows, so that each task has enough of them to narrow its search
    rows = cut_lineage(rows)
    rows = cut_lineage(rows.coalesce(max(-(-rows.count() // ROWS), 1)))
    return hard_negatives(rows, rows.filter(F.pmod("vec_id", F.lit(every)) == 0))


SQL = """
WITH u AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM u),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 10
"""
