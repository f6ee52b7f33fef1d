"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. Weights. A shingle is five lower-cased words; in a document it weighs ``tf * ln(1 + 1 / max(df / N, COMMON))``: its
   count there times an inverse document frequency that is flat below ``COMMON`` (one document in a hundred) - whether a
   text was copied twice or fifty times must not change how alike its copies are - and falls for passages that many share.
   Only shingles above ``COMMON`` need their own weight, and there are at most (mean shingles per document) / ``COMMON`` of
   them, which bounds the broadcast table. They are found by a count-min sketch whose size does not depend on the data (it
   never counts too low, so it misses none) and then counted exactly; both passes read all documents.
2. Signatures. ``BANDS * ROWS`` samples per document; two documents agree in a sample with probability equal to their
   weighted Jaccard similarity. Exact copies are one node from here on.
3. Candidates. Documents that agree in all samples of a band share a bucket. First every member is compared with the
   smallest of its bucket (as many pairs as members), then with a few members of the bucket's largest group, and at last
   those still in different groups with each other by an exact prefix filter: only pairs that share one of their rarest
   shingles. Neither a group of copies nor the users of a common passage are paired out, and no link between
   two groups is lost.
4. Verification by the exact weighted Jaccard similarity of the whole texts, then connected components.
5. Hot groups. Where edited copies are a large share of all rows, what they share is common and weighs less than their edits.
   So two documents are alike as well if their similarity by flat weights (as if no shingle was common) reaches the threshold;
   documents that hold a common shingle are drawn once more by flat weights, into the same buckets.

Recall of a pair at similarity s is ``1 - (1 - s**ROWS)**BANDS``: 0.998 at 0.8, 0.9999 at 0.86.

Defined cases: a text of fewer than five words is one shingle of all of them; a null text or one without a word has no
near-duplicate, not even an equal one; rows that repeat a doc_id are one node; null doc_ids are left out; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage
from .components import components
from .textkit import mix64, seeds, text_slices, weighted_shingles

ROWS, BANDS, THRESHOLD = 4, 12, 0.8
#: Members of a bucket's largest group that the others are compared with in a turn, and turns before all pairs across groups are.
PROBES, TURNS = 4, 1
#: Share of documents above which a shingle has a weight of its own; cells of each of the sketch's two rows.
COMMON, CELLS, CHUNK = 0.01, 1 << 18, 1 << 13
#: Text bytes sampled at once, so that the arrays of a step stay in cache.
SAMPLE_BYTES = 1 << 19

_SEEDS = seeds(ROWS * BANDS, 31)
_CELL_SEEDS = seeds(2, 33)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at (i + 1/2) / n."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_GAMMA = _gamma_quantiles(1 << 16).astype(np.float32)
_LOG_GAMMA = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
_UNIFORM = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def _cells(h: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(mix64(h ^ s) & np.uint64(CELLS - 1)).astype(np.int64) for s in _CELL_SEEDS]


def sketched(texts: DataFrame) -> np.ndarray:
    """Count-min sketch (two rows of cells) of how many rows of ``texts (_text)`` hold a shingle; its size is fixed."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                h, _, _ = weighted_shingles(part.column("_text"))
                for k, at in enumerate(_cells(h)):
                    total[k] += np.bincount(at, minlength=CELLS)
        chunks = total.reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([zlib.compress(chunks[k].tobytes(), 1) for k in used], pa.binary())], names=["chunk", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist()):
                cells = np.frombuffer(zlib.decompress(data), np.int64)
                total[k] = total[k] + cells if k in total else cells
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "cells"])

    parts = texts.mapInArrow(sketch, "chunk int, cells binary").repartition("chunk").mapInArrow(added, "chunk int, cells binary")
    cells = np.zeros((2 * CELLS // CHUNK, CHUNK), np.int64)
    for row in parts.collect():  # 2 * CELLS numbers
        cells[row.chunk] += np.frombuffer(row.cells, np.int64)
    return cells.reshape(2, CELLS)


def common_shingles(docs: DataFrame, text: str, n_docs: int) -> dict[int, int]:
    """Document frequency of every shingle in more than ``COMMON * n_docs`` documents (bounded, see above)."""
    least = COMMON * n_docs
    texts = docs.select(F.col(text).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(sketched(texts) > least)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = sent.value
        for batch in batches:
            seen = []
            for part in text_slices(batch, "_text"):
                h, _, _ = weighted_shingles(part.column("_text"))
                a, b = _cells(h)
                seen.append(h[heavy[0, a] & heavy[1, b]])
            h, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    found = texts.mapInArrow(counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > least)
    return {r.shingle & (2**64 - 1): r.n for r in found.collect()}  # bounded by COMMON


class Weights:
    """Weight of shingles, from the table of common ones."""

    def __init__(self, common: dict[int, int], n_docs: int):
        keys = sorted(common)
        self.keys = np.array(keys, np.uint64)
        self.idf = np.log1p(n_docs / np.array([common[k] for k in keys], np.float64)) if keys else np.zeros(0)
        self.rare = np.log1p(1 / COMMON)

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), self.rare)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            idf = np.where(self.keys[at] == h, self.idf[at], idf)
        return tf * idf

    def flat(self, tf: np.ndarray) -> np.ndarray:
        """What shingles weigh if none is common."""
        return tf * self.rare

    def common(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h


def signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted samples: ``n x (ROWS * BANDS)``, of documents with a shingle."""
    out = np.zeros((n, len(_SEEDS)), np.uint32)
    if not len(h):
        return out
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    log_weight = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFFF)
    with np.errstate(over="ignore"):
        for k, seed in enumerate(_SEEDS):
            z = mix64(h ^ seed)
            r = _GAMMA[z & low]
            beta = _UNIFORM[(z >> np.uint64(32)) & low]
            t = np.floor(log_weight / r + beta)
            a = _LOG_GAMMA[(z >> np.uint64(16)) & low] - r * (t - beta + np.float32(1))
            bits = a.view(np.uint32)
            bits = bits ^ np.where(bits >> 31, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
            name = (z >> np.uint64(32)).astype(np.uint32) + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
            out[doc[first], k] = np.minimum.reduceat(bits.astype(np.uint64) << np.uint64(32) | name, first).astype(np.uint32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name per band."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(seeds(BANDS, 35), (len(signature), BANDS)).copy()
        for k in range(ROWS):
            key = mix64(key ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
    return key


def sampled(docs: DataFrame, weights: Weights, doc_id: str, text: str) -> DataFrame:
    """``doc_id, copy`` (128-bit key of the text) and ``buckets`` of every document that has a word."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text", SAMPLE_BYTES):
                h, doc, tf = weighted_shingles(part.column("_text"))
                weights = sent.value
                keys = band_keys(signatures(h, doc, weights(h, tf), part.num_rows)).view(np.int64)
                has = np.unique(doc)
                # documents with a common shingle are drawn by flat weights as well; for all others that is the same
                twice = np.zeros(part.num_rows, bool)
                twice[doc[weights.common(h)]] = True
                ends = np.cumsum(BANDS * (1 + twice[has]))
                buckets = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
                buckets[(ends - BANDS * (1 + twice[has]))[:, None] + np.arange(BANDS)] = keys[has]
                if twice.any():
                    at = twice[doc]
                    flat = band_keys(signatures(h[at], (np.cumsum(twice) - 1)[doc[at]], weights.flat(tf[at]), int(twice.sum()))).view(np.int64)
                    buckets[(ends[twice[has]] - BANDS)[:, None] + np.arange(BANDS)] = flat
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(buckets))
                has = pa.array(has)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(has), part.column("copy").take(has), lists], names=["doc_id", "copy", "buckets"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("copy"), F.col(text).alias("_text")).filter("doc_id is not null")
    return rows.mapInArrow(run, "doc_id bigint, copy binary, buckets array<bigint>")


def similarities(a: pa.Array, b: pa.Array, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each row, or by flat weights if that is larger."""
    n = len(a)
    ha, ra, ta = weighted_shingles(a)
    hb, rb, tb = weighted_shingles(b)
    h, row, tf = np.concatenate([ha, hb]), np.concatenate([ra, rb]), np.concatenate([ta, tb])
    order = np.lexsort((h, row))
    h, row, tf = h[order], row[order], tf[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    out = np.zeros(n)
    for w in (weights(h, tf), weights.flat(tf)):
        shared = np.bincount(row[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
        total = np.bincount(row, weights=w, minlength=n) - shared
        out = np.maximum(out, np.where(total > 0, shared / np.where(total > 0, total, 1), 0.0))
    return out


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Those of ``pairs (a, b)`` whose texts are alike; ``texts (doc_id, _text)``."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text_a"):
                alike = pa.array(similarities(part.column("text_a"), part.column("text_b"), sent.value) >= threshold)
                yield part.select(["a", "b"]).filter(alike)

    left = texts.select(F.col("doc_id").alias("a"), F.col("_text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("_text").alias("text_b"))
    # texts meet by shuffle at every size: what is small in one corpus is not in the next
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _with_largest(placed: DataFrame, turn: int) -> DataFrame:
    """``a, b``: members of a bucket outside its largest group, each with ``PROBES`` of that group (others each turn)."""
    probes = [F.min_by("doc", F.xxhash64("doc", F.lit(turn * PROBES + k))).alias(f"p{k}") for k in range(PROBES)]
    sizes = placed.groupBy("bucket", "g").agg(F.count(F.lit(1)).alias("n"), *probes)
    largest = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("groups"), F.max_by(F.struct("g", F.array(*[f"p{k}" for k in range(PROBES)]).alias("p")), F.struct("n", -F.col("g"))).alias("c"))
    largest = cut_lineage(largest.filter("groups > 1").select("bucket", F.col("c.g").alias("g0"), F.array_distinct("c.p").alias("p")))
    pairs = placed.join(largest, "bucket").filter("g <> g0").select("doc", F.explode("p").alias("p"))
    return pairs.select(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b")).distinct()


def prefixes(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, rarity: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shingles are in their document's prefix: the rarest ones, until less than ``threshold`` of the weight is left.

    Two documents of that similarity share at least this much of either's weight, so the rarest shingle they share is in
    both prefixes, whatever the (common) order is. Also the weight from each shingle on, and the document's.
    """
    order = np.lexsort((h, rarity, doc))
    first = np.flatnonzero(np.diff(doc[order], prepend=-1))
    total = np.add.reduceat(weight[order], first)
    lengths = np.diff(np.append(first, len(order)))
    before = np.cumsum(weight[order]) - weight[order]
    before -= np.repeat(before[first], lengths)
    total = np.repeat(total, lengths)
    rest, whole = np.zeros(len(h)), np.zeros(len(h))
    rest[order], whole[order] = total - before, total
    return rest >= threshold * whole * (1 - 1e-9), rest, whole


def _across(placed: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """``a, b``: documents of buckets with several groups, in different groups, that share a shingle of their prefixes.

    Exact: no pair at the threshold is left out. Passages that many documents share are last in the order (by a
    sketch of the document frequencies), so documents alike in nothing else do not meet.
    """
    mixed = placed.groupBy("bucket").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 < g1").select("bucket")
    docs = cut_lineage(placed.join(cut_lineage(mixed), "bucket", "left_semi").select(F.col("doc").alias("doc_id"), "g").distinct())
    rows = cut_lineage(texts.join(docs.hint("merge"), "doc_id"))
    sent = placed.sparkSession.sparkContext.broadcast((weights, sketched(rows.select("_text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, cells = sent.value
        for batch in batches:
            for part in text_slices(batch, "_text"):
                h, doc, tf = weighted_shingles(part.column("_text"))
                if len(h):
                    a, b = _cells(h)
                    rarity = np.minimum(cells[0, a], cells[1, b])
                    by_idf, rest, whole = prefixes(h, doc, weigh(h, tf), rarity, threshold)
                    by_count, rest_flat, whole_flat = prefixes(h, doc, weigh.flat(tf), rarity, threshold)
                    at = by_idf | by_count
                    who = pa.array(doc[at])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(who), part.column("g").take(who), pa.array(h[at].view(np.int64)), *(pa.array(x[at]) for x in (rest, whole, rest_flat, whole_flat))],
                                                     names=["doc", "g", "token", "rest", "whole", "rest_flat", "whole_flat"])

    tokens = rows.mapInArrow(run, "doc bigint, g bigint, token bigint, rest double, whole double, rest_flat double, whole_flat double")
    shared = tokens.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 < g1").select("token")
    left = cut_lineage(tokens.join(shared, "token", "left_semi"))
    right = left.select("token", *(F.col(c).alias(f"{c}2") for c in left.columns if c != "token"))
    # from the rarest shared shingle on, both must hold what two documents of that similarity share, by either weights
    enough = F.lit(False)
    for rest, whole in (("rest", "whole"), ("rest_flat", "whole_flat")):
        enough |= F.least(rest, f"{rest}2") * (1 + threshold) >= threshold * (1 - 1e-9) * (F.col(whole) + F.col(f"{whole}2"))
    return left.join(right, "token").filter((F.col("g") < F.col("g2")) & enough).select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id`` of every document: the smallest doc_id of its group of near-duplicates (itself if alone)."""
    n_docs = docs.count()
    weights = Weights(common_shingles(docs, text, n_docs), n_docs)
    drawn = cut_lineage(sampled(docs, weights, doc_id, text))
    copies = cut_lineage(drawn.groupBy("copy").agg(F.min("doc_id").alias("node")))
    nodes = drawn.join(copies, "copy")
    members = nodes.filter("doc_id = node").select(F.explode("buckets").alias("bucket"), F.col("doc_id").alias("doc")).distinct()
    centres = members.groupBy("bucket").agg(F.min("doc").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = cut_lineage(members.join(cut_lineage(centres), "bucket"))

    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    texts = cut_lineage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).join(wanted.hint("merge"), "doc_id", "left_semi"))
    tried = cut_lineage(members.filter("a < doc").select("a", F.col("doc").alias("b")).distinct())
    links = cut_lineage(verified(tried, texts, weights, threshold))

    groups = components(links)
    for turn in range(TURNS + 1):
        placed = members.join(groups, members.doc == groups.node, "left").select("bucket", "doc", F.coalesce("component", "doc").alias("g"))
        placed = cut_lineage(placed)
        pairs = _with_largest(placed, turn) if turn < TURNS else _across(placed, texts, weights, threshold)
        pairs = cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"))
        more = cut_lineage(verified(pairs, texts, weights, threshold))
        tried = tried.unionByName(pairs)
        if not more.isEmpty():
            groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    found = nodes.withColumnRenamed("node", "rep").join(groups, F.col("rep") == F.col("node"), "left")
    classes = found.select("doc_id", F.coalesce("component", "rep").alias("class_id")).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return ids.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
