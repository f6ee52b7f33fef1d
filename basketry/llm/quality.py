"""Quality classifier: histogram gradient-boosted trees over document statistics.

1. Statistics. A whole text is described by ``FEATURES``: shares of classes of bytes, lengths of words and lines, how lines end. All are
   counted over slices of a batch in numpy; none depends on the language, the source or the id.
2. Training sample: labelled documents, at most ``SAMPLE_DOCS`` (a documented bound), those of smallest hash of the id. Which ids are
   in it is settled on the ids alone; the documents are scanned once and only texts of the sample are looked at.
3. Trees. Each statistic is cut into ``BINS`` bins at quantiles of the sample. Trees are grown level by level to ``DEPTH``: the
   gradients and second derivatives of the log loss are summed per (node, statistic, bin), and the best cut of each node is
   where the two sides gain most. Small steps of ``TREES`` trees are added up.
4. Scoring. All trees are one set of arrays, complete binary trees of ``DEPTH`` levels: statistic, threshold and leaf value. A batch
   goes down all trees at once, one vectorised step per level. The arrays are broadcast (about 60 KB); documents are not shuffled.

Defined cases: a null text counts as empty and gets a score; labels that are null or whose id is null teach nothing, an id with
labels of both kinds neither; of documents that repeat an id, the smallest statistics are learned once, and each row is scored; without
labels all scores are 0.5, with one kind of label its smoothed share; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut_lineage
from .textkit import text_slices, utf8_buffer, words

#: Labelled documents to learn from at most.
SAMPLE_DOCS = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
#: Weight that holds leaves small, second derivatives that a side of a cut has at least, gain of a cut at least.
RIDGE, LEAST_WEIGHT, LEAST_GAIN = 1.0, 2.0, 1e-6
#: Bytes of text described at once.
SLICE = 1 << 20

#: Classes of bytes whose share of a text is a statistic.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r", "line_feed": b"\n", "stop": b".,;:", "call": b"!?",
    "symbol": b"#$%&*@^~_=+`", "bracket": b"|<>[]{}()/\\", "quote": b"'\"-", "wide": bytes(range(128, 256)), "control": bytes(k for k in range(32) if k not in b"\t\r\n"),
}
FEATURES = (*CLASSES, "log_bytes", "upper_of_letters", "word_mean", "word_deviation", "short_words", "long_words", "line_mean", "words_per_line", "ended_lines", "repeated_bytes", "symbol_ends", "repeated_words", "words_back")
_TABLE = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate(CLASSES.values()):
    _TABLE[list(_bytes)] = _k


def statistics(texts: pa.Array) -> np.ndarray:
    """``FEATURES`` of each text (null: empty), one row per text."""
    data, offsets = utf8_buffer(texts)
    n, size = len(texts), np.diff(offsets)
    filled = np.flatnonzero(size)
    at = offsets[:-1][filled]

    def per_text(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(filled):
            out[filled] = np.add.reduceat(mask, at, dtype=np.int64)
        return out

    kind = _TABLE[data]
    names = list(CLASSES)
    counts = {name: per_text(kind == k) for k, name in enumerate(names)}
    starts, stops, doc = words(data, offsets)
    length = (stops - starts).astype(float)
    n_words = np.bincount(doc, minlength=n)
    total, squares = np.bincount(doc, weights=length, minlength=n), np.bincount(doc, weights=length * length, minlength=n)
    some = np.maximum(n_words, 1)
    mean = total / some
    repeated = np.zeros(len(data), bool)
    repeated[1:] = (data[1:] == data[:-1]) & (kind[1:] != names.index("lower")) & (kind[1:] != names.index("blank"))
    repeated[at] = False
    after_symbol = np.zeros(len(data), bool)  # a blank right after a symbol or a call: words with tails
    after_symbol[1:] = ((kind[:-1] == names.index("symbol")) | (kind[:-1] == names.index("call"))) & (kind[1:] == names.index("blank"))
    after_symbol[at] = False
    ended = np.zeros(len(data), bool)  # line feeds and text ends after a stop or a call
    closing = (data == ord(".")) | (data == ord("!")) | (data == ord("?"))
    ended[:-1] = closing[:-1] & (data[1:] == ord("\n"))
    ended[at + size[filled] - 1] = closing[at + size[filled] - 1]
    # words by length and first letters: shares that equal the word before, or one of the three before that
    key = (stops - starts).astype(np.uint64)
    for j in range(6):
        key = key * np.uint64(257) + np.where(length > j, data[np.minimum(starts + j, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint64)
    equal = np.zeros((2, len(key)), bool)
    for lag in range(1, 5):
        equal[int(lag > 1), lag:] |= (key[lag:] == key[:-lag]) & (doc[lag:] == doc[:-lag])
    lines = counts["line_feed"] + 1
    bytes_ = np.maximum(size, 1)
    extra = [
        np.log1p(size), counts["upper"] / np.maximum(counts["upper"] + counts["lower"], 1), mean, np.sqrt(np.maximum(squares / some - mean * mean, 0)),
        np.bincount(doc[length <= 3], minlength=n) / some, np.bincount(doc[length >= 12], minlength=n) / some, size / lines, n_words / lines, per_text(ended) / lines,
        per_text(repeated) / bytes_, per_text(after_symbol) / np.maximum(counts["blank"], 1), *(np.bincount(doc[e], minlength=n) / some for e in equal),
    ]
    return np.column_stack([*(counts[name] / bytes_ for name in names), *extra])


@dataclass
class Trees:
    """Complete trees of one depth: ``feature, threshold`` of the inner nodes (tree x node) and ``leaf`` values; larger values go right."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        n_trees, inner = self.feature.shape
        out = np.full(len(x), self.base)
        if n_trees:
            node = np.zeros((len(x), n_trees), np.int64)
            tree, row = np.arange(n_trees), np.arange(len(x))[:, None]
            while node[0, 0] < inner if len(node) else False:
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            out += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def grown(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Trees fitted to rows ``x`` and labels ``y`` of 0 and 1; the same for the same rows in the same order."""
    n_features, inner = x.shape[1] if x.ndim == 2 else len(FEATURES), 2**depth - 1
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)])
    flat = binned + np.arange(n_features) * bins
    last_bin = np.array([len(e) for e in edges])
    raw = np.full(len(y), base)
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n_nodes = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (n_features * bins) + flat).ravel()
            g, h = (np.bincount(cell, weights=np.repeat(v, n_features), minlength=n_nodes * n_features * bins).reshape(n_nodes, n_features, bins).cumsum(axis=2) for v in (gradient, weight))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT) | (np.arange(bins) >= last_bin[:, None])] = -np.inf
            choice = gain.reshape(n_nodes, -1).argmax(axis=1)
            feature, cut = choice // bins, choice % bins
            good = gain.reshape(n_nodes, -1)[np.arange(n_nodes), choice] > LEAST_GAIN
            for k in np.flatnonzero(good):
                out.feature[t, first + k], out.threshold[t, first + k] = feature[k], edges[feature[k]][cut[k]]
            at = node - first
            node = 2 * node + 1 + (good[at] & (binned[np.arange(len(y)), feature[at]] > cut[at]))
        g, h = (np.bincount(node - inner, weights=v, minlength=inner + 1) for v in (gradient, weight))
        out.leaf[t] = -rate * g / (h + RIDGE)
        raw += out.leaf[t, node - inner]
    return out


def sample_ids(labelled: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, y``: at most ``limit`` ids of ``labelled (doc_id, y)``, those of smallest hash; ids with two labels are left out."""
    one = labelled.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).filter("y = _y").drop("_y")
    n, space = one.count(), 1 << 40
    if n <= limit:
        return cut_lineage(one)
    # the smallest hashes, a few more than are wanted; where to cut is settled by their counts
    near = one.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(space))).filter(F.col("_h") < int(space * 1.2 * limit / n))
    taken, last = 0, -1
    for r in sorted(near.groupBy("_h").count().collect()):  # about 1.2 x limit numbers
        taken += r["count"]
        if taken > limit:
            break
        last = r["_h"]
    return cut_lineage(near.filter(F.col("_h") <= last).drop("_h"))


def train(docs: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = SAMPLE_DOCS) -> Trees:
    """Trees learned from ``labelled (doc_id, y)``. What reaches the driver is one row of numbers for each document of the sample."""
    sample = sample_ids(labelled, limit)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "doc_id")  # at most ``limit`` ids

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                x = statistics(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = texts.select("doc_id", "y", "_text").mapInArrow(described, f"doc_id {kind}, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    rows = sorted(rows.collect())  # the sums of the fit are taken in this order
    return grown(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))


def predict(docs: DataFrame, trees: Trees, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                score = sent.value.score(statistics(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    schema = ", ".join(f"{c} {docs.schema[k].dataType.simpleString()}" for c, k in zip(names, keep))
    return rows.mapInArrow(run, f"{schema}, score double").withColumnsRenamed(dict(zip(names, keep)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: a third of all, by the CRC-32 of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents, learned from ``labels (doc_id, quality)`` outside the held-out third."""
    labelled = labels.filter(~held_out()).select("doc_id", F.col("quality").cast("int").alias("y")).filter("y in (0, 1)")
    return predict(docs, train(docs, labelled)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
