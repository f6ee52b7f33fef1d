"""Language identification with language-bitmask n-gram filters.

The model is one bit-sliced Bloom filter: a table of ``slots`` masks with a bit per language, in planes of 32 languages. An n-gram of a language sets
that language's bit in ``hashes`` slots; the AND of the slots of an n-gram is the set of all languages that (may)
contain it, so one look-up answers for every language. Over a text the bits are counted per language. A language whose
plane has fill ``f`` answers yes to a foreign n-gram with probability ``p = f ** hashes``; the count ``c`` of ``n`` n-grams is
corrected to the share ``(c / n - p) / (1 - p)`` of n-grams that the language really holds, and the largest share wins.

N-grams are ``NGRAM`` bytes of the lower-cased text in UTF-8, white space and punctuation folded into single blanks, digits
left out; texts are read whole. The planes hold the n-grams seen in at least ``min_docs`` training documents of the language.

Training: labelled rows, at most ``sample_docs`` per language (those of smallest hash, a documented bound), so the
distinct n-grams and the table have a fixed size per language; the table is broadcast (``slots`` x 4 bytes for every 32 languages, without
labels of which no n-gram is known, as misspelt ones). Prediction is one pass
over all documents without a shuffle.

Defined cases: ``und`` with score 0 for a null text, one without a letter, and any text when nothing could be learned; ties
(as of texts shorter than an n-gram) go to the language with most training rows; repeated rows are predicted each; other columns are left out unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .textkit import mix64, seeds, text_slices, utf8_buffer

#: Bytes of an n-gram, slots of the table (a power of two), look-ups per n-gram, languages of a plane.
NGRAM, SLOTS, HASHES, LANGUAGES = 5, 1 << 21, 2, 32
#: Training documents per language at most, and those an n-gram must be in.
SAMPLE_DOCS, MIN_DOCS = 1000, 2
UNKNOWN = "und"
#: Bytes of text handled at once: an n-gram takes some fifty bytes while it is looked up.
SLICE = 256 << 10

_FOLD = np.full(256, 32, np.uint8)
_FOLD[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_PLACE = seeds(NGRAM, 21) | np.uint64(1)
_SEEDS = seeds(HASHES, 23)


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram of each text, and the index of its text (ascending)."""
    data, offsets = utf8_buffer(pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), " ", ""))
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    data = _FOLD[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    data, doc = data[keep], doc[keep]
    n = len(data) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        wide = data.astype(np.uint64) + np.uint64(1)
        for k in range(NGRAM):
            h += wide[k:k + n] * _PLACE[k]
    inside = doc[:n] == doc[NGRAM - 1:]
    return h[inside], doc[:n][inside]


def slots_of(h: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for s in _SEEDS:
            yield (mix64(h ^ s) & np.uint64(slots - 1)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams, and n-grams found per language."""
        h, doc = ngrams(texts)
        total, found = np.bincount(doc, minlength=len(texts)), []
        at = list(slots_of(h, self.table.shape[1]))
        for p, plane in enumerate(self.table):
            mask = np.bitwise_and.reduce([plane[x] for x in at])
            for k in range(min(LANGUAGES, len(self.languages) - p * LANGUAGES)):
                found.append(np.bincount(doc, weights=(mask >> np.uint32(k)) & np.uint32(1), minlength=len(texts)))
        found = np.stack(found, axis=1)
        return total, found

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (corrected share against the shares of all) and corrected share of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total, found = self.counts(texts)
        share = (found / np.maximum(total, 1)[:, None] - self.false_rate) / (1 - self.false_rate)
        share = np.clip(share, 0, 1)
        best = share.argmax(axis=1)
        top = share[np.arange(len(share)), best]
        return [self.languages[b] for b in best], top / np.maximum(share.sum(axis=1), 1e-12), top


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, min_docs: int = MIN_DOCS, slots: int = SLOTS) -> Model:
    """Model of the labelled rows (null labels and texts are skipped).

    ``sample_docs`` rows of smallest text hash per language are read, repeated texts once. Their n-gram document counts
    are taken by Spark; what reaches the driver is the list of set slots, at most ``slots`` x ``hashes`` numbers a language.
    """
    rows = labelled.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).filter("_lang is not null and _text is not null")
    keyed = rows.select("_lang", F.xxhash64("_text").alias("_h"), "_text")
    sizes = keyed.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").collect()  # a row per language
    names = [r[0] for r in sizes]
    large = [r[0] for r in sizes if r[1] > sample_docs]
    sample = keyed.filter(~F.col("_lang").isin(large)).dropDuplicates(["_lang", "_h"]) if len(large) < len(names) else None
    for name in large:
        of_language = keyed.filter(F.col("_lang") == name)
        # which hashes are in the sample is settled without the texts, which are then read and sent for the sample alone
        last = of_language.select("_h").distinct().orderBy("_h").limit(sample_docs).agg(F.max("_h")).first()[0]
        one = of_language.filter(F.col("_h") <= last).dropDuplicates(["_h"])
        sample = one if sample is None else sample.unionByName(one)
    if sample is None:
        return Model([], np.zeros((0, slots), np.uint32), np.zeros(0))

    def slots_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                h, doc = ngrams(part.column("_text"))
                both = np.unique(np.stack([doc.astype(np.uint64), h], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                langs = part.column("_lang").take(pa.array(both[:, 0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([langs, pa.array(both[:, 1].view(np.int64) if len(both) else [], pa.int64())], names=["_lang", "gram"])

    grams = sample.mapInArrow(slots_by_document, "_lang string, gram bigint").groupBy("_lang", "gram").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    found = {k: g.to_numpy(np.int64).view(np.uint64) for k, g in grams.select("_lang", "gram").toPandas().groupby("_lang")["gram"]}  # bounded by sample_docs per language
    names = [name for k, name in enumerate(names) if not k or name in found]
    table = np.zeros((-(-len(names) // LANGUAGES), slots), np.uint32)
    fill = np.zeros(len(names))
    for k, name in enumerate(names):
        plane, bit = table[k // LANGUAGES], np.uint32(1 << k % LANGUAGES)
        for at in slots_of(found.get(name, np.zeros(0, np.uint64)), slots):
            plane[at] |= bit
        fill[k] = np.count_nonzero(plane & bit) / slots
    return Model(names, table, fill ** HASHES)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``lang_pred, score, known_share`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = text if text in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in text_slices(batch, source, SLICE):
                texts = part.column(source)
                lang, score, share = m.predict(texts)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist()
                lang = [a if ok else UNKNOWN for a, ok in zip(lang, letters)]
                score = np.where([a == UNKNOWN for a in lang], 0.0, np.clip(score, 0, 1))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(share)],
                                                 names=[*keep, "lang_pred", "score", "known_share"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known_share", T.DoubleType())])
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: a quarter of all, by the CRC-32 of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))
