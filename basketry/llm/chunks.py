"""Repeated passages: content-defined chunking with a gear rolling hash.

1. Chunks. The gear hash of the last 16 bytes (``h = 2 h + G[byte]``) decides where a chunk ends, so cuts depend on the text around
   them alone and come back in step after an insertion. A cut needs ``MIN_CHUNK`` bytes without another candidate before it.
   Chunks average ``1 / rate`` = about 22 bytes. They meet by their 64-bit digest, in blobs of many chunks per bucket of
   digests; what is settled is which chunks of a document another document holds too.
2. Windows. A run of ``min_words`` words can only be repeated if every whole chunk in it is held by another document (but for
   chunks whose first cut depends on the bytes before the run); a run without a whole chunk, as in periodic text, always can.
   Those runs meet by a 64-bit digest of their own, whole, so which documents hold parts of them does not matter.
3. Meeting. Inside a slice of documents all but the first document that holds a chunk or a run are repeats at once; only the first
   goes on. A chunk in a third of all documents thus costs one entry a slice. The bucket's task names the smallest document of each run.
4. Passages. Runs that overlap with one source and one displacement are one place, extended byte by byte in both texts to the
   longest equal passage, cut to whole words. Digests only propose; equal bytes decide.

No run of ``min_words`` whole words that an earlier document holds is missed.

Defined cases: null and empty texts have no chunk; what repeats inside one document only is left alone; rows that repeat a
doc_id are one document, of which one row's text is looked at for extension; null doc_ids are left out; of all documents
with a passage the one with the smallest doc_id keeps it; other columns are ignored by ``repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage
from .textkit import mix64, seeds, text_slices, utf8_buffer

#: Bytes that a cut depends on, one candidate in so many bytes, smallest distance between candidates that makes a cut.
WINDOW, RATE, MIN_CHUNK = 16, 16, 6
#: Words of a passage that is reported, at least.
MIN_WORDS = 50
#: Buckets of digests per shuffle partition.
BUCKETS = 4

_GEAR = seeds(256, 51).astype(np.uint32)
_BYTE = seeds(256, 53)
_BASE = int(seeds(1, 55)[0]) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which a chunk begins: the text starts, and behind every cut."""
    h = _GEAR[data]
    reach = 1
    while reach < WINDOW:  # h[i] = sum of G[data[i - j]] << j over the last ``WINDOW`` bytes
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    candidate = np.flatnonzero((h >> np.uint32(WINDOW - 4)) & np.uint32(RATE - 1) == 0) + 1
    far = np.ones(len(candidate), bool)
    far[1:] = np.diff(candidate) >= MIN_CHUNK
    text = np.searchsorted(offsets, candidate, side="right") - 1
    inside = candidate - offsets[text] >= WINDOW  # its window does not reach into the text before
    return np.union1d(candidate[far & inside], offsets[:-1][np.diff(offsets) > 0])


def _word_begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte."""
    starts = ~_SPACE[data]
    starts[1:] &= _SPACE[data[:-1]]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = ~_SPACE[data[edges]]
    return starts


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of every chunk: text index, start and end byte in the text, words that begin in it, 64-bit digest."""
    data, offsets = utf8_buffer(texts)
    if not len(data):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    begin = gear_cuts(data, offsets)
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    doc = np.searchsorted(offsets, begin, side="right") - 1
    words = np.add.reduceat(_word_begins(data, offsets).astype(np.int64), begin)
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    digests = np.array([digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())], np.uint64)
    return doc, begin - offsets[doc], end - offsets[doc], words, digests


def windows_of(texts: pa.Array, shared: pa.Array, n_words: int) -> tuple[np.ndarray, ...]:
    """Of every run of ``n_words`` words without a whole chunk outside ``shared`` (starts, per text): text index, start, end, digest."""
    data, offsets = utf8_buffer(texts)
    begins = np.flatnonzero(_word_begins(data, offsets)) if len(data) else np.zeros(0, np.int64)
    if len(begins) < n_words:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    solid = np.append(~_SPACE[data], False)
    solid[:-1] &= np.append(_SPACE[data[1:]], True)
    edges = offsets[1:][np.diff(offsets) > 0] - 1
    solid[edges] = ~_SPACE[data[edges]]
    ends = np.flatnonzero(solid) + 1
    doc = np.searchsorted(offsets, begins, side="right") - 1
    whole = doc[:len(doc) - n_words + 1] == doc[n_words - 1:]
    start, end, doc = begins[:len(whole)][whole], ends[n_words - 1:][whole], doc[:len(whole)][whole]

    first = gear_cuts(data, offsets)
    first = first[first < len(data)]
    last = np.append(first[1:], len(data))
    chunk_doc = np.searchsorted(offsets, first, side="right") - 1
    lists = np.asarray(pc.list_value_length(pc.fill_null(shared, [])), np.int64)
    known = np.repeat(offsets[:-1], lists) + np.asarray(pc.list_flatten(shared), np.int64)
    alone = ~np.isin(first, known)
    alone[last == offsets[chunk_doc + 1]] = False  # ends with its text, not by a cut
    before = np.append(0, np.cumsum(alone))
    low = np.searchsorted(first, start + WINDOW + MIN_CHUNK)  # a cut depends on no more bytes before it
    high = np.searchsorted(last, end, side="right")
    at = np.flatnonzero((high <= low) | (before[high] == before[np.minimum(low, len(first))]))
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    start, end, doc = start[at], end[at], doc[at]
    with np.errstate(over="ignore"):
        powers = np.full(len(data), _BASE, np.uint64)
        powers[0] = 1
        total = np.append(np.uint64(0), np.cumsum(_BYTE[data] * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64))
        powers[1:] = _INVERSE
        digest = mix64((total[end] - total[start]) * np.cumprod(powers, dtype=np.uint64)[start] + (end - start).astype(np.uint64))
    return doc, start - offsets[doc], end - offsets[doc], digest


_COLUMNS = [("digest", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "<i4"), ("source", "<i8"), ("source_start", "<i4")]


def _blob(arrays: list[np.ndarray]) -> bytes:  # digests do not compress, the zeros of places known without one do
    return b"".join(len(x).to_bytes(4, "little") + x for x in (zlib.compress(np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(len(a), -1).T.tobytes(), 1 if k or not a[:1].any() else 0)
                                                               for k, (a, (_, kind)) in enumerate(zip(arrays, _COLUMNS))))


def _unblob(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for _, kind in _COLUMNS:
        if at == len(data):
            break
        n = int.from_bytes(data[at:at + 4], "little")
        planes = np.frombuffer(zlib.decompress(data[at + 4:at + 4 + n]), np.uint8).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 4 + n
    return out


def _grouped(digest: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns by digest, document and start, and for each row the first of its digest."""
    order = np.lexsort((start, ids, digest))
    digest = digest[order]
    first = np.flatnonzero(np.diff(digest, prepend=digest[:1] ^ np.uint64(1)))
    return digest, ids[order], start[order], size[order], np.repeat(first, np.diff(np.append(first, len(digest))))


def _several(ids: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each row's digest is in two documents."""
    other = np.zeros(len(ids), bool)
    other[group[ids != ids[group]]] = True
    return other[group]


def _by_bucket(number: np.ndarray, buckets: int, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    bucket = (number % number.dtype.type(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    parts = [by[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(by)))]
    return [int(bucket[p[0]]) for p in parts], [_blob([c[p] for c in columns]) for p in parts]


def _blobs(rows: list[int], blobs: list[bytes]) -> list[pa.Array]:
    return [pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())]


def _chunk_blobs(buckets: int):
    """Blobs of each slice: chunks of first holders by bucket of their digest, and those known to be in two documents anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                doc, start, end, _, digest = chunks_of(part.column("_text"))
                if not len(doc):
                    continue
                digest, ids, start, size, group = _grouped(digest, np.asarray(part.column("doc_id"), np.int64)[doc], start, end - start)
                own, known = np.flatnonzero(ids == ids[group]), np.flatnonzero(_several(ids, group))
                rows, blobs = _by_bucket(digest[own] >> np.uint64(32), buckets, [digest[own], ids[own], start[own]])
                if len(known):
                    rows.append(int(ids[0] % buckets))
                    blobs.append(_blob([np.zeros(len(known)), ids[known], start[known], size[known]]))
                yield pa.RecordBatch.from_arrays(_blobs(rows, blobs), names=["bucket", "blob"])

    return run


def _chunks_meet(table: pa.Table) -> pa.Table:
    """Chunks of one bucket of digests that are in two documents or more."""
    columns = [_unblob(blob) for blob in table.column("blob").to_pylist()]
    own = [c for c in columns if len(c) == 3]
    out = [[np.zeros(0, np.int64)] * 2, *(c[1:3] for c in columns if len(c) > 3)]
    if own:
        digest, ids, start = (np.concatenate([c[k] for c in own]) for k in range(3))
        _, ids, start, _, group = _grouped(digest, ids, start, start)
        at = _several(ids, group)
        out.append([ids[at], start[at]])
    return pa.table([pa.array(np.concatenate([x[k] for x in out]), kind) for k, kind in enumerate((pa.int64(), pa.int32()))], names=["doc_id", "start"])


def shared_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, start``: chunks of ``docs (doc_id, _text)`` that another document holds too."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.mapInArrow(_chunk_blobs(buckets), "bucket int, blob binary").groupBy("bucket").applyInArrow(_chunks_meet, "doc_id bigint, start int")


def _joined(ids: np.ndarray, start: np.ndarray, size: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> list[np.ndarray]:
    """The same places, those that overlap with one source and one displacement as one."""
    if not len(ids):
        return [ids, start, size, source, source_start]
    start, source_start = start.astype(np.int64), source_start.astype(np.int64)
    shift = source_start - start
    order = np.lexsort((start, shift, source, ids))
    ids, start, source, shift, end = ids[order], start[order], source[order], shift[order], (start + size)[order]
    same = (ids[1:] == ids[:-1]) & (source[1:] == source[:-1]) & (shift[1:] == shift[:-1])
    first = np.flatnonzero(np.append(True, ~(same & (start[1:] <= end[:-1]))))
    end = np.maximum.reduceat(end, first)
    return [ids[first], start[first], end - start[first], source[first], start[first] + shift[first]]


def _window_blobs(buckets: int, n_words: int):
    """Blobs of each slice: runs of first holders by bucket of their digest, and known repeats (with their source) anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                doc, start, end, digest = windows_of(part.column("_text"), part.column("shared"), n_words)
                if not len(doc):
                    continue
                digest, ids, start, size, group = _grouped(digest, np.asarray(part.column("doc_id"), np.int64)[doc], start, end - start)
                own, at = np.flatnonzero(ids == ids[group]), np.flatnonzero(ids != ids[group])
                rows, blobs = _by_bucket(digest[own] >> np.uint64(32), buckets, [digest[own], ids[own], start[own], size[own]])
                if len(at):
                    known = _joined(ids[at], start[at], size[at], ids[group[at]], start[group[at]])
                    rows.append(int(ids[0] % buckets))
                    blobs.append(_blob([np.zeros(len(known[0])), *known]))
                yield pa.RecordBatch.from_arrays(_blobs(rows, blobs), names=["bucket", "blob"])

    return run


def _windows_meet(table: pa.Table) -> pa.Table:
    """Repeats of one bucket of digests."""
    columns = [_unblob(blob) for blob in table.column("blob").to_pylist()]
    firsts, out = [c for c in columns if len(c) == 4], [c[1:] for c in columns if len(c) > 4]
    if firsts:
        _, ids, start, size, group = _grouped(*(np.concatenate([c[k] for c in firsts]) for k in range(4)))
        at = np.flatnonzero(ids != ids[group])
        out.append([ids[at], start[at], size[at], ids[group[at]], start[group[at]]])
    found = _joined(*(np.concatenate([x[k] for x in out]) for k in range(5)))
    return pa.table([pa.array(c, pa.int64() if k in (0, 3) else pa.int32()) for k, c in enumerate(found)], names=["doc_id", "start", "size", "source", "source_start"])


def _places(table: pa.Table) -> pa.Table:
    """Places of one bucket of documents."""
    ids, start, size, source, source_start = _joined(*(np.asarray(table.column(c)) for c in ("doc_id", "start", "size", "source", "source_start")))
    arrays = [pa.array(ids, pa.int64()), pa.array(source, pa.int64()), pa.array(start, pa.int32()), pa.array(source_start - start, pa.int32()), pa.array(start + size, pa.int32())]
    return pa.table(arrays, names=["doc_id", "source", "start", "shift", "end"])


def places(docs: DataFrame, texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, source, at array<struct<start, shift, end>>``: where ``texts (doc_id, _text)`` hold runs of ``min_words`` words of
    a document of smaller doc_id; ``docs`` are the rows they come from."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = shared_chunks(docs).groupBy("doc_id").agg(F.collect_list("start").alias("shared"))
    rows = texts.join(shared.hint("merge"), "doc_id", "left").select("doc_id", "_text", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))
    met = rows.mapInArrow(_window_blobs(buckets, min_words), "bucket int, blob binary").groupBy("bucket").applyInArrow(
        _windows_meet, "doc_id bigint, start int, size int, source bigint, source_start int")
    found = met.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).groupBy("bucket").applyInArrow(_places, "doc_id bigint, source bigint, start int, shift int, end int")
    return found.groupBy("doc_id", "source").agg(F.collect_list(F.struct("start", "shift", "end")).alias("at"))


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Equal items at the start of both."""
    n = min(len(a), len(b))
    reach, done = 64, 0
    while done < n:
        wrong = np.flatnonzero(a[done:min(n, done + reach)] != b[done:min(n, done + reach)])
        if len(wrong):
            return done + int(wrong[0])
        done += reach
        reach *= 4
    return n


def extended(a: bytes, b: bytes, start: int, shift: int) -> tuple[int, int, int]:
    """Start, length and words of the longest equal passage around ``start``, of whole words of ``a``."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    end = start + _same(x[start:], y[start + shift:])
    begin = start - _same(x[:start][::-1], y[:start + shift][::-1])
    space = _SPACE[x[begin:end]]
    if begin > 0 and not _SPACE[x[begin - 1]]:  # the first word is cut
        blanks = np.flatnonzero(space)
        begin = begin + int(blanks[0]) if len(blanks) else end
    if end < len(x) and not _SPACE[x[end]]:
        blanks = np.flatnonzero(_SPACE[x[begin:end]])
        end = begin + int(blanks[-1]) if len(blanks) else begin
    solid = np.flatnonzero(~_SPACE[x[begin:end]])
    if not len(solid):
        return begin, 0, 0
    begin, end = begin + int(solid[0]), begin + int(solid[-1]) + 1
    return begin, end - begin, len(a[begin:end].split())


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, start, length`` (bytes of the UTF-8 text), ``n_words, source``: passages of ``min_words`` words or more that
    the document ``source``, of smaller doc_id, holds too. One row per passage; of several sources the smallest."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).filter("doc_id is not null")
    pairs = cut_lineage(places(rows, rows.groupBy("doc_id").agg(F.max("_text").alias("_text")), min_words))
    wanted = pairs.select("doc_id").unionByName(pairs.select(F.col("source").alias("doc_id"))).distinct()
    texts = cut_lineage(rows.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("_text").alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, s, at, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "at", "text_a", "text_b"))):
                a, b = a.encode(), b.encode()
                reach = 0
                for p in sorted(at, key=lambda p: (p["start"], -p["end"])):
                    if p["end"] <= reach:  # inside a passage that is reported: its start is not after this one
                        continue
                    begin, length, words = extended(a, b, p["start"], p["shift"])
                    if words >= min_words:
                        reach = max(reach, begin + length)
                        out.append((d, begin, length, words, s))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                             names=["doc_id", "start", "length", "n_words", "source"])

    left = texts.withColumnRenamed("_text", "text_a")
    right = texts.select(F.col("doc_id").alias("source"), F.col("_text").alias("text_b"))
    both = pairs.join(left, "doc_id").join(right, "source").select("doc_id", "source", "at", "text_a", "text_b")
    found = both.mapInArrow(run, "doc_id bigint, start int, length int, n_words int, source bigint")
    return found.groupBy("doc_id", "start", "length").agg(F.max("n_words").alias("n_words"), F.min("source").alias("source"))


def without_repeats(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the passages of ``spans (doc_id, start, length)`` taken out of their texts."""
    cut = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("_spans"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    data, end = F.encode("t", "UTF-8"), F.octet_length("t")
    kept = F.aggregate(
        F.concat("_spans", F.array(F.struct(end.alias("start"), F.lit(0).alias("length")))), F.struct(F.lit(b"").alias("kept"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["kept"], F.substring(data, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))).alias("kept"),
                              F.greatest(a["at"], s["start"] + s["length"]).alias("at")),
        lambda a: F.decode(a["kept"], "UTF-8"))
    new = F.when(F.col("_spans").isNull(), F.col("t")).otherwise(kept)
    return rows.join(cut, F.col("id") == F.col("_doc"), "left").select(*(new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
