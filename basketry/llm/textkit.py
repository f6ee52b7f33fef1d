"""Whole-batch text work for functions that run inside Spark tasks: words, shingles and 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Words in a shingle.
SHINGLE_WORDS = 5

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1 + salt * 1000, n + 1 + salt * 1000, dtype=np.uint64) * _BASE)


_BYTE_HASH = seeds(256, 7)
_PLACE = seeds(SHINGLE_WORDS, 9) | np.uint64(1)
#: Bytes of words: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece hold about ``limit`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    groups = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings (null: empty) and the offsets at which each string starts and ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run of word bytes inside one text), and the text it is in."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _WORD_BYTE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    ends[before] = inside[before]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    flat = place + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        powers = np.full(int(lengths.max()), _BASE | np.uint64(1), np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        return mix64(np.add.reduceat(_BYTE_HASH[data[flat]] * powers[place], first) + lengths.astype(np.uint64))


def shingles(texts: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` lower-cased words, and the index of its text.

    A text of fewer words is one shingle of all its words; one without a word has none.
    """
    data, offsets = utf8_buffer(pc.utf8_lower(texts))
    starts, stops, doc = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = word_hashes(data, starts, stops)
    with np.errstate(over="ignore"):
        n = len(w) - width + 1
        out, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n > 0:
            acc = np.zeros(n, np.uint64)
            for k in range(width):
                acc += w[k:k + n] * _PLACE[k]
            whole = doc[:n] == doc[width - 1:]
            out, owner = mix64(acc[whole]), doc[:n][whole]
        counts = np.bincount(doc, minlength=len(texts))
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            at = np.searchsorted(doc, short)
            extra = np.array([(w[a:a + c] * _PLACE[:c]).sum(dtype=np.uint64) + np.uint64(c) for a, c in zip(at, counts[short])], np.uint64)
            out, owner = np.concatenate([out, mix64(extra)]), np.concatenate([owner, short])
    return out, owner


def weighted_shingles(texts: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, its index (ascending) and how often the shingle occurs in it."""
    h, doc = shingles(texts, width)
    if not len(h):
        return h, doc, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))
