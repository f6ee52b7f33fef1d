"""Byte-level BPE encoding and decoding with a segment tree over the byte positions of each piece.

Every leaf of the tree stands for a byte position and holds the rank of the pair that begins there; every inner node
holds the smallest (rank, position) below it, so the root names the leftmost pair of lowest rank. A merge writes three
leaves - the merged pair's, its right neighbour's (now dead) and the live left neighbour's - and the log2(n) nodes above
each. A piece of n bytes costs O(n log n) whatever it holds, so a text that is one endless "word" is harmless.

Short pieces are merged many at a time, as rows of one numpy tree; long ones one by one.

Texts are cut at single blanks and line feeds that stand between two non-blanks, where the pattern always starts a new
match, and each cut is encoded once per task and looked up afterwards (a bounded memory of recent cuts, no effect on
results). Texts with any other white space go through the pattern as a whole.

Defined cases: a null text is an empty one; an empty text has no ids (and the digest of no bytes); repeated rows are
encoded each; other columns, whatever their names, are left out of ``encode`` unless asked for with ``keep``.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .textkit import text_slices

#: Cuts that a task remembers before it starts anew.
MEMORY = 700_000
#: Pieces up to this many bytes are merged together in one numpy tree.
TOGETHER = 64
#: Of a pair that is no token, and of a node below which there is none.
_NO_RANK, _NONE = np.int32(1 << 24), np.int32(2**31 - 1)


def regular(text: str) -> bool:
    """Whether all white space is single blanks and line feeds between non-blanks."""
    return " ".join(text.split()) == text.replace("\n", " ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """The merges of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        if max(ranks.values()) >= _NO_RANK // TOGETHER:
            raise ValueError("ranks of 18 bits at most")
        self.whole = {b: np.uint32(i).tobytes() for b, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.pairs = dict(zip(keys, values))
        ids = self.byte_id
        self.byte_pairs = self._rank(np.repeat(ids, 256), np.tile(ids, 256)).reshape(256, 256)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << np.int64(32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NO_RANK)

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece, with the tree in a list."""
        n = len(piece)
        if n < 2:
            return [self.ranks[piece]] if n else []
        size = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        ids = [int(self.byte_id[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = pairs.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = (r, i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        while tree[1] is not none and tree[1][0] < none[0]:
            rank, i = tree[1]
            gone, left = after[i], before[i]
            right = after[gone]
            ids[i], after[i] = rank, right
            put(gone, none)
            ids[gone] = -1
            if right < n:
                before[right] = i
                r = pairs.get(rank << 32 | ids[right])
            else:
                r = None
            put(i, none if r is None else (r, i))
            if left >= 0:
                r = pairs.get(ids[left] << 32 | rank)
                put(left, none if r is None else (r, left))
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of up to ``TOGETHER`` bytes: one row of the tree array each."""
        lengths = np.array([len(p) for p in pieces], np.int32)
        size = np.int32(1 << max(1, int(lengths.max() - 1).bit_length()))
        n = len(pieces)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(n, size)
        column = np.arange(size, dtype=np.int32)
        live = column < lengths[:, None]
        ids = self.byte_id[raw]
        # a node holds rank * size + position; _NONE is above all of them
        tree = np.full((n, 2 * size), _NONE, np.int32)
        leaf = self.byte_pairs[raw[:, :-1], raw[:, 1:]]
        tree[:, size:2 * size - 1] = np.where(live[:, 1:] & (leaf < _NO_RANK), leaf * size + column[:-1], _NONE)
        width = int(size)
        while width > 1:
            tree[:, width // 2:width] = np.minimum(tree[:, width:2 * width:2], tree[:, width + 1:2 * width:2])
            width //= 2
        after = np.tile(column + 1, n)
        before = np.tile(column - 1, n)
        tree, ids, alive = tree.ravel(), ids.ravel(), live.ravel()

        def put(base: np.ndarray, i: np.ndarray, value) -> None:
            node = i + size
            tree[base + node] = value
            for _ in range(int(size).bit_length() - 1):
                node >>= 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])

        rows = np.flatnonzero(tree[1::2 * size] < _NONE).astype(np.int32)
        while len(rows):
            base, at = rows * (2 * size), rows * size
            rank, i = np.divmod(tree[base + 1], size)
            gone = after[at + i]
            right, left = after[at + gone], before[at + i]
            ids[at + i], after[at + i] = rank, right
            alive[at + gone] = False
            put(base, gone, _NONE)
            some = np.flatnonzero(right < lengths[rows])
            value = np.full(len(rows), _NONE, np.int32)
            beside = at[some] + right[some]
            before[beside] = i[some]
            r = self._rank(rank[some], ids[beside])
            value[some] = np.where(r < _NO_RANK, r * size + i[some], _NONE)
            put(base, i, value)
            some = np.flatnonzero(left >= 0)
            r = self._rank(ids[at[some] + left[some]], rank[some])
            put(base[some], left[some], np.where(r < _NO_RANK, r * size + left[some], _NONE))
            rows = rows[tree[base + 1] < _NONE]
        out = ids[alive].astype(np.uint32).tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as bytes of unsigned 32-bit integers; a piece that is a token is that token."""
        known = self.whole
        out = [known.get(p) for p in pieces]
        by_size: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if out[k] is None:
                if len(p) > TOGETHER:
                    out[k] = np.array(self.merge_long(p), np.uint32).tobytes()
                else:
                    by_size.setdefault((len(p) - 1).bit_length(), []).append(k)
        for group in by_size.values():
            for a in range(0, len(group), 4096):
                part = group[a:a + 4096]
                for k, ids in zip(part, self.merge_many([pieces[k] for k in part])):
                    out[k] = ids
        return out


class Memory(dict):
    """Ids (as bytes) of the cuts of texts seen so far, refilled by ``encode(list of texts) -> list of ids``."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = MEMORY):
        super().__init__()
        self.encode, self._limit = encode, limit

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of every text."""
        cuts = []
        for t in texts:
            plain = t and "\0" not in t and regular(t)
            cuts.append(t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if plain else [])
        found = [list(map(self.get, c)) for c in cuts]
        fresh = {k for c, f in zip(cuts, found) for k, v in zip(c, f) if v is None}
        self.learn(fresh, ((k, v) for c, f in zip(cuts, found) for k, v in zip(c, f) if v is not None))
        whole = iter(self.encode([t for t, c in zip(texts, cuts) if t and not c]))
        out = []
        for t, c, f in zip(texts, cuts, found):
            ids = b"".join([self[k] if v is None else v for k, v in zip(c, f)]) if c else next(whole) if t else b""
            out.append(np.frombuffer(ids, np.uint32))
        return out

    def learn(self, fresh: set[str], held: Iterable[tuple[str, bytes]]) -> None:
        """Encode new cuts; if the memory is full, only ``held`` is kept of it."""
        if len(self) + 2 * len(fresh) > self._limit:
            self.clear()
            self.update(held)
        self._add(fresh)

    def _add(self, fresh: set[str]) -> None:
        """Encode cuts; letters followed by closing punctuation are two matches of the pattern, remembered one by one."""
        pairs, plain = {}, set()
        for k in fresh:
            body = k.rstrip(".,;:!?")
            if len(body) < len(k) and (body.isalpha() or body[:1] == " " and body[1:].isalpha()):
                pairs[k] = (body, k[len(body):])
            else:
                plain.add(k)
        plain.update(x for two in pairs.values() for x in two)
        plain = [k for k in plain if k not in self]
        self.update(zip(plain, self.encode(plain)))
        self.update((k, self[a] + self[b]) for k, (a, b) in pairs.items())


class Encoder:
    """Encoding and decoding by a rank file and a splitting pattern, kept by a task's process for its next tasks."""

    def __init__(self, path: str, pattern: str):
        self.merger = Merger(read_ranks(path))
        # white space as Unicode has it, which the pattern's own engine means by \s
        unicode_space = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(unicode_space)
        top = max(self.merger.tokens) + 1
        self.names = [str(i) for i in range(top)]
        self.tokens = [self.merger.tokens.get(i) for i in range(top)]
        self.memory = Memory(self._encode)
        gc.freeze()
        gc.disable()  # nothing here makes cycles, and each collection would walk the whole memory

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        letters = [t.isalpha() or t[0] == " " and t[1:].isalpha() for t in texts]  # one match of the pattern
        find = self.pattern.findall
        split = [None if one else find(t) for t, one in zip(texts, letters)]
        distinct = list(dict.fromkeys(chain([t for t, one in zip(texts, letters) if one], chain.from_iterable(s for s in split if s))))
        ids = dict(zip(distinct, self.merger.encode_pieces([p.encode() for p in distinct])))
        return [ids[t] if s is None else b"".join([ids[p] for p in s]) for t, s in zip(texts, split)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.memory.ids_of(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                ids = [x.astype(np.int32) for x in e.encode([t or "" for t in part.column("_text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded binary`` of every row's ``ids`` (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            decoded = [e.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(decoded, pa.binary())], names=[*keep, "decoded"])

    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("decoded", T.BinaryType())])
    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode the ids, of every whole text.

    The same calls as ``encode`` and ``decode``; only the digests leave the task, so no id list is written or shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        name = e.names.__getitem__
        for batch in batches:
            for part in text_slices(batch, "_text"):
                n, a, b = [], [], []
                for ids in e.encode([t or "" for t in part.column("_text").to_pylist()]):
                    ids = ids.tolist()
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(e.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(run, schema)
