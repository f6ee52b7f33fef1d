"""Token ids in binary blocks: canonical length-limited Huffman codes from global counts.

1. ``encode_ids``: every text to ids, one pass without a shuffle, stored as one blob a document, and a row of counts a task.
2. ``count_ids``: how often each id occurs in the whole corpus, added up over the tasks. The result has one row per id, so its size is bounded by
   the vocabulary, and the code lengths are made from it on the driver (package-merge, at most ``MAX_BITS`` bits).
3. ``write``: the blobs are range-partitioned by document and cut into independent blocks of whole documents.
4. ``read``: every block is decoded by itself with one table of ``2**longest`` entries. A block has a checkpoint (bit
   offset) every ``SEGMENT`` ids, so all its segments are decoded side by side, one table look-up each at a time.

File format: a folder with two Parquet tables. ``codebook`` (id, bits): canonical code lengths; codes are numbered by
(bits, id). ``blocks``: one row per block, in ascending order of ``shard, block``: ``doc_ids``, ``lengths`` (ids of each
document), ``checkpoints`` (bit offset of every ``SEGMENT``-th id, as little-endian unsigned 64-bit integers) and ``bits``
(most significant bit first, in little-endian 64-bit words). Parquet gives the files their commit protocol: what a lost
executor left half-written is not read.

Defined cases: a null text is an empty one and holds the end id alone; rows that repeat a doc_id are kept, each a document,
in an order of their own; null doc_ids come first; an empty table gives empty tables; other columns are left out.
"""

from __future__ import annotations

import gc
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import Memory
from .textkit import text_slices, utf8_buffer

#: Longest code; 2**MAX_BITS entries of the decoding table.
MAX_BITS = 18
#: Ids between two checkpoints, and ids after which a block is closed (with the document it is in).
SEGMENT, BLOCK_IDS = 256, 1 << 20
#: Bytes of text cut into pieces at once, and bytes of the longest piece that is remembered.
TEXT_BYTES, LONG_PIECE = 4 << 20, 200

#: What a byte is to the cuts: a blank, a line feed, other white space of one byte, closing punctuation, or the first byte of longer white space.
_BLANK, _FEED, _SPACE, _CLOSING, _WIDE = range(1, 6)
# U+180E was white space in older versions of Unicode
_SPACES = [chr(c).encode() for c in range(0x3001) if chr(c).isspace() or c == 0x180E]
_WIDE_SPACES = np.array([int.from_bytes(c.ljust(3, b"\0"), "big") for c in _SPACES if len(c) > 1], np.int64)
_KIND = np.zeros(256, np.uint8)
_KIND[[c[0] for c in _SPACES if len(c) == 1]] = _SPACE
_KIND[[c[0] for c in _SPACES if len(c) > 1]] = _WIDE
_KIND[32], _KIND[10], _KIND[[*b".,;:!?"]] = _BLANK, _FEED, _CLOSING
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

_CODEC, _HEAD = pa.Codec("zstd"), Struct("<QB")
BLOCKS = "shard int, block int, doc_ids array<bigint>, lengths array<bigint>, checkpoints binary, bits binary"


def _byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def _memory(path: str) -> Memory:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    gc.freeze()
    gc.disable()

    # A blank and letters are one piece for a byte-level splitter, and only the first token of such a piece begins with the blank.
    # So many of them are encoded as one text and cut before those tokens. Letters alone are one piece, too, and so is a line feed between two of them.
    vocabulary, alphabet = tokenizer.get_vocab(), _byte_alphabet()
    begins = np.zeros(max(vocabulary.values()) + 1, bool)
    begins[[k for t, k in vocabulary.items() if t.startswith(alphabet[ord(" ")])]] = True
    feed = vocabulary.get(alphabet[ord("\n")])

    def encode_many(words: list[str], between: str) -> Iterator[np.ndarray]:
        texts = [between.join(words[a:a + 1000]) for a in range(0, len(words), 1000)]
        for a in range(0, len(texts), 20):
            yield np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast([t + between for t in texts[a:a + 20]], add_special_tokens=False)])

    def encode_words(words: list[str]) -> Iterator[bytes]:
        for ids in encode_many(words, ""):
            data, cuts = ids.tobytes(), [*(4 * np.flatnonzero(begins[ids])).tolist(), 4 * len(ids)]
            yield from [data[b:e] for b, e in zip(cuts, cuts[1:])]

    def encode_bare(words: list[str]) -> Iterator[bytes]:
        for ids in encode_many(words, "\n"):
            data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == feed)).tolist()
            yield from [data[b:e] for b, e in zip([0, *[c + 4 for c in cuts]], cuts)]

    def encode(texts: list[str]) -> list[bytes]:
        kinds = [0 if t[:1] == " " and t[1:].isalpha() else 1 if feed is not None and t.isalpha() else 2 for t in texts]
        ways = [iter(way([t for t, one in zip(texts, kinds) if one == k])) for k, way in enumerate((encode_words, encode_bare, encode_whole))]
        return [next(ways[k]) for k in kinds]

    def encode_whole(texts: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(texts), 2000):
            ids = [e.ids for e in tokenizer.encode_batch_fast(texts[a:a + 2000], add_special_tokens=False)]
            data = np.fromiter(chain.from_iterable(ids), np.uint32).tobytes()
            ends = list(accumulate(4 * len(x) for x in ids))
            out += [data[b:e] for b, e in zip([0, *ends], ends)]
        return out

    level = type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and tokenizer.pre_tokenizer.use_regex and not tokenizer.pre_tokenizer.add_prefix_space
    if not level or tokenizer.normalizer is not None:
        raise ValueError("a tokenizer with byte-level pieces and no normalizer is needed")
    return Memory(encode)


def piece_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Offsets of a UTF-8 buffer at which the byte-level splitter begins a new piece and would, too, if the text began or ended there.

    These are the offsets ``texts`` of the texts in it, the first character of white space if it is a blank or a line feed, what follows a
    line feed between two non-blanks, and closing punctuation after a letter of ASCII or Latin-1.
    """
    n = len(data)
    kind = _KIND[data]
    white = np.zeros(n + 1, bool)
    white[:n] = (kind > 0) & (kind <= _SPACE)
    lead = np.flatnonzero(kind == _WIDE)
    first, second, third = (data[np.minimum(lead + k, n - 1)].astype(np.int64) for k in range(3))
    lead = lead[np.isin(first << 16 | second << 8 | np.where(first == 0xC2, 0, third), _WIDE_SPACES)]
    white[lead] = white[lead + 1] = True
    white[lead[data[lead] != 0xC2] + 2] = True
    cut = np.zeros(n + 1, bool)
    at = np.flatnonzero((kind == _BLANK) | (kind == _FEED))
    at = at[~white[at - 1]]  # at 0, a text begins anyway
    cut[at] = True
    after = at[data[at] == 10] + 1
    cut[after[~white[after]]] = True
    at = np.flatnonzero(kind == _CLOSING)
    one, two = data[at - 1], data[at - 2] if n > 1 else data[at - 1]
    cut[at[_LETTER[one] | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)]] = True  # all but the signs of U+00D7 and U+00F7
    cut[texts] = True
    return np.flatnonzero(cut[:n])


def ids_of(memory: Memory, texts: pa.Array, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (null: empty), each followed by those of ``tail``, and where each text ends in them.

    Equal pieces are found by Arrow's dictionary; the distinct ones are looked up, and encoded by the library if they are new.
    """
    data, offsets = utf8_buffer(texts)
    starts = piece_starts(data, offsets[:-1])
    # each text ends with an empty piece, which stands for the tail
    last = np.searchsorted(starts, offsets[1:]) + np.arange(len(texts))
    edges = np.append(np.insert(starts, last - np.arange(len(texts)), offsets[1:]), len(data))
    pieces = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
    which, distinct = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
    found = list(map(memory.get, distinct))
    found[which[last[0]]] = tail
    long = [k for k in distinct if len(k) > LONG_PIECE]
    own = dict(zip(long, memory.encode(long)))
    new = [k for k, v in enumerate(found) if v is None]
    memory.learn({distinct[k] for k in new} - own.keys(), ((k, v) for k, v in zip(distinct, found) if v is not None and k))
    for k in new:
        found[k] = own.get(distinct[k]) or memory[distinct[k]]
    known = np.frombuffer(b"".join(found), np.uint32)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    begin = (np.cumsum(sizes) - sizes)[which]
    sizes = sizes[which]
    ends = np.cumsum(sizes)
    at = np.repeat(begin - ends + sizes, sizes)
    at += np.arange(len(at))
    return known[at], ends[last]


def encode_ids(docs: DataFrame, path: str, end_id: int | None = None, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers, packed by byte plane) of every whole text, and ``counts``.

    Texts are cut where byte-level pre-splitting begins a new piece (``piece_starts``); the distinct pieces are encoded once per task and looked up afterwards.
    ``counts`` is null in the rows of documents; the last row of each task has nothing else: how often the task has seen each id, 64-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, names = _memory(path), ["doc_id", "n_tokens", "ids", "counts"]
        tail = np.array([] if end_id is None else [end_id], np.uint32).tobytes()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in text_slices(batch, "_text", TEXT_BYTES):
                ids, ends = ids_of(memory, part.column("_text"), tail)
                seen = np.bincount(ids, minlength=len(total))
                seen[:len(total)] += total
                total = seen
                begins = np.append(0, ends[:-1])
                packed = pa.array([pack(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ends - begins), packed, pa.nulls(len(ends), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, counts binary")


def pack(ids: np.ndarray) -> bytes:
    """The number of ids and of their byte planes that are not all zero, and these planes packed by Zstandard."""
    planes = (int(ids.max(initial=0)).bit_length() + 7) // 8
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T[:planes]
    return _HEAD.pack(len(ids), planes) + _CODEC.compress(data.tobytes(), asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, planes = _HEAD.unpack_from(blob)
    ids = np.zeros((n, 4), np.uint8)
    ids[:, :planes] = np.frombuffer(_CODEC.decompress(memoryview(blob)[_HEAD.size:], n * planes, asbytes=True), np.uint8).reshape(planes, n).T
    return ids.view("<u4").ravel()


def count_ids(encoded: DataFrame) -> DataFrame:
    """``id, n`` over all documents, from the counts of the tasks that encoded them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                n = np.frombuffer(blob, "<i8")
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n[seen])], names=["id", "n"])

    return encoded.filter("counts is not null").select("counts").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); one symbol alone gets one bit."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    # of each level only which of the merged items are leaves is kept; a package stands for two items of the level below
    levels, items = [np.ones(n, bool)], leaves
    for _ in range(limit - 1):
        packages = items[:len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        items = merged[by]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Code of each symbol, numbered by (bits, symbol)."""
    order = np.lexsort((np.arange(len(bits)), bits))
    step = np.int64(1) << (int(bits.max(initial=1)) - bits[order])
    first = np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.int64)
    codes = np.zeros(len(bits), np.int64)
    codes[order] = first >> (int(bits.max(initial=1)) - bits[order])
    return codes


class Codebook:
    """Dense coding arrays and the decoding table of one ``id -> bits`` list."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.argsort(ids)
        ids, bits = ids[order], bits[order]
        codes = canonical_codes(bits)
        top = int(ids.max(initial=0)) + 1
        self.bits, self.codes = np.zeros(top, np.int64), np.zeros(top, np.uint64)
        self.bits[ids], self.codes[ids] = bits, codes.astype(np.uint64)
        self.longest = int(bits.max(initial=1))
        by = np.lexsort((ids, bits))
        span = np.int64(1) << (self.longest - bits[by])
        fill = (1 << self.longest) - int(span.sum())
        self.symbol = np.concatenate([np.repeat(ids[by], span), np.zeros(fill, np.int64)]).astype(np.uint32)
        self.length = np.concatenate([np.repeat(bits[by], span), np.ones(fill, np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Bits, and the bit offset of every ``SEGMENT``-th id."""
        n, code = self.bits[ids], self.codes[ids]
        end = np.cumsum(n)
        start = end - n
        words = np.zeros(int(end[-1] if len(end) else 0) // 64 + 2, np.uint64)
        at, room = start >> 6, 64 - (start & 63) - n
        low = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[first]] = np.bitwise_or.reduceat(low, first)
            over = np.flatnonzero(room < 0)
            words[at[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype("<u8").tobytes(), start[::SEGMENT].astype("<u8").tobytes()

    def decode(self, bits: bytes, checkpoints: bytes, total: int) -> np.ndarray:
        """All ids of a block; every round decodes one id of each segment."""
        words = np.frombuffer(bits, "<u8")
        offset = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out = np.zeros((SEGMENT, len(offset)), np.uint32)
        last = total - SEGMENT * (len(offset) - 1)
        shift, mask = np.uint64(64 - self.longest), np.uint64(63)
        for k in range(SEGMENT):
            if k == last:
                offset = offset[:-1]
            if not len(offset):
                break
            at, part = offset >> 6, offset.astype(np.uint64) & mask
            window = words[at] << part | np.where(part > 0, words[at + 1] >> (np.uint64(64) - np.maximum(part, 1)), np.uint64(0))
            entry = window >> shift
            out[k, :len(offset)] = self.symbol[entry]
            offset = offset + self.length[entry]
        return out.T.ravel()[:total]


def _codebook(rows: list[tuple[int, int]]) -> Codebook:
    pairs = np.array(rows, np.int64).reshape(-1, 2)
    return Codebook(pairs[:, 0], pairs[:, 1])


def write(encoded: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Write ``doc_id, n_tokens, ids`` as Huffman blocks in ascending doc_id order (see the module's file format)."""
    spark = encoded.sparkSession
    counts = count_ids(encoded).collect()  # one row per id of the vocabulary
    ids, n = np.array([r.id for r in counts], np.int64), np.array([r.n for r in counts], np.int64)
    book = [(int(i), int(b)) for i, b in zip(ids, code_lengths(n))]
    spark.createDataFrame(book, "id bigint, bits bigint").coalesce(1).write.parquet(f"{folder}/codebook")
    sent = spark.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = _codebook(sent.value), TaskContext.get().partitionId()
        docs, held, block, size = [], [], 0, 0

        def close() -> pa.RecordBatch:
            bits, checkpoints = coder.encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([checkpoints], pa.binary()), pa.array([bits], pa.binary())],
                names=["shard", "block", "doc_ids", "lengths", "checkpoints", "bits"])

        for batch in batches:
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                x = unpack(blob)
                docs.append(doc)
                held.append(x)
                size += len(x)
                if size >= BLOCK_IDS:
                    yield close()
                    docs, held, block, size = [], [], block + 1, 0
        if held:
            yield close()

    rows = encoded.filter("counts is null").select("doc_id", "ids")
    ranged = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    ranged.sortWithinPartitions("doc_id").mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids binary`` (little-endian unsigned 32-bit) decoded from the files, block by block."""
    return _read(spark, folder, "ids binary", lambda x: x.astype("<u4").tobytes(), pa.binary())


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the decoded ids; the ids themselves stay in the task."""
    return _read(spark, folder, "ids_crc32 bigint", lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, folder: str, last: str, made, kind) -> DataFrame:
    book = spark.read.parquet(f"{folder}/codebook").collect()
    sent = spark.sparkContext.broadcast([(r.id, r.bits) for r in book])
    blocks = spark.read.parquet(f"{folder}/blocks")

    # ids before each block: inside its shard by a window, before its shard from one row per written partition
    sizes = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sorted(sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([r.n for r in shards]).tolist()
    before = spark.createDataFrame([(r.shard, e - r.n) for r, e in zip(shards, ends)], "shard int, before bigint")
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    starts = sizes.withColumn("inside", inside).join(before, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or _codebook(sent.value)
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                lengths = np.array(row["lengths"].as_py(), np.int64)
                ids = coder.decode(row["bits"].as_py(), row["checkpoints"].as_py(), int(lengths.sum()))
                ends = np.cumsum(lengths)
                docs = row["doc_ids"].values
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(ends - lengths + row["start"].as_py()), pa.array(lengths), pa.array([made(ids[a:b]) for a, b in zip(ends - lengths, ends)], kind)],
                    names=["doc_id", "start", "n_tokens", last.split()[0]])

    return blocks.join(starts, ["shard", "block"]).mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def round_trip(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Encode, write to ``folder``, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    encode_ids(docs, path, end_id).write.parquet(f"{folder}/ids")
    write(spark.read.parquet(f"{folder}/ids"), folder)
    return read_digests(spark, folder)
