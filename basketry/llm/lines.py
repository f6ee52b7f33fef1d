"""Reversible line de-duplication: sharded cuckoo filters backed by exact reference-count tables.

State (``LineStore``), a folder of versions, each with two Parquet tables:

* ``references`` (key, doc_id): which document holds which line key, once each. The number of rows of a key is its exact
  reference count, its largest doc_id the document that keeps the line. A key is the 128-bit MD5 of the normalised line.
* ``filters`` (shard, filter): a cuckoo filter per shard of the keys whose reference count has reached ``min_docs``. The
  number of shards follows the number of such keys: about ``SHARD_KEYS`` a filter, and when they outgrow twice the room of
  the shards, all filters are built anew in more of them. A filter that is full is built anew, larger, from its shard's keys.

``insert`` adds documents and puts the keys that reach the count into their filters; ``delete`` takes documents out and takes
the keys that fall below it out again (a cuckoo filter, unlike a Bloom filter, can). Both write a new version; whatever
order of insertions and deletions led to a set of documents, the decisions are those of a store built from it at once.

``clean`` decides: every line is looked up in its shard's filter, which settles most lines without any join; the
survivors alone (true repeats and the filter's rare false positives) are joined with the exact counts, so a false
positive costs a row and never a wrong drop. Filters are sent to the tasks in rounds of at most ``SENT_BYTES``; more filters
mean more rounds, not more memory.

Hot lines: counts are combined before the shuffle, the join of surviving lines is an ordinary equi-join of two shuffled
tables that Spark splits when one key is hot, and no group is ever gathered.

Defined cases: a null or empty text is one empty line (never dropped, as keys have ``min_length`` code points); rows that
repeat a doc_id are cleaned each and count as one document; a null doc_id is a document too, and the smallest of all; a line
that occurs twice in the keeping document stays twice; other columns are passed through,
but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.lineage import cut_lineage
from .textkit import text_slices

#: Keys per filter, bytes of filters sent to the tasks at once.
SHARD_KEYS, SENT_BYTES = 1 << 18, 32 << 20
#: Cuckoo filter: entries per bucket, load at most, moves before a filter counts as full.
ENTRIES, LOAD, MOVES = 4, 0.85, 500

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = {c: c + 32 for c in range(65, 91)}


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with ASCII letters lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shard_and_rest(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From 16-byte keys: the number that picks the shard and the one that the filter uses."""
    parts = key.view("<u8").reshape(-1, 2)
    return parts[:, 0], parts[:, 1]


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets, the second known from either and the fingerprint."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def empty(keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(keys / (ENTRIES * LOAD))) - 1).bit_length()
        return CuckooFilter(np.zeros((buckets, ENTRIES), np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        print_ = (keys >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (keys & mask).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return bucket ^ ((print_.astype(np.uint64) * np.uint64(0x5BD1E995A7C15F4D) >> np.uint64(20)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(keys)
        return (self.table[first] == print_[:, None]).any(axis=1) | (self.table[second] == print_[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add every key (a key added twice is held twice); False when a key found no place."""
        print_, first, second = self._places(keys)
        for turn in range(2):  # first those that fit without moving, one per bucket and round
            which = second if turn else first
            left = np.arange(len(print_))
            for slot in range(ENTRIES):
                free = left[self.table[which[left], slot] == 0]
                _, one = np.unique(which[free], return_index=True)
                put = free[one]
                self.table[which[put], slot] = print_[put]
                left = np.setdiff1d(left, put, assume_unique=True)
            print_, first, second = print_[left], first[left], second[left]
        for k in range(len(print_)):
            if not self._move(print_[k], int(second[k]), k):
                return False
        return True

    def _move(self, print_: np.uint16, bucket: int, turn: int) -> bool:
        for step in range(MOVES):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
            slot = (turn + step) % ENTRIES
            print_, self.table[bucket, slot] = self.table[bucket, slot], print_
            bucket = int(self._other(np.array([bucket]), np.array([print_], np.uint16))[0])
        return False

    def has_room(self, keys: int) -> bool:
        return np.count_nonzero(self.table) + keys <= LOAD * self.table.size

    def delete(self, keys: np.ndarray) -> None:
        """Take out one entry of every key; the keys must have been added."""
        for p, *buckets in zip(*self._places(keys)):
            for b in buckets:
                at = np.flatnonzero(self.table[b] == p)
                if len(at):
                    self.table[b, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        return CuckooFilter(np.frombuffer(data, "<u2").reshape(-1, ENTRIES).copy())

    @staticmethod
    def of(keys: np.ndarray) -> CuckooFilter:
        size = max(len(keys), 8)
        while True:
            made = CuckooFilter.empty(size)
            if made.insert(keys):
                return made
            size *= 2


_FILTERS = "shard int, filter binary"


def _keys_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


class LineStore:
    """Counts and filters of the lines of a changing set of documents, in a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 3, min_length: int = 20, doc_id: str = "doc_id", text: str = "text"):
        self.spark, self.folder, self.min_docs, self.min_length, self.doc_id, self.text = spark, folder, min_docs, min_length, doc_id, text
        self.version: str | None = None
        self.shards = 1

    # --- state --------------------------------------------------------------------------------------------------

    def references(self) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], "key binary, doc_id bigint")
        return self.spark.read.parquet(f"{self.version}/references")

    def counts(self) -> DataFrame:
        """``key, n_docs, last_doc`` of every key: the exact reference counts."""
        return self._counted(self.references())

    def _counted(self, references: DataFrame) -> DataFrame:
        return references.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def filters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.version}/filters")

    def _refs_of(self, docs: DataFrame) -> DataFrame:
        keys = F.array_distinct(F.transform(F.filter(F.transform(lines_of(F.col(self.text)), line_key), lambda k: F.char_length(k) >= self.min_length),
                                            lambda k: F.unhex(F.md5(k))))
        return docs.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.explode(keys).alias("key")).select("key", "doc_id").distinct()

    def _repeated(self, references: DataFrame) -> DataFrame:
        return self._counted(references).filter(F.col("n_docs") >= self.min_docs)

    def _commit(self, references: DataFrame) -> None:
        """Write the references, then the filters: those of shards whose keys changed by insertion and deletion."""
        new = f"{self.folder}/{uuid.uuid4().hex}"
        references.write.parquet(f"{new}/references")
        after = cut_lineage(self._repeated(self.spark.read.parquet(f"{new}/references")).select("key"))
        wanted = max(1, -(-after.count() // SHARD_KEYS))
        if self.version is None or wanted > 2 * self.shards:
            self.shards = wanted
            self._sharded(after).groupBy("shard").applyInArrow(_build, _FILTERS).write.parquet(f"{new}/filters")
        else:
            before = self._repeated(self.references()).select("key")
            added = after.join(before, "key", "left_anti").withColumn("_add", F.lit(True))
            gone = before.join(after, "key", "left_anti").withColumn("_add", F.lit(False))
            old = self.filters()
            changed = cut_lineage(self._sharded(added.unionByName(gone)).groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_change, _FILTERS))
            full = changed.filter("filter is null").select("shard")
            built = self._sharded(after).join(full, "shard", "left_semi").groupBy("shard").applyInArrow(_build, _FILTERS)
            changed.filter("filter is not null").unionByName(built).write.parquet(f"{new}/filters")
        self.version = new

    def _sharded(self, keys: DataFrame) -> DataFrame:
        number = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
        return keys.withColumn("shard", F.pmod(number, F.lit(self.shards)).cast("int"))

    # --- changes ------------------------------------------------------------------------------------------------

    def insert(self, docs: DataFrame) -> None:
        """Add documents; one that is there already gains the lines that it did not have."""
        new = self._refs_of(docs)
        self._commit(new if self.version is None else self.references().unionByName(new).distinct())

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents out (``doc_id``)."""
        ids = doc_ids.select(F.col(self.doc_id).cast("long").alias("doc_id")).distinct()
        old = self.references()
        self._commit(old.join(ids, old.doc_id.eqNullSafe(ids.doc_id), "left_anti"))

    # --- decisions ----------------------------------------------------------------------------------------------

    def _survivors(self, docs: DataFrame) -> DataFrame:
        """``doc_id, key`` of the lines that some filter knows."""
        sizes = self.filters().select("shard", F.octet_length("filter").alias("bytes")).orderBy("shard").collect()  # a row per shard
        rounds, room = [[]], 0
        for shard, size in sizes:
            if room + size > SENT_BYTES and rounds[-1]:
                rounds.append([])
                room = 0
            rounds[-1].append(shard)
            room += size
        found = []
        for part in rounds:
            rows = self.filters().filter(F.col("shard").isin(part)).collect()  # at most SENT_BYTES
            sent = self.spark.sparkContext.broadcast({r.shard: bytes(r["filter"]) for r in rows})
            found.append(docs.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.text).alias("_text")).mapInArrow(
                _probe(sent, self.shards, self.min_length), "doc_id bigint, key binary"))
        return reduce(DataFrame.unionByName, found)

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with its text without the dropped lines, ``n_lines`` (before) and ``n_dropped``."""
        repeated = cut_lineage(self._repeated(self.references()))
        survivors = self._survivors(docs)
        drop = survivors.join(repeated, "key").filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        drop = drop.groupBy("doc_id").agg(F.collect_set("key").alias("_keys")).withColumnRenamed("doc_id", "_doc")
        # the row travels as one value, so that no column of the caller's meets one of these
        rows = docs.select(F.struct("*").alias("row"), F.col(self.doc_id).cast("long").alias("id"), lines_of(F.col(self.text)).alias("lines"))
        joined = rows.join(drop, F.col("id").eqNullSafe(F.col("_doc")), "left")
        kept = F.when(F.col("_keys").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("_keys", F.unhex(F.md5(line_key(x))))))
        done = joined.select("row", F.size("lines").cast("long").alias("n"), kept.alias("kept"))
        own = [F.array_join("kept", "\n").alias(c) if c == self.text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
        return done.select(*own, F.col("n").alias("n_lines"), (F.col("n") - F.size("kept")).alias("n_dropped"))


def _build(key: tuple, table: pa.Table) -> pa.Table:
    _, rest = shard_and_rest(_keys_array(table.column("key").combine_chunks()))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([CuckooFilter.of(rest).to_bytes()], pa.binary())})


def _change(key: tuple, changes: pa.Table, old: pa.Table) -> pa.Table:
    """The shard's filter with its changes, or null when they do not fit."""
    made = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter.empty(8)
    if changes.num_rows:
        _, rest = shard_and_rest(_keys_array(changes.column("key").combine_chunks()))
        add = np.asarray(changes.column("_add").combine_chunks())
        made.delete(rest[~add])
        if not made.has_room(add.sum()) or not made.insert(rest[add]):
            made = None
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made and made.to_bytes()], pa.binary())})


def _probe(sent, shards: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
        md5 = hashlib.md5
        for batch in batches:
            for part in text_slices(batch, "_text"):
                owner, keys = [], []
                for k, text in enumerate(part.column("_text").to_pylist()):
                    if text and len(text) >= min_length:
                        found = {md5(s.translate(_UPPER).encode()).digest() for s in (x.strip(_BLANKS) for x in text.split("\n")) if len(s) >= min_length}
                        keys += found
                        owner += [k] * len(found)
                if not keys:
                    continue
                array = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
                _, rest = shard_and_rest(array)
                number = array[:, 0].astype(np.int64) << 24 | array[:, 1].astype(np.int64) << 16 | array[:, 2].astype(np.int64) << 8 | array[:, 3]
                shard = number % shards
                hit = np.zeros(len(rest), bool)
                for s, f in filters.items():
                    mine = np.flatnonzero(shard == s)
                    hit[mine] = f.contains(rest[mine])
                at = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(np.array(owner, np.int64)[at])), pa.array([keys[k] for k in at], pa.binary())], names=["doc_id", "key"])

    return run


SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, pos, line, c.key IS NOT NULL AND k.doc_id <> last_doc AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""
