"""Keyed state of micro-batches as a table of key-hash buckets, so that a batch writes what it changes and not the state.

Each batch writes one part for every bucket it touches, of its own rows alone, and a manifest row per part. A bucket is the
merge of its parts: the last row of a key (``last``, with deletions as rows of their own) or the sum of a key's rows (``sum``).
A bucket of ``max_parts`` parts is rewritten whole by the next batch that touches it, which starts it anew as a base; so
a row is rewritten once in ``max_parts`` batches of its bucket, and reading a bucket merges a bounded number of parts. Reading by
keys opens their buckets only.

A batch replayed after a failure sees the parts of earlier batches and overwrites its own part and manifest rows: the manifest is written last,
so a part without one does not exist. ``vacuum`` deletes parts that no state from the given batch on needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

MANIFEST = "bucket int, base boolean, n_rows long, batch long"


class BucketedTable:
    """State of ``schema`` at ``path``, by ``keys``; ``sums`` names the columns that add up, without them the last row of a key counts.

    With ``sums``, keys whose first sum is zero are left out. Driver traffic is a row per touched bucket.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], sums: Sequence[str] = (), buckets: int = 32, max_parts: int = 8):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.sums, self.buckets, self.max_parts = list(keys), list(sums), buckets, max_parts
        self.stored = f"{schema}, deleted boolean, batch long"

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def parts(self, before: int | None = None) -> list[Row]:
        """Manifest rows of the parts that make up the state before a batch: of each bucket its newest base and what follows."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing written yet
            return []
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        newest = rows.filter("base").groupBy("bucket").agg(F.max("batch").alias("_from"))
        return rows.join(newest, "bucket", "left").filter(F.col("batch") >= F.coalesce("_from", F.lit(-1))).drop("_from").collect()  # at most buckets x max_parts

    def _load(self, parts: list[Row]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[f"{self.path}/data/v{p.batch}/bucket={p.bucket}" for p in parts])

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key, deletions included."""
        if self.sums:
            return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums], F.lit(False).alias("deleted"), F.max("batch").alias("batch"))
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), "batch").alias("_r")).select("_r.*")

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(self.sums[0]) != 0) if self.sums else rows.filter(~F.col("deleted"))

    def read(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The state before a batch (or now); with ``of``, only the rows whose keys are in it, from their buckets."""
        parts = self.parts(before)
        if of is not None:
            wanted = of.select(*self.keys).distinct()
            touched = {r.b for r in wanted.select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets`` numbers
            parts = [p for p in parts if p.bucket in touched]
        rows = self._load(parts)
        if of is not None:
            rows = rows.join(wanted, self.keys, "left_semi")
        names = self.spark.createDataFrame([], self.schema).columns
        return self._alive(self._merged(rows)).select(*names)

    def write(self, changes: DataFrame, batch: int) -> dict[int, int]:
        """Apply ``changes`` (the schema, and ``deleted`` for rows that go) as batch number ``batch``; rows written per bucket.

        ``changes`` is read twice and must give the same rows: hand in a written table.
        """
        if "deleted" not in changes.columns:
            changes = changes.withColumn("deleted", F.lit(False))
        names = [f.name for f in self.spark.createDataFrame([], self.stored).schema]
        fresh = self._merged(changes.withColumn("batch", F.lit(batch).cast("long")).select(*names)).select(*names)
        old: dict[int, list[Row]] = {}
        for p in self.parts(batch):
            old.setdefault(p.bucket, []).append(p)
        touched = [r.b for r in changes.select(self._bucket().alias("b")).distinct().collect()]
        whole = [b for b in touched if len(old.get(b, [])) >= self.max_parts]
        if whole:
            rows = self._merged(fresh.unionByName(self._load([p for b in whole for p in old[b]]).select(*names)))
            rows = rows.select(*names, self._bucket().alias("bucket"))
            fresh = rows.filter(~F.col("bucket").isin(whole) | (F.col(self.sums[0]) != 0 if self.sums else ~F.col("deleted")))  # a base needs no deletions
        else:
            fresh = fresh.withColumn("bucket", self._bucket())
        data = f"{self.path}/data/v{batch}"
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        counted = self.spark.read.schema(self.stored + ", bucket int").parquet(data).groupBy("bucket").count().collect() if touched else []
        written = {r.bucket: r["count"] for r in counted}
        # a bucket rewritten to nothing has no part, but its older parts must not come back
        gone = [b for b in whole if b not in written]
        for b in gone:
            self.spark.createDataFrame([], self.stored).coalesce(1).write.mode("overwrite").parquet(f"{data}/bucket={b}")
        rows = [(b, b in whole, written.get(b, 0), batch) for b in {*written, *gone}]
        self.spark.createDataFrame(rows, MANIFEST).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        return written

    def vacuum(self, batch: int) -> int:
        """Delete parts older than the base that the state before ``batch`` starts from, in each bucket; how many went."""
        needed = {(p.bucket, p.batch) for p in self.parts(batch)} | {(p.bucket, p.batch) for p in self.parts()}
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").filter(F.col("batch") < batch).collect()
        except AnalysisException:
            return 0
        old = [p for p in rows if (p.bucket, p.batch) not in needed]
        for p in old:
            store, folder = fs.FileSystem.from_uri(f"{self.path}/data/v{p.batch}/bucket={p.bucket}")
            if store.get_file_info(folder).type == fs.FileType.Directory:
                store.delete_dir(folder)
        return len(old)

