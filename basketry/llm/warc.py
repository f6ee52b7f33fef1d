"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: a task writes one ``.warc.gz`` file, each record a gzip member of its own. The members carry the ``sl`` extra field
(compressed and uncompressed length), so a reader can step over a record without inflating it. Files get a name of their
attempt first and their final name when the driver commits; what a lost executor left behind is never read.

Reading: the driver plans partitions of whole files of about ``split_bytes``; predicates on ``record_type`` and other header
columns are pushed down. A task inflates the first ``HEAD`` bytes of a record, parses the headers, and inflates the payload
only if the record passes and the payload is asked for (option ``payload``, default true). Members without the extra field
(other writers' files) are inflated to find their end.

Defined cases: a record without a header has null in its column; a payload may be empty (not null) and is null when it is not
asked for; an archive folder without a record is an empty table; header names are read in any case.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

#: Header of each text column.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
           "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
HEAD, SPLIT_BYTES, ROWS, LEVEL = 4096, 64 << 20, 256, 4
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member with its lengths in front."""
    lines = [f"{name}: " + re.sub(r"[\r\n]+", " ", value) for name, value in headers.items() if value is not None]
    raw = ("WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def http_block(payload: bytes | None, content_type: str = "text/html; charset=utf-8") -> bytes:
    """An HTTP response; without a payload its header alone, as in a revisit."""
    length = "" if payload is None else f"Content-Length: {len(payload)}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\n{length}\r\n".encode() + (payload or b"")


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    """Writes ``record_id, record_type, date, target_uri, payload_digest, refers_to, payload`` (null payload: header only)."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    headers = {HEADERS[c]: row.get(c) for c in HEADERS if c != "content_type"}
                    headers["Content-Type"] = "application/http; msgtype=response"
                    if row["record_type"] == "revisit":
                        headers["WARC-Profile"] = REVISIT_PROFILE
                    out.write(record_bytes(headers, http_block(row["payload"])))
        return _Written(f"{folder}/_{name}", f"{folder}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.temporary)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split_bytes: int):
        self.path, self.payload, self.split_bytes = path, payload, split_bytes
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.wanted.append((column, "prefix", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, folder = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(folder)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(folder, recursive=True))
        out: list[Files] = []
        room = 0
        for f in sorted((f for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.base_name) and f.base_name[0] not in "_."), key=lambda f: f.path):
            if not out or room + f.size > self.split_bytes:
                out.append(Files([]))
                room = 0
            out[-1].paths.append(f.path)
            room += f.size
        return out or [Files([])]

    def passes(self, headers: dict[str, str]) -> bool:
        for column, kind, values in self.wanted:
            value = headers.get(HEADERS[column].lower())
            if value is None or not (value in values if kind == "in" else value.startswith(values[0])):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for headers, payload in records(f, self.passes, self.payload):
                    rows.append((*(headers.get(HEADERS[c].lower()) for c in HEADERS), payload))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=[*HEADERS, "payload"])


def _parse(raw: bytes) -> tuple[dict[str, str], int]:
    """Headers (names in lower case) and where the block begins."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message, or the block itself."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def records(f, passes, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of the records that pass; ``f`` is a seekable file of gzip members, or of plain records."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        start = f.read(24)
        if start[:2] == b"\x1f\x8b":
            skip = struct.unpack("<I", start[16:20])[0] if start[3:4] == b"\x04" and start[12:14] == b"sl" else None
            f.seek(at)
            head = f.read(HEAD if skip is None else min(HEAD, skip))
            inflate = zlib.decompressobj(31)
            raw = inflate.decompress(head)
            read = len(head)
            while b"\r\n\r\n" not in raw and not inflate.eof and (more := f.read(HEAD)):
                raw += inflate.decompress(more)
                read += len(more)
            headers, begin = _parse(raw)
            wanted = passes(headers)
            if not (wanted and payload) and skip:
                at += skip
            else:
                parts = [raw]
                while not inflate.eof and (more := f.read((skip - read) if skip and skip > read else 1 << 16)):
                    parts.append(inflate.decompress(more))
                    read += len(more)
                raw = b"".join(parts)
                at += read - len(inflate.unused_data)
        else:
            raw = start
            while b"\r\n\r\n" not in raw and (more := f.read(HEAD)):
                raw += more
            headers, begin = _parse(raw)
            wanted = passes(headers)
            end = at + begin + int(headers["content-length"])
            if wanted and payload:
                f.seek(at)
                raw = f.read(end - at)
            at = end + 4
        if wanted:
            yield headers, _payload(headers, raw[begin:begin + int(headers["content-length"])]) if payload else None


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload)).load(path)


def write(records_: DataFrame, path: str) -> None:
    records_.sparkSession.dataSource.register(WarcDataSource)
    records_.write.format("warc").mode("append").save(path)


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record per page; of equal payloads of ``least_bytes`` or more the page with the smallest id is the response, others revisit it.

    A null html is an empty payload; rows that repeat a page_id are a record each (equal ones all responses or all revisits); a
    null page_id is always a response and never revisited. The pages' texts are shuffled once, by page; equal payloads meet by
    digest alone, combined before the shuffle.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    keyed = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least_bytes)
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").drop("last")
    revisits = keyed.join(firsts, "digest").filter("page_id <> first").select("page_id", "digest", "first").distinct()
    both = rows.withColumn("digest", F.sha2("payload", 256)).join(revisits, ["page_id", "digest"], "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return both.select(
        urn("page_id").alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.lit(date).alias("date"),
        F.col("url").alias("target_uri"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), urn("first").alias("refers_to"),
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` to an archive and read it back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Bytes and digests are computed from the payloads read; a revisit has those of the response it refers to.
    """
    spark = pages.sparkSession
    write(page_records(pages), path)
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    responses = read(spark, path).filter(F.col("record_type") == "response").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    revisits = read(spark, path, payload=False).filter(F.col("record_type") == "revisit").select(
        number("record_id").alias("page_id"), number("refers_to").alias("refers_to"), F.substring_index("payload_digest", ":", -1).alias("claimed"))
    sources = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    found = revisits.join(sources, (revisits.refers_to == sources.refers_to) & (F.col("claimed") == F.col("payload_digest")), "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), revisits.refers_to)
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(found)


SQL = """
WITH k AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
