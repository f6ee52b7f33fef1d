import gzip

import duckdb
from pyspark.sql import functions as F

from basketry.llm import registry, warc


def test_query_equals_sql(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tables}/pages.parquet'")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    got = registry.QUERIES["op2_warc"](spark, tables).select(*names.split(", ")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(f"SELECT {names} FROM ({warc.SQL})").fetchall()))


def test_defined_cases(spark, tmp_path):
    long = "é<p>" * 60
    rows = [(1, "u\r\nv", long, 1), (0, None, long, 1), (2, "u", None, 1), (3, "u", "", 1), (4, "u", "short", 1), (5, "u", "short", 1), (7, "w", "x" * 300000, 1), (8, "w", "x" * 300000, 1), (8, "w", "x" * 300000, 1), (None, "n", long, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    path = f"file://{tmp_path}/a"
    got = sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, path).collect())
    assert got == [(-1, 300, "response", None), (0, 300, "response", None), (1, 300, "revisit", 0), (2, 0, "response", None), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None),
                   (7, 300000, "response", None), (8, 300000, "revisit", 7), (8, 300000, "revisit", 7)]
    df = warc.read(spark, path)
    assert df.filter(F.col("target_uri") == "w").count() == 3 and df.filter(F.col("target_uri").startswith("u ")).count() == 1
    assert df.filter(F.col("record_type").isin("revisit", "other")).count() == 3 and df.filter("refers_to is null").count() == 7
    assert {r.payload for r in warc.read(spark, path, payload=False).collect()} == {None}
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/b").count() == 0


def test_files_of_others(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nwarc-type: resource\r\nContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (tmp_path / "p.warc").write_bytes(record(b"one") + record(b"") + record(b"x" * 9000))
    (tmp_path / "q.warc.gz").write_bytes(gzip.compress(record(b"two")) + gzip.compress(record(b"y" * 90000)))
    (tmp_path / "_left.warc.gz").write_bytes(b"half a fi")
    got = sorted(bytes(r.payload) for r in warc.read(spark, f"file://{tmp_path}").filter("record_type = 'resource'").collect())
    assert got == [b"", b"one", b"two", b"x" * 9000, b"y" * 90000]


def test_members_can_be_stepped_over():
    member = warc.record_bytes({"WARC-Type": "response"}, warc.http_block(b"z" * 5000))
    assert gzip.decompress(member).endswith(b"z\r\n\r\n") and int.from_bytes(member[16:20], "little") == len(member)
