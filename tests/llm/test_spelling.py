import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from basketry.llm import registry, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows, every=199):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_equals_brute_force(spark, docs):
    base = ["colour", "color", "colours", "coulor", "culour", "éclair", "eclair", "ÉCLAIR", "thrown", "throne", "letter", "lettre", "aaaaaa", "aaaaaaa", "aaaaab", "banana", "bananas", "bandana", "a" * 70 + "b", "a" * 71]
    texts = [f"{w} " * (5 * (k % 7) ** 2 + 5) for k, w in enumerate(base)] + ["chains " * 5, "chainss " * 30, "chainsss " * 160, "Chainssss " * 900] + [None, "", "123 × ÷", "tiny abcde abcde abcde abcde abcde", "x" * 50000]
    rows = list(enumerate(texts)) * 2 + [(None, "nulled " * 6)]
    df = spark.createDataFrame([(i, t, "z", 1, "y") for i, t in rows], "doc_id bigint, text string, word string, n int, letters string")
    got = sorted(map(tuple, spelling.spelling_variants(df).select(COLUMNS).collect()))
    want = brute(words_of(rows))
    assert got == want and len({r[2] for r in got if r[0].startswith("chains")}) == 1
    assert any(r[1] for r in got)


def test_near_pairs_of_many_words(spark, monkeypatch):
    """Classes of many words of the same letters, in several chunks."""
    monkeypatch.setattr(spelling, "CHUNK", 5)
    import itertools

    words = sorted({"".join(p) for p in itertools.permutations("abcdef")})[::5] + sorted({"".join(p) for p in itertools.permutations("abcdee")})[::7] + ["abcdefg", "gabcdef", "abcef", "bacdefa"]
    words = [w for w in words if len(w) >= 6]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    got = Counter((r.word, r.near) for r in spelling.near_words(df).collect())
    assert got == Counter((a, b) for a in words for b in words if one_edit(a, b))


@pytest.mark.parametrize("parts", [4, 7, 10])
def test_any_number_of_parts(spark, monkeypatch, parts):
    monkeypatch.setattr(spelling, "PARTS", parts)
    words = ["stream", "streams", "strema", "stroam", "steam", "xtream", "streaam", "tream", "master", "maters", "mastre", "masters", "smaster", "maxter"]
    words = [w for w in words if len(w) >= 6]
    got = Counter((r.word, r.near) for r in spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")).collect())
    assert got == Counter((a, b) for a in words for b in words if one_edit(a, b))


def test_query_equals_sql(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({spelling.SQL})").fetchall(), key=repr)
    assert sorted(map(tuple, registry.QUERIES["op13_spelling_variants"](spark, tables).select(COLUMNS).collect()), key=repr) == want


def test_damage_and_empty(spark, docs):
    df = docs(["alpha beta gamma delta"] * 60)
    got = Counter(r.w for r in spelling.runs(df).select(spelling.damaged(F.col("doc_id"), F.col("run"), 3).alias("w")).collect())
    want = Counter()
    for k in range(60):
        for run in "alpha beta gamma delta".split():
            h = zlib.crc32(f"{k}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 3 == 0 else run] += 1
    assert got == want
    assert spelling.spelling_variants(docs([])).count() == 0
