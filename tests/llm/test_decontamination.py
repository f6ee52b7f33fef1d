import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import decontamination as D, registry


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return [tuple(w[k:k + 5]) for k in range(len(w) - 4)]


def brute(texts, items):
    items = {k: s for k, t in items.items() if (s := shingles(t))}
    m = Counter(x for s in items.values() for x in set(s))
    weight = lambda x: np.log1p(len(items) / m[x]) if x in m else np.log1p(len(items))
    out = {}
    for d, t in texts.items():
        s = shingles(t)
        for i, v in items.items():
            want = Counter(v)
            for p in range(max(1, len(s) - len(v) + 1)):
                c = Counter(s[p:p + len(v)])
                if c.keys() & want.keys():
                    j = sum(weight(x) * n for x, n in (c & want).items()) / sum(weight(x) * n for x, n in (c | want).items())
                    if j >= D.THRESHOLD:
                        out[d, i] = max(out.get((d, i), 0), j)
    return out


def close(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_equals_brute_force(spark, tables):
    texts = {r.doc_id: r.text for r in registry.table(spark, tables, "documents").collect()}
    items = {r.item_id: r.text for r in registry.table(spark, tables, "benchmark").collect()}
    close({(r.doc_id, r.item_id): r.similarity for r in registry.QUERIES["op5_decontamination"](spark, tables).collect()}, brute(texts, items))


def test_edits_and_defined_cases(spark, docs):
    base = [f"word{k}" for k in range(80)]
    item = " ".join(base)
    one = " ".join(base[:40] + ["other"] + base[41:])
    texts = ["before it " + item + " after it", one, "x " + " ".join(base[:78]), " ".join(base[20:60]), None, "", "few words", item, item, "noise " * 50000 + item.upper() + ".", " ".join(base[::-1])]
    bench = spark.createDataFrame([(1, item, 0), (2, "few words", 0), (3, None, 0), (4, "quite another item of eight words is here", 0), (5, item, 0)], "item_id bigint, text string, row int")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.matches(docs(texts), bench).collect()}
    close(got, brute(dict(enumerate(texts)), {r.item_id: r.text for r in bench.collect()}))
    assert {k for k, _ in got} == {0, 1, 2, 7, 8, 9}
    assert D.matches(docs([]), bench).count() == 0 and D.matches(docs(texts), bench.limit(0)).count() == 0
    repeated = D.matches(docs([item, item, "z " + item], [5, 5, None]), bench.filter("item_id = 1")).collect()
    assert sorted(str(r.doc_id) for r in repeated) == ["5", "None"]


def test_blocks_guarantee_the_radius(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        a = int(rng.integers(-2**63, 2**63 - 1))
        flips = rng.choice(64, int(rng.integers(0, D.RADIUS + 1)), replace=False)
        b = (a & (2**64 - 1)) ^ sum(1 << int(f) for f in flips)
        rows.append((a, b - 2**64 if b >= 2**63 else b))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    assert df.filter(~F.arrays_overlap(D.blocks(F.col("a")), D.blocks(F.col("b")))).count() == 0


def test_no_python_in_the_plan(spark, tables):
    plan = registry.QUERIES["op5_decontamination"](spark, tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
