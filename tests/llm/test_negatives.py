import math

import duckdb
import numpy as np

from basketry.llm import negatives, registry


def brute(rows, every=100):
    good = {}
    for i, v, label in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        good.setdefault(i, (((label + 1) % 10 if i % 7 == 0 else label), [math.floor(256 * float(x)) for x in v]))
    out = []
    for a, (label, v) in good.items():
        if a % every == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in good.items() if i != a and len(v) == len(w))
            for p, pid, _ in [x for x in s if x[2] == label][:5]:
                out += [(a, pid, k, i, -p, -n) for k, (n, i) in enumerate([(n, i) for n, i, other in s if other != label and 30 * -p <= 100 * -n <= 90 * -p][:10], 1)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 150)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 37)) / 6
    rows = [(k, [float(x) for x in centres[k % 6] + rng.standard_normal(37) * rng.choice([0.01, 0.05, 0.2])], int(rng.integers(0, 4))) for k in range(900)]
    rows += [(k, rows[100][1], 1) for k in range(1000, 1400)]  # ties: one vector many times
    rows += [(2000, None, 1), (2001, [0.1] * 37, None), (2002, [None] * 37, 1), (2003, [float("nan")] * 37, 1), (None, [0.1] * 37, 1), (2100, [0.0] * 37, 2), (2200, [], 1), (2201, [], 2)]
    rows += [(300, rows[300][1], rows[300][2]), (301, [9.0] * 37, 3), (2300, [0.5, 0.5], 1), (2301, [0.5, 0.4], 1), (2303, [0.3, 0.2], 2), (2400, [-1e-9] * 37, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, v string, rank int").repartition(5)
    got = negatives.mined(df)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute(rows)


def test_query_equals_sql(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet'")
    cur = con.execute(negatives.SQL)
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, registry.QUERIES["op12_hard_negatives"](spark, tables).select(*names).collect())) == sorted(cur.fetchall())


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(5)
    v = np.floor(rng.standard_normal((60, 48)).cumsum(axis=1) * 40)
    exact = v @ v.T
    width = []
    for mean, far in zip(*negatives.summaries(v)):
        middle, spread = mean @ mean.T, far @ far.T
        assert (middle + spread >= exact - 1e-6).all() and (middle - spread <= exact + 1e-6).all()
        width.append(spread.mean())
    assert width == sorted(width, reverse=True)


def test_segments_spare_scores():
    """Smooth vectors, whose segments say nearly all: few of the rows met are scored."""
    rng = np.random.default_rng(6)
    v = np.floor(np.repeat(rng.standard_normal((3000, 8)), 8, axis=1) * 200 + rng.standard_normal((3000, 64)) * 5)
    ids, labels = np.arange(3000), rng.integers(0, 3, 3000)
    search = negatives.Search(ids[:20], labels[:20], v[:20], False, 10, [[(0, 10**9)]] * 20)
    for a in range(0, 3000, 500):
        search.feed(ids[a:a + 500], labels[a:a + 500], v[a:a + 500])
    assert search.scored < 0.2 * search.met
    for i in range(20):
        s = sorted((-int(v[i] @ v[j]), j) for j in range(3000) if labels[j] != labels[i] and 0 <= v[i] @ v[j] <= 10**9)[:10]
        assert [(-a, b) for a, b in s] == list(zip(search.found[i][0][0].tolist(), search.found[i][0][1].tolist()))


def test_large_values_and_empty(spark):
    rows = [(0, [1e300, 1.0], 0), (100, [3e18, 1.0], 1), (1, [1e300, 2.0], 0), (2, [-1e300, 0.0], 1), (3, [1.0, 1.0], 1), (5, [2e18, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = negatives.mined(df).collect()
    assert all(abs(r.positive_score) < 2**63 for r in got)
    assert negatives.mined(df.limit(0)).count() == 0
