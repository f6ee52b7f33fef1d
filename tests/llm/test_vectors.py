import duckdb
import numpy as np

from basketry.llm import registry, vectors


def brute(rows):
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: l for i, _, l in rows}
    links = {i: {j for j in good if i in good and j != i and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.93} for i, _, _ in rows}
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 48))
    v = [centres[k % 12] + rng.standard_normal(48) * rng.choice([0.05, 0.2, 0.27, 0.35]) for k in range(330)]
    rows = [(k, [float(x) for x in a], int(k % 2 if k > 200 else 1)) for k, a in enumerate(v)]
    rows += [(400, rows[3][1], rows[3][2]), (401, rows[3][1], rows[3][2]), (402, [2 * x for x in rows[3][1]], rows[3][2]), (403, None, 1), (404, [0.0] * 48, 1), (405, [float("nan")] * 48, 1),
             (406, [None] * 48, 1), (407, rows[3][1], None), (408, [], 1), (409, [1.0, 2.0], 1), (410, [1.0, 2.0], 1), (411, [1e300] * 48, 0), (412, [1e300] * 48, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, node string, key int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    want = brute([r for r in rows if r[0] < 411]) | {411: (1, 411), 412: (1, 411)}
    assert got == want


def test_query_equals_sql(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({vectors.SQL})").fetchall()
    got = registry.QUERIES["op3_embedding_near_dedup"](spark, tables).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_and_calibration(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vectors.near_duplicates(empty).count() == 0
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    axis = vectors.lines_for(64)
    half = vectors.WIDTH * np.sqrt(2 - 2 * 0.93)
    i, j = vectors.colliding(a[:500] @ axis, near[:500] @ axis, half, vectors.least_collisions())
    assert (i == j).sum() == 500 and len(i) < 500 + 0.01 * 500 * 500
