import random

from pyspark.sql import functions as F

from basketry.operators import communities as C, graph as G


def planted(groups=6, size=8, seed=3):
    """Dense groups with few links between them."""
    rng = random.Random(seed)
    names = [[f"g{g}n{k}" for k in range(size)] for g in range(groups)]
    rows = [(a, b, 2.0) for g in names for i, a in enumerate(g) for b in g[i + 1:] if rng.random() < 0.8]
    rows += [(min(x, y), max(x, y), 1.0) for g in range(groups) for x, y in [(rng.choice(names[g]), rng.choice(names[(g + 1) % groups]))]]
    return rows, {n: g for g, ns in enumerate(names) for n in ns}


def rounds_of(monkeypatch):
    seen = []
    real = C._move_round
    monkeypatch.setattr(C, "_move_round", lambda *a: seen.append(1) or real(*a))
    return seen


def test_planted_groups_are_found(spark, monkeypatch):
    rows, group = planted()
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    seen = rounds_of(monkeypatch)
    part = {r.node: r.community for r in C.louvain(edges).collect()}
    assert len(set(part.values())) == 6 and all((part[a] == part[b]) == (group[a] == group[b]) for a in part for b in part)
    assert len(seen) < 40


def test_no_change_no_round_and_few_changes_few_moves(spark, monkeypatch):
    rows, group = planted()
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    part = C.canonical(spark.createDataFrame([(n, str(g)) for n, g in group.items()], "node string, community string")).cache()
    seen = rounds_of(monkeypatch)
    same = C.louvain_incremental(edges, part)
    assert not seen and sorted(same.collect()) == sorted(part.select(same.columns).collect())
    more = edges.unionByName(spark.createDataFrame([("g0n0", "new", 5.0), ("g0n1", "new", 5.0)], "src string, dst string, weight double"))
    got = C.louvain_incremental(more, part)
    assert 0 < len(seen) <= 8
    q = [G.modularity(more, p).first()[0] for p in (got, C.louvain(more))]
    assert abs(q[0] - q[1]) < 1e-9
    assert {r.community for r in got.filter(F.col("node").isin("new", "g0n0")).collect()} == {"g0n0"}
