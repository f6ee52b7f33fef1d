import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import links as L


@pytest.fixture(scope="module")
def edges(spark):
    """A few hubs that share many neighbours, and many nodes of small degree."""
    rng, rows = random.Random(8), set()
    for k in range(900):
        a, b = (rng.randrange(12) if rng.random() < 0.4 else rng.randrange(300) for _ in range(2))
        if a != b:
            rows.add((f"n{min(a, b):03d}", f"n{max(a, b):03d}"))
    return spark.createDataFrame([(*r, 1.0) for r in sorted(rows)], "src string, dst string, weight double").cache()


@pytest.mark.parametrize("method", sorted(L.SUMMED))
def test_same_rows_from_fewer_pairs(spark, edges, monkeypatch, method):
    formed = []
    real = L.pairs_in_groups
    monkeypatch.setattr(L, "pairs_in_groups", lambda *a, **k: formed.append(real(*a, **k)) or formed[-1])
    got = [tuple(r) for r in L.top_links(edges, method, 12, digits=9).collect()]
    few = sum(df.count() for df in formed)
    all_ = L.neighbour_scores(edges).select("item_a", "item_b", F.round(F.col(method).cast("double"), 9).alias("s")).orderBy(F.desc("s"), "item_a", "item_b").limit(12).collect()
    assert got == [(r.item_a, r.item_b, r.s, method) for r in all_]
    assert few < 0.7 * real(L.symmetric(edges), "u", "v").count()


def test_fewer_pairs_than_asked_for(spark):
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    assert [tuple(r)[:3] for r in L.top_links(path, "common_neighbors", 50).collect()] == [("a", "c", 1.0)]
    assert L.top_links(path.limit(0), "adamic_adar", 5).count() == 0
    with pytest.raises(ValueError):
        L.top_links(path, "jaccard")
