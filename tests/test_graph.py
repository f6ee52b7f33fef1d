from itertools import combinations
import math
import random

import pytest

from basketry.operators import communities as C, graph as G, links as L

E6 = [("A", "B", 5.0), ("B", "C", 5.0), ("C", "D", 5.0), ("D", "E", 5.0), ("A", "C", 2.0), ("B", "D", 1.0)]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w), int(w)) for a, b, w in rows], "src string, dst string, weight double, count long")


def random_graph(n, p, seed):
    rng = random.Random(seed)
    return [(f"n{a:02d}", f"n{b:02d}", 1) for a, b in combinations(range(n), 2) if rng.random() < p]


def adjacency(rows):
    adj = {}
    for a, b, _ in rows:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def test_path_scores(spark):
    r = L.neighbour_scores(edges(spark, [("A", "B", 1), ("B", "C", 1)])).collect()
    assert len(r) == 1 and r[0].common_neighbors == 1 and r[0].jaccard == 1.0
    assert abs(r[0].adamic_adar - 1 / math.log(2)) < 1e-12 and r[0].resource_allocation == 0.5
    assert L.predict_links(edges(spark, [("A", "B", 1), ("B", "C", 1)]), "preferential_attachment").first().score == 1.0


@pytest.mark.parametrize("seed,n,p", [(1, 14, 0.3), (2, 20, 0.7), (3, 12, 0.15)])
def test_preferential_attachment_and_zero_pairs_equal_brute_force(spark, seed, n, p):
    rows = random_graph(n, p, seed)
    adj = adjacency(rows)
    non = [(a, b) for a, b in combinations(sorted(adj), 2) if b not in adj[a]]
    top = sorted(((-len(adj[a]) * len(adj[b]), a, b) for a, b in non))[:7]
    e = edges(spark, rows)
    got = [(-r.score, r.item_a, r.item_b) for r in L.predict_links(e, "preferential_attachment", 7).collect()]
    assert sorted(got) == sorted((float(s), a, b) for s, a, b in top)
    scored = L.neighbour_scores(e)
    zero = sorted((a, b) for a, b in non if not adj[a] & adj[b])[:9]
    assert sorted((r.item_a, r.item_b) for r in L.zero_pairs(e, scored, 9).collect()) == zero
    everything = L.predict_links(e, "common_neighbors", 1000, include_zero=True).collect()
    assert {(r.item_a, r.item_b): r.score for r in everything} == {(a, b): float(len(adj[a] & adj[b])) for a, b in non}


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        L.predict_links(edges(spark, E6), "guess")


def modularity(rows, part, gamma=1.0):
    m = sum(w for _, _, w in rows)
    inside, tot = {}, {}
    for a, b, w in rows:
        if part[a] == part[b]:
            inside[part[a]] = inside.get(part[a], 0) + w
        for x in (a, b):
            tot[part[x]] = tot.get(part[x], 0) + w
    return sum(inside.get(c, 0) / m for c in tot) - gamma * sum((t / (2 * m)) ** 2 for t in tot.values())


def planted():
    groups = [["a1", "a2", "a3", "a4"], ["b1", "b2", "b3", "b4"], ["c1", "c2", "c3", "c4"]]
    rows = [(x, y, 8) for g in groups for x, y in combinations(g, 2)] + [("a1", "b1", 2), ("b2", "c2", 1)]
    return groups, rows


def test_modularity_matches_definition(spark):
    _, rows = planted()
    part = {n: n[0] for r in rows for n in r[:2]}
    p = spark.createDataFrame(list(part.items()), "node string, community string")
    for gamma in (1.0, 0.5):
        assert abs(G.modularity(edges(spark, rows), p, gamma).first()[0] - modularity(rows, part, gamma)) < 1e-12


def test_louvain_finds_planted_groups_and_incremental_keeps_them(spark):
    groups, rows = planted()
    e = edges(spark, rows)
    found = {r.node: r.community for r in C.louvain(e).collect()}
    assert found == {n: g[0] for g in groups for n in g}
    p = spark.createDataFrame(list(found.items()), "node string, community string")
    same = {r.node: r.community for r in C.louvain_incremental(e, p).collect()}
    assert same == found
    changed = spark.createDataFrame([("a2",), ("c4",)], "node string")
    again = {r.node: r.community for r in C.louvain_incremental(e, p.filter("node <> 'b3'"), changed).collect()}
    assert again == found


def test_contraction_whatever_the_size(spark):
    nodes = spark.createDataFrame([("item_a", "a", "item", "x", "warm"), ("item_b", "b", "item", "x", None)], "id string, label string, type string, category string, nature string")
    e = spark.createDataFrame([("item_a", "item_b", "co", 2.0)], "source string, target string, type string, weight double")
    merged, moved = G.contract_graph(nodes, e, "item")
    assert moved.count() == 0 and [(r.label, r["count"], r.trait) for r in merged.collect()] == [("x(2)", 2, "neutral")]
