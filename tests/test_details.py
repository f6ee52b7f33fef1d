from pyspark.sql import functions as F

from basketry.operators import links as L, risk as R, text as X


def test_pair_details_are_those_of_the_strongest_entry(spark):
    pairs = spark.createDataFrame([("a", "b", "low", "t1", "weak", "D", ["r1"]), ("b", "a", "extreme", "t2", "strong", "A", ["r2", "r3"])],
                                  "herb_a string, herb_b string, risk_level string, interaction_type string, mechanism string, evidence_level string, references array<string>")
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "basket_id int, item string")
    got = R.with_pair_details(R.known_risk_pairs(items, pairs), pairs).collect()
    assert [(r.item_a, r.item_b, r.mechanism, r.evidence_level, r.references) for r in got] == [("a", "b", "strong", "A", ["r2", "r3"])]
    other = spark.createDataFrame([("x", "y")], "item_a string, item_b string")
    r = R.with_pair_details(other, pairs.drop("references")).first()
    assert (r.mechanism, r.evidence_level, r.references) == (None, None, None)


def test_item_reactions_keep_all_columns(spark):
    reactions = spark.createDataFrame([("a", "liver", "mild", ["s1", "s2"], 0.1, 4.0)], "item string, type string, severity string, symptoms array<string>, frequency double, onset_hours double")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "basket_id int, item string")
    assert [tuple(r) for r in R.item_reactions(items, reactions).collect()] == [(1, "a", "liver", "mild", ["s1", "s2"], 0.1, 4.0)]


def test_reaction_totals(spark):
    found = spark.createDataFrame([("k", "x", "mild"), ("k", "x", "severe"), ("k", "y", "mild"), ("m", "x", "mild")], "key string, reaction_type string, severity string")
    got = {r.key: (r.total_reactions, r.severity_distribution, r.by_reaction_type) for r in X.reaction_totals(found, ["key"]).collect()}
    assert got == {"k": (3, {"mild": 2, "severe": 1}, {"x": 2, "y": 1}), "m": (1, {"mild": 1}, {"x": 1})}
    assert [tuple(r) for r in X.reaction_totals(found.limit(0)).collect()] == [(0, {}, {})]


def test_katz_counts_walks(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "e")]
    edges = spark.createDataFrame([(*r, 1.0) for r in rows], "src string, dst string, weight double")
    nodes = "abcde"
    adj = {u: {v for x, y in rows for v, w in ((x, y), (y, x)) if w == u} for u in nodes}
    two = {(u, v): len(adj[u] & adj[v]) for u in nodes for v in nodes}
    three = {(u, v): sum(two[u, w] for w in adj[v]) for u in nodes for v in nodes}
    four = {(u, v): sum(three[u, w] for w in adj[v]) for u in nodes for v in nodes}
    got = {(r.item_a, r.item_b): r.score for r in L.katz(edges, 0.1, 4).collect()}
    want = {(u, v): s for u in nodes for v in nodes if u < v and v not in adj[u] and (s := 0.01 * two[u, v] + 0.001 * three[u, v] + 0.0001 * four[u, v])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
