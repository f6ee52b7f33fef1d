import random

import pytest

from basketry.operators import meta as M

S5 = [(0.5, 0.02, 100, 0.7), (0.6, 0.015, 120, 0.8), (0.45, 0.025, 80, 0.6), (0.55, 0.018, 90, 0.75), (0.48, 0.022, 110, 0.65)]


def pool(rows):
    w = [1 / v for _, v in rows]
    sw, k = sum(w), len(rows)
    m = sum(a * y for a, (y, _) in zip(w, rows)) / sw
    q = sum(a * (y - m) ** 2 for a, (y, _) in zip(w, rows))
    c = sw - sum(a * a for a in w) / sw
    tau2 = max(0.0, (q - (k - 1)) / c) if k > 1 else 0.0
    rw = [1 / (v + tau2) for _, v in rows]
    return sum(a * y for a, (y, _) in zip(rw, rows)) / sum(rw), tau2


@pytest.fixture(scope="module")
def studies(spark):
    rng = random.Random(3)
    rows = [("s5", f"S{i}", 2000 + i, y, v, n, q) for i, (y, v, n, q) in enumerate(S5)]
    rows += [("het", f"H{i}", 2000, y, 0.01, 50, 0.4 + 0.2 * i) for i, y in enumerate((0.1, 0.9, 0.3, 0.8))]
    rows += [("one", "O1", 2001, 0.3, 0.02, 30, 0.5)]
    rows += [("big", f"B{i:03d}", 1990, rng.gauss(0.3, 0.2), rng.uniform(0.005, 0.05), 40, rng.random()) for i in range(60)]
    return spark.createDataFrame(rows, "g string, study_id string, year int, effect_size double, variance double, n long, quality double")


def by_group(studies):
    out = {}
    for r in studies.collect():
        out.setdefault(r.g, []).append(r)
    return out


def test_pooling(studies):
    got = {r.g: r for r in M.meta_analysis(studies, ["g"]).collect()}
    for g, rows in by_group(studies).items():
        es, tau2 = pool([(r.effect_size, r.variance) for r in rows])
        assert abs(got[g].pooled_effect_size - es) < 1e-9 and abs(got[g].tau_squared - tau2) < 1e-9
    assert got["het"].i_squared > 50 and got["s5"].i_squared < 50 and got["s5"].total_patients == 500 and got["one"].tau_squared == 0
    assert M.forest_table(studies, ["g"]).filter("g = 's5'").count() == 6


def test_leave_one_out_in_blocks_equals_refitting(studies):
    groups = by_group(studies)
    for block in (2048, 7):
        got = {(r.g, r.study_id): r for r in M.meta_loo(studies, ["g"], block).collect()}
        assert len(got) == 5 + 4 + 60
        for (g, sid), r in got.items():
            es, _ = pool([(x.effect_size, x.variance) for x in groups[g] if x.study_id != sid])
            assert abs(r.pooled_without - es) < 1e-9
    s = {r.g: r for r in M.loo_summary(studies, ["g"]).collect()}
    assert not s["one"].testable and s["s5"].robust


def test_bias_needs_five(studies):
    b = {r.g: r for r in M.publication_bias(studies, ["g"]).collect()}
    assert b["s5"].testable and not b["het"].testable and b["het"].bias_level is None


def arms(spark, trials):
    from basketry.sources.tables import TRIAL_SCHEMA

    rows = [(t, ind, 2020, 0.7, [(n, k, 100, e, sd, 0.0) for n, k, e, sd in a]) for t, ind, a in trials]
    return M.trial_arms(spark.createDataFrame(rows, TRIAL_SCHEMA))


def test_comparison_and_empty_result(spark):
    trials = [(f"t{i}", "het", [("A", "classic", 0.5 + 0.1 * i, 0.15), ("B", "modern", 0.4, 0.15)]) for i in range(1, 7)]
    trials += [(f"h{i}", "hom", [("A", "classic", 0.72, 0.1), ("B", "modern", 0.68, 0.1)]) for i in range(6)]
    trials += [(f"n{i}", "none", [("A", "classic", 0.7, 0.1), ("C", "classic", 0.6, 0.1)]) for i in range(3)]
    out = {r.indication: r for r in M.compare_treatments(arms(spark, trials), "classic", sensitivity=True).collect()}
    assert out["het"].i_squared > 50 and out["hom"].i_squared < 50
    assert out["none"].trials_included == 0 and out["none"].p_value == 1.0 and out["none"].overall_confidence == "low"


def test_arms_are_oriented_by_name(spark):
    a = arms(spark, [("t", "x", [("B", "m", 0.9, 0.1), ("A", "c", 0.1, 0.1)])])
    e = M.evidence_network(a).first()
    assert (e.t1, e.t2) == ("A", "B") and abs(e.avg_effect_diff + 0.8) < 1e-12
    r = {x.treatment: x for x in M.treatment_ranking(a).collect()}
    assert r["B"]["rank"] == 1 and r["B"].net_score == 1.0 and r["A"].net_score == 0.0 and r["B"].rank_score == 100.0
    m = {x["row"]: x for x in M.league_matrix(a, ["A", "B", "C"]).collect()}
    assert (m["A"]["A"], m["A"]["B"], m["A"]["C"]) == ("-", "-0.8", "NA")
