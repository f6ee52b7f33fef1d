
import numpy as np

from basketry.operators import dose as D


def knots_of(xs, nk):
    s = sorted(set(xs))
    return s if len(s) < nk else sorted({s[int(i / (nk - 1) * (len(s) - 1))] for i in range(nk)})


def design(xs, knots):
    cube = lambda x, t: max(0.0, x - t) ** 3
    rows = []
    for x in xs:
        row = [1.0, x]
        for t in knots[: max(len(knots) - 2, 0)]:
            last, prev = knots[-1], knots[-2]
            row.append((cube(x, t) - cube(x, last)) / (last - t) - (cube(x, prev) - cube(x, last)) / (last - prev))
        rows.append(row)
    return np.array(rows)


def fit(xs, ys, ws, nk=4):
    knots = knots_of(xs, nk)
    a = design(xs, knots)
    w = np.sqrt(np.array(ws))[:, None]
    coef = np.linalg.lstsq(a * w, np.array(ys) * w[:, 0], rcond=None)[0]
    return knots, coef, a @ coef


GROUPS = {
    "linear": [(float(x), 2.0 * x + 1, 1.0) for x in range(1, 9)],
    "real": [(float(x), float(y), float(w)) for x, y, w in zip([3, 6, 9, 12, 15, 18, 24, 30], [45, 62, 78, 88, 92, 89, 75, 60], [5, 8, 9, 4, 7, 6, 3, 8])],
    "repeated": [(float(x), 0.1 * x - 0.004 * x * x + 0.05 * ((7 * x + k) % 5), 1.0 + k) for x in range(1, 13) for k in range(2)],
}
SMALL = {"small": [(3.0, 0.4, 5.0), (6.0, 0.65, 8.0), (9.0, 0.5, 4.0)]}


def table(spark, groups):
    rows = [(g, f"{g}{i}", x, y, w) for g, pts in groups.items() for i, (x, y, w) in enumerate(pts)]
    return spark.createDataFrame(rows, "g string, id string, dose double, response double, weight double")


def test_fit_equals_least_squares(spark):
    got = {r.g: r for r in D.fit_rcs(table(spark, GROUPS), ["g"]).collect()}
    for g, pts in GROUPS.items():
        xs, ys, ws = map(list, zip(*pts))
        knots, coef, pred = fit(xs, ys, ws)
        assert got[g].knots == knots and got[g].n_params == len(coef)
        mine = design(xs, knots) @ np.array(got[g].coef)
        assert np.allclose(mine, pred, atol=1e-5 * max(1.0, np.abs(pred).max()))
        y = np.array(ys)
        assert abs(got[g].r_squared - (1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-5
    assert got["linear"].r_squared > 0.999


def test_leave_one_out_equals_refitting(spark):
    got = {r.id: r for r in D.rcs_loo(table(spark, GROUPS), ["g"], "id").collect()}
    for g, pts in GROUPS.items():
        for i, (x, y, _) in enumerate(pts):
            rest = pts[:i] + pts[i + 1:]
            xs, ys, ws = map(list, zip(*rest))
            knots, coef, pred = fit(xs, ys, ws)
            scale = max(1.0, abs(y))
            r = got[f"{g}{i}"]
            assert abs(r.predicted - float(design([x], knots)[0] @ coef)) < 2e-3 * scale, (g, i)
            yy = np.array(ys)
            assert abs(r.r_squared_without - (1 - ((yy - pred) ** 2).sum() / ((yy - yy.mean()) ** 2).sum())) < 1e-3


def test_small_groups_with_prior(spark):
    df = table(spark, SMALL)
    r = D.fit_rcs(df, ["g"], 4, prior_precision=0.5).first()
    assert 0 < r.r_squared <= 1 and len(r.coef_std) == r.n_params == 3
    assert D.fit_rcs(df, ["g"], 4).first().r_squared > 0.999
    pts = D.curve_points(D.fit_rcs(df, ["g"], 4, prior_precision=0.5), ["g"]).collect()
    assert len(pts) == 21 and all(p.ci_low <= p.response <= p.ci_high for p in pts)


def test_curve_matches_a_grid_search(spark):
    fits = D.fit_rcs(table(spark, GROUPS), ["g"])
    got = {r.g: r for r in D.dose_curve(fits, ["g"]).collect()}
    for f in fits.collect():
        xs = [f.x_min + (f.x_max - f.x_min) * i / 200 for i in range(201)]
        ys = list(design(xs, f.knots) @ np.array(f.coef))
        best = int(np.argmax(ys))
        low = next((xs[i] for i in range(best, -1, -1) if ys[i] < 0.9 * ys[best]), xs[best])
        high = next((xs[i] for i in range(best, 201) if ys[i] < 0.9 * ys[best]), xs[best])
        r = got[f.g]
        assert abs(r.peak_dose - xs[best]) < 1e-9 and abs(r.optimal_low - low) < 1e-9 and abs(r.optimal_high - high) < 1e-9


def test_sensitivity_flags(spark):
    s = {r.g: r for r in D.dose_sensitivity(table(spark, {**GROUPS, **SMALL}), ["g"], "id").collect()}
    assert s["small"].small_sample and not s["linear"].small_sample and s["linear"].robust and s["linear"].knot_stable


def test_seven_knots_are_fitted_whole(spark):
    xs = [float(x) for x in range(1, 25)]
    ys = [float(np.sin(x / 3) + 0.05 * (x % 4)) for x in xs]
    df = spark.createDataFrame([("g", x, y, 1.0) for x, y in zip(xs, ys)], "g string, dose double, response double, weight double")
    r = D.fit_rcs(df, ["g"], 7).collect()[0]
    _, _, want = fit(xs, ys, [1.0] * len(xs), 7)
    assert r.n_params == 7 and len(r.coef) == 7
    ss = 1 - ((np.array(ys) - want) ** 2).sum() / ((np.array(ys) - np.mean(ys)) ** 2).sum()
    assert abs(r.r_squared - ss) < 1e-6
