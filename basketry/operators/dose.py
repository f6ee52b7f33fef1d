"""Grouped dose-response regression with restricted cubic splines.

``obs(<keys>, dose, response, weight)``. The normal equations are sums (one map-side combined aggregation per fit),
so a group of any size becomes one row; only that row's system, of as many unknowns as there are knots, is solved in a
vectorised Arrow function.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.lineage import cut_lineage
from ..functions.ranks import ranked, upper_median
from ..functions.scalars import as_col, once
from .rows import top_k_per_group


def _width(nk: int | Sequence[int]) -> int:
    """Length of the widest design row: intercept, dose and a spline term per knot but two."""
    return max(2, nk if isinstance(nk, int) else max(nk))


# --- design -------------------------------------------------------------------------------------------------

def _positions(nk, n) -> Column:
    """Ranks of the knots among n distinct doses: ``int(i / (nk - 1) * (n - 1))``, all ranks when n < nk."""
    nk, n = as_col(nk), as_col(n)
    spread = F.transform(F.sequence(F.lit(0), nk - 1), lambda i: F.floor(i / (nk - 1) * (n - 1)))
    return F.when(n < nk, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(spread)


def _distinct_ranks(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct doses per group with their rank ``r``, number of distinct doses ``r_n`` and repeat count ``c``."""
    d = obs.groupBy(*keys, "dose").agg(F.count(F.lit(1)).alias("c"))
    return ranked(d, keys, "dose", "dose", "r")


def place_knots(obs: DataFrame, keys: Sequence[str], nk: int | Sequence[int] = 4) -> DataFrame:
    """Knots per group (and per ``nk`` when several are given): ``<keys>[, nk], knots``."""
    keys = list(keys)
    many = not isinstance(nk, int)
    options = F.array(*[F.lit(k) for k in nk]) if many else F.array(F.lit(nk))
    r = _distinct_ranks(obs, keys).withColumn("nk", F.explode(options))
    hit = r.filter(F.array_contains(_positions("nk", "r_n"), F.col("r")))
    out = hit.groupBy(*keys, "nk").agg(F.array_sort(F.collect_set("dose")).alias("knots"))
    return out if many else out.drop("nk")


def rcs_basis(x, knots) -> Column:
    """Design row ``[1, x, spline terms]`` as an array."""
    x, knots = as_col(x), as_col(knots)
    n = F.size(knots)
    last, before = F.element_at(knots, -1), F.try_element_at(knots, F.lit(-2))

    def cube(t: Column) -> Column:
        return F.when(x > t, F.pow(x - t, F.lit(3.0))).otherwise(0.0)

    def part(t: Column) -> Column:
        return F.when(last != t, (cube(t) - cube(last)) / (last - t)).otherwise(0.0)

    terms = F.when(n > 2, F.transform(F.slice(knots, 1, F.greatest(n - 2, F.lit(0))), lambda t: part(t) - part(before))).otherwise(F.array().cast("array<double>"))
    return F.concat(F.array(F.lit(1.0), x.cast("double")), terms)


def predict(x, knots, coef) -> Column:
    return _dot(rcs_basis(x, knots), as_col(coef))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _at(i: int) -> Column:
    return F.coalesce(F.try_element_at(F.col("_b"), F.lit(i + 1)), F.lit(0.0))


def _sums(rows: DataFrame, by: Sequence[str], p: int) -> DataFrame:
    """Normal-equation sums of rows that carry the design row ``_b`` (up to ``p`` wide): weighted and unweighted."""
    w, y = F.col("weight").cast("double"), F.col("response")
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.min("dose").alias("x_min"), F.max("dose").alias("x_max"),
        F.max(F.size("_b")).alias("p"),
        *[F.sum(w * _at(i) * _at(j)).alias(f"_w{i}{j}") for i, j in cells], *[F.sum(w * _at(i) * y).alias(f"_wy{i}") for i in range(p)],
        *[F.sum(_at(i) * _at(j)).alias(f"_u{i}{j}") for i, j in cells], *[F.sum(_at(i) * y).alias(f"_uy{i}") for i in range(p)])

    def square(kind: str) -> Column:
        return F.array(*[F.col(f"_{kind}{min(i, j)}{max(i, j)}") for i in range(p) for j in range(p)])

    return agg.select(*by, "n", "sy", "syy", "x_min", "x_max", "p", square("w").alias("xtwx"), F.array(*[F.col(f"_wy{i}") for i in range(p)]).alias("xtwy"),
                      square("u").alias("xtx"), F.array(*[F.col(f"_uy{i}") for i in range(p)]).alias("xty"))


@F.pandas_udf(T.StructType([T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("rank", T.IntegerType())]))
def _solve(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.DataFrame:
    """Minimum-norm solution of small symmetric systems (p x p corner of each array), a batch at a time."""
    coef, rank = [None] * len(a), [0] * len(a)
    if len(a):
        sizes = p.to_numpy()
        rhs = np.stack(b.to_numpy())
        mats = np.stack(a.to_numpy()).reshape(-1, rhs.shape[1], rhs.shape[1])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            m, r = mats[at][:, :size, :size], rhs[at][:, :size]
            # columns scaled to unit diagonal: cubes of the dose would otherwise swamp the intercept
            d = np.sqrt(np.maximum(np.einsum("nii->ni", m), 1e-300))
            scaled = m / d[:, :, None] / d[:, None, :]
            inv = np.linalg.pinv(scaled, rcond=1e-12, hermitian=True)
            sol = np.einsum("nij,nj->ni", inv, r / d) / d
            ranks = np.linalg.matrix_rank(scaled, tol=1e-12 * size, hermitian=True)
            for k, i in enumerate(at):
                coef[i], rank[i] = sol[k].tolist(), int(ranks[k])
    return pd.DataFrame({"coef": coef, "rank": rank})


def fit_rcs(obs: DataFrame, keys: Sequence[str], nk: int | Sequence[int] = 4, prior_precision: float = 0.0, prior_mean: float = 0.0,
            knots: DataFrame | None = None) -> DataFrame:
    """Weighted least squares on the spline basis, one row per group (and per ``nk`` when several are given).

    ``knots, coef, n_params, rank, r_squared`` (unweighted) and, with a prior, ``coef_std``. The prior adds its precision
    to the diagonal and pulls towards ``prior_mean`` (the mean response for the intercept).
    """
    keys = list(keys)
    k = place_knots(obs, keys, nk) if knots is None else knots
    by = [*keys, "nk"] if "nk" in k.columns else keys
    k = cut_lineage(k)
    width = _width(nk) if knots is None else max(2, k.agg(F.max(F.size("knots"))).first()[0] or 0)
    designed = obs.join(k, keys).withColumn("_b", rcs_basis("dose", "knots"))
    s = _sums(designed, by, width)
    mean = F.col("sy") / F.col("n")
    if prior_precision:
        a = F.transform("xtwx", lambda v, i: F.when(i % (width + 1) == 0, v + prior_precision).otherwise(v))
        b = F.transform("xtwy", lambda v, i: v + prior_precision * F.when(i == 0, mean).otherwise(F.lit(float(prior_mean))))
        s = s.withColumn("xtwx", a).withColumn("xtwy", b)
    fitted = cut_lineage(s.withColumn("_f", _solve("xtwx", "xtwy", "p")).join(k, by))
    coef = F.col("_f.coef")
    res = designed.join(fitted.select(*by, coef.alias("coef")), by).withColumn("_e", F.col("response") - _dot(F.col("_b"), F.col("coef")))
    res = res.groupBy(*by).agg(F.sum(F.col("_e") * F.col("_e")).alias("ss_res"))
    ss_tot = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    out = fitted.join(res, by)
    std = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.sqrt(
        F.col("ss_res") / F.greatest(F.col("n") - F.col("p"), F.lit(1)) / F.greatest(F.get("xtwx", i * (width + 1)), F.lit(1e-10))))
    return out.select(
        *by, "knots", coef.alias("coef"), F.col("p").alias("n_params"), F.col("_f.rank").alias("rank"), "n", "x_min", "x_max",
        F.when(ss_tot > 1e-12 * F.col("syy"), 1.0 - F.col("ss_res") / ss_tot).otherwise(0.0).alias("r_squared"), std.alias("coef_std"))


# --- curves -------------------------------------------------------------------------------------------------

def dose_curve(fit: DataFrame, keys: Sequence[str], share: float = 0.9) -> DataFrame:
    """Peak dose and the range predicted to reach ``share`` of the peak, on a grid of 201 doses per fit.

    The range ends at the first grid dose below the threshold on each side, or at the peak where there is none.
    The grid lives in one array per fit row: no shuffle.
    """
    step = (F.col("x_max") - F.col("x_min")) / 200
    grid = F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: predict(F.col("x_min") + step * i, F.col("knots"), F.col("coef")))
    out = once(fit, "_y", grid)
    out = out.withColumn("_best", (F.array_position("_y", F.array_max("_y")) - 1).cast("int")).withColumn("_thr", F.array_max("_y") * share)
    low = F.array_max(F.filter(F.sequence(F.lit(0), F.col("_best")), lambda i: F.get("_y", i) < F.col("_thr")))
    high = F.array_min(F.filter(F.sequence(F.col("_best"), F.lit(200)), lambda i: F.get("_y", i) < F.col("_thr")))
    at = lambda i: F.col("x_min") + step * i
    return out.select(
        *keys, "knots", "r_squared", at(F.col("_best")).alias("peak_dose"), F.array_max("_y").alias("peak_response"),
        at(F.coalesce(low, F.col("_best"))).alias("optimal_low"), at(F.coalesce(high, F.col("_best"))).alias("optimal_high"))


def curve_points(fit: DataFrame, keys: Sequence[str], every: int = 10) -> DataFrame:
    """Curve rows per group (21 by default) with the pointwise 95% interval of the coefficient deviations."""
    grid = fit.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(200), F.lit(every))))
    grid = grid.withColumn("dose", F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("_i") / 200)
    grid = once(grid, "_b", rcs_basis("dose", "knots"))
    se = F.sqrt(F.aggregate(F.zip_with("_b", "coef_std", lambda b, s: b * b * s * s), F.lit(0.0), lambda a, v: a + v))
    mean = _dot(F.col("_b"), F.col("coef"))
    return grid.select(*keys, F.col("_i").alias("point"), "dose", mean.alias("response"), (mean - 1.96 * se).alias("ci_low"), (mean + 1.96 * se).alias("ci_high"))


def cap_safe_dose(curve: DataFrame, max_doses: DataFrame, key: str) -> DataFrame:
    """Upper end of the range cut at the safe dose (``<key>, max_dose``), with a flag where it was cut."""
    j = curve.join(max_doses.select(key, "max_dose"), key, "left")
    over = (F.col("max_dose") > 0) & (F.col("optimal_high") > F.col("max_dose"))
    return j.withColumn("truncated", F.coalesce(over, F.lit(False))).withColumn(
        "optimal_high", F.when(F.col("truncated"), F.col("max_dose")).otherwise(F.col("optimal_high")))


# --- sensitivity --------------------------------------------------------------------------------------------

def rcs_loo(obs: DataFrame, keys: Sequence[str], obs_id: str, nk: int = 4) -> DataFrame:
    """Prediction for every observation from a fit without it: ``predicted, residual, r_squared_without, influential``.

    Leaving a point out moves the knots only when its dose is unique, and then to one of at most nk + 1 positions. So
    the sums are computed once per group and knot position, and every point is subtracted from its own: the work is
    rows x (nk + 2), not rows x rows.
    """
    keys, width = list(keys), _width(nk)
    r = cut_lineage(_distinct_ranks(obs, keys))
    lit_nk = F.lit(nk)
    # values a knot can take after one dose is dropped: at its position or the next
    pos = F.concat(_positions(lit_nk, "r_n"), _positions(lit_nk, F.col("r_n") - 1))
    near = F.exists(F.concat(pos, F.transform(pos, lambda q: q + 1)), lambda q: q == F.col("r"))
    values = r.filter(near).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("r").cast("long"), "dose"))).alias("_v"))
    full = F.transform(_positions(lit_nk, "r_n"), lambda q: F.try_element_at(F.col("_v"), q))
    less = F.transform(_positions(lit_nk, F.col("r_n") - 1), lambda q: F.try_element_at(F.col("_v"), F.when(q < F.col("r"), q).otherwise(q + 1)))
    placed = r.join(values, keys).select(*keys, "dose", F.array_distinct(F.when((F.col("c") > 1) | (F.col("r_n") < 2), full).otherwise(less)).alias("knots"))
    variants = cut_lineage(placed.select(*keys, "knots").distinct())
    sums = cut_lineage(_sums(obs.join(variants, keys).withColumn("_b", rcs_basis("dose", "knots")), [*keys, "knots"], width))
    own = obs.join(placed, [*keys, "dose"]).join(sums.filter(F.col("n") >= 3), [*keys, "knots"]).withColumn("_b", F.concat(
        rcs_basis("dose", "knots"), F.array_repeat(F.lit(0.0), F.greatest(width - F.col("p"), F.lit(0)))))
    w, y = F.col("weight").cast("double"), F.col("response")

    def minus(total: str, factor: Column, square: bool) -> Column:
        if square:
            return F.transform(total, lambda v, i: v - factor * F.get("_b", F.floor(i / width).cast("int")) * F.get("_b", i % width))
        return F.transform(total, lambda v, i: v - factor * y * F.get("_b", i))

    left = own.select(*keys, obs_id, "dose", "response", "p", (F.col("n") - 1).alias("n"), (F.col("sy") - y).alias("sy"), (F.col("syy") - y * y).alias("syy"), "_b",
                      minus("xtwx", w, True).alias("a"), minus("xtwy", w, False).alias("b"), minus("xtx", F.lit(1.0), True).alias("u"), minus("xty", F.lit(1.0), False).alias("uy"))
    sol = left.withColumn("_c", _solve("a", "b", "p")["coef"])
    pred = _dot(F.slice("_b", 1, F.col("p")), F.col("_c"))
    quad = F.aggregate(F.sequence(F.lit(0), F.col("p") - 1), F.lit(0.0), lambda s, i: s + F.get("_c", i) * (
        F.aggregate(F.sequence(F.lit(0), F.col("p") - 1), F.lit(0.0), lambda z, j: z + F.get("_c", j) * F.get("u", i * width + j)) - 2.0 * F.get("uy", i)))
    ss_tot = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    out = sol.withColumn("predicted", pred).withColumn("_ss", F.col("syy") + quad)
    return out.select(
        *keys, obs_id, "dose", "response", "predicted", (F.col("predicted") - F.col("response")).alias("residual"),
        F.when(ss_tot > 1e-12 * F.col("syy"), 1.0 - F.col("_ss") / ss_tot).otherwise(0.0).alias("r_squared_without"),
        (F.abs(F.col("predicted") - F.col("response")) > 0.15).alias("influential"))


def loo_stability(obs: DataFrame, keys: Sequence[str], obs_id: str, nk: int = 4, loo: DataFrame | None = None) -> DataFrame:
    """PRESS, leave-one-out R2 and stability per group; groups under three points are not robust."""
    keys = list(keys)
    loo = rcs_loo(obs, keys, obs_id, nk) if loo is None else loo
    base = fit_rcs(obs, keys, nk)
    pred = obs.join(base.select(*keys, "knots", "coef"), keys).withColumn("_p", predict("dose", "knots", "coef")).groupBy(*keys).agg(
        F.var_pop("_p").alias("_v"), F.count(F.lit(1)).alias("_n"))
    press = loo.groupBy(*keys).agg(F.sum(F.col("residual") * F.col("residual")).alias("press"), F.sum(F.col("influential").cast("long")).alias("n_influential"))
    j = base.select(*keys, "n", F.col("r_squared").alias("base_r_squared")).join(pred, keys).join(press, keys, "left")
    total = F.col("_v") * F.col("_n")
    r2 = F.when(total > 0, 1.0 - F.col("press") / total).otherwise(0.0)
    stability = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(r2 - F.col("base_r_squared"))))
    testable = F.col("n") >= 3
    return j.select(*keys, testable.alias("testable"), F.col("press"), F.when(testable, r2).alias("loo_r_squared"), "base_r_squared",
                    F.when(testable, stability).otherwise(0.0).alias("stability"), (testable & (stability > 0.7)).alias("robust"), "n_influential")


def rcs_knot_sensitivity(obs: DataFrame, keys: Sequence[str], options: Sequence[int] = (3, 4, 5, 6)) -> tuple[DataFrame, DataFrame]:
    """R2 per number of knots, and per group the best one, the variance over them and whether it is below .02."""
    keys = list(keys)
    fits = fit_rcs(obs, keys, list(options))
    best = fits.groupBy(*keys).agg(
        F.min_by("nk", F.struct(-F.round("r_squared", 4), F.col("nk"))).alias("best_n_knots"), F.max("r_squared").alias("best_r_squared"),
        F.var_pop("r_squared").alias("r2_variance"))
    return fits, best.withColumn("knot_stable", F.col("r2_variance") < 0.02)


def dose_sensitivity(obs: DataFrame, keys: Sequence[str], obs_id: str, nk: int = 4) -> DataFrame:
    """Overall verdict: leave-one-out robust and stable over knots; prior sensitivity (.01 against 1); few points."""
    keys = list(keys)
    loo = loo_stability(obs, keys, obs_id, nk).select(*keys, "stability", "robust")
    _, knots = rcs_knot_sensitivity(obs, keys)
    weak = fit_rcs(obs, keys, nk, prior_precision=0.01).select(*keys, "n", F.col("r_squared").alias("weak_prior_r2"))
    strong = fit_rcs(obs, keys, nk, prior_precision=1.0).select(*keys, F.col("r_squared").alias("strong_prior_r2"))
    j = loo.join(knots, keys).join(weak, keys).join(strong, keys)
    diff = F.abs(F.col("weak_prior_r2") - F.col("strong_prior_r2"))
    return j.select(*keys, "stability", "robust", "best_n_knots", "knot_stable", "weak_prior_r2", "strong_prior_r2", (diff < 0.1).alias("prior_stable"),
                    (F.col("robust") & F.col("knot_stable")).alias("overall_stable"), (F.col("n") < 5).alias("small_sample"))


# --- observations and comparisons ---------------------------------------------------------------------------

def dose_observations(rows: DataFrame, keys: Sequence[str], dose: str, response: str) -> DataFrame:
    """Observations per dose: mean response, number of rows as weight, standard error."""
    return rows.groupBy(*keys, F.col(dose).cast("double").alias("dose")).agg(
        F.avg(response).alias("response"), F.count(F.lit(1)).alias("weight"),
        F.coalesce(F.stddev_samp(response) / F.sqrt(F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("std_error"))


def dose_statistics(doses: DataFrame, keys: Sequence[str], dose: str, tie: str) -> DataFrame:
    """Minimum, maximum, mean, upper median and count per group."""
    s = doses.filter(F.col(dose).isNotNull()).groupBy(*keys).agg(
        F.min(dose).alias("min"), F.max(dose).alias("max"), F.avg(dose).alias("mean"), F.count(F.lit(1)).alias("count"))
    return s.join(upper_median(doses, keys, dose, tie), list(keys))


def dose_position(doses: DataFrame, ranges: DataFrame, key: str, dose: str) -> DataFrame:
    """Every dose as within, above or below its group's range (``<key>, optimal_low, optimal_high``)."""
    where = F.when(F.col(dose) > F.col("optimal_high"), "above").when(F.col(dose) < F.col("optimal_low"), "below").otherwise("within")
    return doses.filter(F.col(dose).isNotNull()).join(ranges.select(key, "optimal_low", "optimal_high"), key).withColumn("position", where)


def dose_comparison(positioned: DataFrame, key: str, example: str, examples: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts per group and position, and the first examples of each."""
    counts = positioned.groupBy(key, "position").agg(F.count(F.lit(1)).alias("count"))
    return counts, top_k_per_group(positioned, [key, "position"], [F.asc(example)], examples)
