"""Dose-response over line items: dose is the quantity, the group a brand, the response the unit price in thousands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage
from ..operators import dose as D, profiles as P
from . import bindings as Bd
from .catalog import Tables, query, with_ctes

ROWS = ("dr", "SELECT p_brand AS item, l_quantity AS dose, l_extendedprice / l_quantity / 1000 AS resp FROM lineitem JOIN part ON p_partkey = l_partkey")
OBS = ("obs", "SELECT item, dose, avg(resp) AS response, count(*) AS weight, coalesce(stddev_samp(resp) / sqrt(count(*)), 0) AS std_error FROM dr GROUP BY item, dose")
DISTINCT = ("dist", "SELECT item, dose, row_number() OVER (PARTITION BY item ORDER BY dose) - 1 AS r, count(*) OVER (PARTITION BY item) AS n FROM (SELECT DISTINCT item, dose FROM obs)")


def _rows(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("item"), F.col("l_quantity").alias("dose"), (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("resp"),
        "l_orderkey", "l_linenumber")


def _obs(t: Tables) -> DataFrame:
    return cut_lineage(D.dose_observations(_rows(t), ["item"], "dose", "resp"))


@query("dose_observations", with_ctes(ROWS, OBS, body="SELECT item, dose, round(response, 9) AS response, weight, round(std_error, 9) AS std_error FROM obs"))
def dose_observations(t: Tables) -> DataFrame:
    return D.dose_observations(_rows(t), ["item"], "dose", "resp").withColumn("response", F.round("response", 9)).withColumn("std_error", F.round("std_error", 9))


def _knot_sql(nk: int) -> str:
    pos = ", ".join(f"CAST(floor({i} / {nk - 1} * (n - 1)) AS BIGINT)" for i in range(nk))
    return f"SELECT item, {nk} AS nk, string_agg(CAST(CAST(dose AS INTEGER) AS VARCHAR), ',' ORDER BY dose) AS knots FROM dist WHERE n < {nk} OR r IN ({pos}) GROUP BY item"


@query("dose_knots", with_ctes(ROWS, OBS, DISTINCT, body=" UNION ALL ".join(_knot_sql(k) for k in (3, 4, 5, 6))))
def dose_knots(t: Tables) -> DataFrame:
    k = D.place_knots(_obs(t), ["item"], [3, 4, 5, 6])
    return k.select("item", "nk", F.array_join(F.transform("knots", lambda x: x.cast("int").cast("string")), ",").alias("knots"))


def _h(x: str, t: str) -> str:
    return f"CASE WHEN {x} > {t} THEN ({x} - {t}) * ({x} - {t}) * ({x} - {t}) ELSE 0 END"


@query("spline_basis", with_ctes(ROWS, OBS, body=(
    f"SELECT item, dose, round(({_h('dose', '5.0')} - {_h('dose', '45.0')}) / 40 - ({_h('dose', '30.0')} - {_h('dose', '45.0')}) / 15, 4) AS b1, "
    f"round(({_h('dose', '18.0')} - {_h('dose', '45.0')}) / 27 - ({_h('dose', '30.0')} - {_h('dose', '45.0')}) / 15, 4) AS b2 FROM obs")))
def spline_basis(t: Tables) -> DataFrame:
    knots = F.array(*[F.lit(x) for x in (5.0, 18.0, 30.0, 45.0)])
    b = D.dose_observations(_rows(t), ["item"], "dose", "resp").withColumn("b", D.rcs_basis("dose", knots))
    return b.select("item", "dose", F.round(F.col("b")[2], 4).alias("b1"), F.round(F.col("b")[3], 4).alias("b2"))


def _det3(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_K3 = ("k3", "SELECT item, max(CASE WHEN r = 0 THEN dose END) AS k0, max(CASE WHEN r = CAST(floor(0.5 * (n - 1)) AS BIGINT) THEN dose END) AS k1, max(CASE WHEN r = n - 1 THEN dose END) AS k2 FROM dist GROUP BY item")
_B3 = ("b3", f"SELECT obs.item, dose - 25 AS x, weight AS w, response AS y, (({_h('dose', 'k0')} - ({_h('dose', 'k2')})) / (k2 - k0) - ({_h('dose', 'k1')} - ({_h('dose', 'k2')})) / (k2 - k1)) / 1000 AS z FROM obs JOIN k3 ON k3.item = obs.item")
_S3 = ("s3", "SELECT item, sum(w) AS s1, sum(w * x) AS sx, sum(w * z) AS sz, sum(w * x * x) AS sxx, sum(w * x * z) AS sxz, sum(w * z * z) AS szz, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * z * y) AS szy, avg(y) AS my FROM b3 GROUP BY item")
_M = [["s1", "sx", "sz"], ["sx", "sxx", "sxz"], ["sz", "sxz", "szz"]]
_R = ["sy", "sxy", "szy"]
_C3 = ("c3", "SELECT item, my, " + ", ".join(
    f"{_det3([[(_R[i] if j == c else _M[i][j]) for j in range(3)] for i in range(3)])} / {_det3(_M)} AS c{c}" for c in range(3)) + " FROM s3")


@query("dose_fit_three_knots", with_ctes(ROWS, OBS, DISTINCT, _K3, _B3, _S3, _C3, body=(
    "SELECT b3.item, round(1 - sum((y - c0 - c1 * x - c2 * z) * (y - c0 - c1 * x - c2 * z)) / sum((y - my) * (y - my)), 5) AS r_squared FROM b3 JOIN c3 ON c3.item = b3.item GROUP BY b3.item")))
def dose_fit_three_knots(t: Tables) -> DataFrame:
    """The fit against the same normal equations solved by determinants in SQL (dose centred there, same model)."""
    return D.fit_rcs(_obs(t), ["item"], 3).select("item", F.round("r_squared", 5).alias("r_squared"))


@query("dose_fit")
def dose_fit(t: Tables) -> DataFrame:
    return D.fit_rcs(_obs(t), ["item"], 4).select("item", "knots", "coef", "n_params", "rank", "r_squared")


@query("dose_fit_bayesian")
def dose_fit_bayesian(t: Tables) -> DataFrame:
    fit = D.fit_rcs(_obs(t), ["item"], 4, prior_precision=0.1)
    return D.curve_points(fit, ["item"])


@query("dose_curve")
def dose_curve(t: Tables) -> DataFrame:
    return D.dose_curve(D.fit_rcs(_obs(t), ["item"], 4), ["item"]).drop("knots")


def _max_doses(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("item")).agg((20.0 + F.count(F.lit(1)) % 20).alias("max_dose"))


@query("dose_safe_cap")
def dose_safe_cap(t: Tables) -> DataFrame:
    curve = D.dose_curve(D.fit_rcs(_obs(t), ["item"], 4), ["item"])
    return D.cap_safe_dose(curve, _max_doses(t), "item").drop("knots")


@query("dose_leave_one_out")
def dose_leave_one_out(t: Tables) -> DataFrame:
    obs = _obs(t).withColumn("obs_id", F.concat_ws("/", "item", "dose"))
    return D.rcs_loo(obs, ["item"], "obs_id")


@query("dose_knot_sensitivity")
def dose_knot_sensitivity(t: Tables) -> DataFrame:
    return D.rcs_knot_sensitivity(_obs(t), ["item"])[1]


@query("dose_sensitivity")
def dose_sensitivity(t: Tables) -> DataFrame:
    return D.dose_sensitivity(_obs(t).withColumn("obs_id", F.concat_ws("/", "item", "dose")), ["item"], "obs_id")


@query("dose_statistics", with_ctes(ROWS, (
    "rk", "SELECT item, dose, row_number() OVER (PARTITION BY item ORDER BY dose) - 1 AS r, count(*) OVER (PARTITION BY item) AS n FROM dr"), body=(
    "SELECT item, min(dose) AS min, max(dose) AS max, round(avg(dose), 6) AS mean, count(*) AS count, max(CASE WHEN r = n // 2 THEN dose END) AS median FROM rk GROUP BY item")))
def dose_statistics(t: Tables) -> DataFrame:
    return D.dose_statistics(_rows(t), ["item"], "dose", "l_orderkey").withColumn("mean", F.round("mean", 6))


RANGES = ("ranges", "SELECT p_brand AS item, 10.0 + count(*) % 5 AS lo, 30.0 + count(*) % 7 AS hi FROM part GROUP BY p_brand")
POSITIONS = ("pos", "SELECT dr.item, l_orderkey, CASE WHEN dose > hi THEN 'above' WHEN dose < lo THEN 'below' ELSE 'within' END AS position FROM "
                    "(SELECT p_brand AS item, l_quantity AS dose, l_orderkey * 10 + l_linenumber AS l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey) dr JOIN ranges ON ranges.item = dr.item")


def _positions(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    ranges = t.part.groupBy(F.col("p_brand").alias("item")).agg((10.0 + n % 5).alias("optimal_low"), (30.0 + n % 7).alias("optimal_high"))
    doses = _rows(t).withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return D.dose_position(doses, ranges, "item", "dose")


@query("dose_positions", with_ctes(RANGES, POSITIONS, body="SELECT item, position, count(*) AS count FROM pos GROUP BY 1, 2"))
def dose_positions(t: Tables) -> DataFrame:
    return D.dose_comparison(_positions(t), "item", "line")[0]


@query("dose_position_examples", with_ctes(RANGES, POSITIONS, body=(
    "SELECT item, position, l_orderkey AS line FROM pos QUALIFY row_number() OVER (PARTITION BY item, position ORDER BY l_orderkey) <= 10")))
def dose_position_examples(t: Tables) -> DataFrame:
    return D.dose_comparison(_positions(t), "item", "line")[1].select("item", "position", "line")


@query("item_profile")
def item_profile(t: Tables) -> DataFrame:
    brands = t.part.groupBy(F.col("p_brand").alias("item")).agg(F.min("p_type").alias("category"), F.avg("p_size").alias("mean_size"))
    toxic = _max_doses(t).filter("max_dose < 30")
    curve = D.dose_curve(D.fit_rcs(_obs(t), ["item"], 4), ["item"]).drop("knots")
    return P.item_profile(brands, toxic, curve)
