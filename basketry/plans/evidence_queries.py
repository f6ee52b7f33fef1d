"""Trials, meta-analysis and network meta-analysis: a trial is a nation in an order year, an arm an order priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage
from ..operators import meta as M, profiles as P
from .catalog import Tables, query, with_ctes
from .row_queries import sql_normal_cdf

CLASSIC = "('1-URGENT', '2-HIGH')"
ARMS = [
    ("qual", "SELECT n_nationkey AS nk, r_name AS indication, round(coalesce(avg(s_acctbal) / 8000.0, 0.5), 6) AS quality_score FROM nation "
             "JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2"),
    ("arms0", "SELECT c_nationkey AS nk, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS treatment_name, count(*) AS sample_size, "
              "avg(l_discount) AS mean_efficacy, coalesce(stddev_samp(l_discount), 0) AS std_efficacy FROM lineitem JOIN orders ON o_orderkey = l_orderkey "
              "JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3"),
    ("arms", "SELECT CAST(arms0.nk AS VARCHAR) || '-' || CAST(year AS VARCHAR) AS trial_id, indication, year, quality_score, treatment_name, "
             f"CASE WHEN treatment_name IN {CLASSIC} THEN 'classic' ELSE 'modern' END AS treatment_type, sample_size, round(mean_efficacy, 9) AS mean_efficacy, std_efficacy "
             "FROM arms0 JOIN qual ON qual.nk = arms0.nk"),
]
STUDIES = [
    *ARMS,
    ("fa", "SELECT * FROM arms WHERE treatment_type = 'classic' QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY treatment_name) = 1"),
    ("fb", "SELECT * FROM arms WHERE treatment_type = 'modern' QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY treatment_name) = 1"),
    ("h2h", "SELECT a.indication, a.trial_id, a.year, a.quality_score AS quality, a.treatment_name AS first_arm, b.treatment_name AS second_arm, a.sample_size AS nc, b.sample_size AS nm, "
            "a.mean_efficacy - b.mean_efficacy AS diff, sqrt(((a.sample_size - 1) * a.std_efficacy * a.std_efficacy + (b.sample_size - 1) * b.std_efficacy * b.std_efficacy) / greatest(a.sample_size + b.sample_size - 2, 1)) AS sd "
            "FROM fa a JOIN fb b ON a.trial_id = b.trial_id"),
    ("smd", "SELECT *, CASE WHEN sd > 0 THEN diff / sd ELSE 0 END AS d FROM h2h"),
    ("studies", "SELECT indication, trial_id AS study_id, year, d AS effect_size, 1.0 / nc + 1.0 / nm + d * d / (2.0 * (nc + nm)) AS variance, nc + nm AS n, quality, first_arm, second_arm FROM smd"),
]


def pool_sql(source: str, keys: str, out: str, weight: str = "1.0") -> list[tuple[str, str]]:
    """CTE ``out`` with the pooled result of ``source`` per keys."""
    on = " AND ".join(f"s.{k.strip()} = x.{k.strip()}" for k in keys.split(","))
    on2 = " AND ".join(f"r.{k.strip()} = x.{k.strip()}" for k in keys.split(","))
    xs = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    w = f"({weight} / variance)"
    return [
        (f"{out}_s", f"SELECT {keys}, count(*) AS k, sum({w}) AS sw, sum({w} * effect_size) AS swy, sum({w} * effect_size * effect_size) AS swyy, sum({w} * {w}) AS sww, CAST(sum(n) AS BIGINT) AS tn FROM {source} GROUP BY {keys}"),
        (f"{out}_q", f"SELECT *, greatest(0.0, swyy - swy * swy / sw) AS q FROM {out}_s"),
        (f"{out}_t", f"SELECT *, CASE WHEN k > 1 AND sw - sww / sw > 0 THEN greatest(0.0, (q - (k - 1)) / (sw - sww / sw)) ELSE 0.0 END AS tau2, "
                     f"CASE WHEN q > 0 THEN greatest(0.0, (q - (k - 1)) / q * 100) ELSE 0.0 END AS i2 FROM {out}_q"),
        (f"{out}_r", f"SELECT {xs}, sum({weight} / (variance + tau2)) AS rsw, sum({weight} / (variance + tau2) * effect_size) AS rswy FROM {source} s JOIN {out}_t x ON {on} GROUP BY {xs}"),
        (f"{out}_z", f"SELECT x.*, rswy / rsw AS es, sqrt(1 / rsw) AS se, (rswy / rsw) / sqrt(1 / rsw) AS z FROM {out}_t x JOIN {out}_r r ON {on2}"),
        (out, f"SELECT *, 2 * (1 - {sql_normal_cdf('abs(z)')}) AS p, 1 - {sql_normal_cdf('sqrt(q)')} AS hp FROM {out}_z"),
    ]


POOL = [*STUDIES, *pool_sql("studies", "indication", "pooled")]
QW = "greatest(0.1, coalesce(quality, 0.5))"
SUMMARY = ("SELECT indication, round(es, 6) AS pooled_effect_size, round(es - 1.96 * se, 6) AS ci_low, round(es + 1.96 * se, 6) AS ci_high, round(p, 6) AS p_value, "
           "round(i2, 4) AS i_squared, round(hp, 6) AS heterogeneity_p, round(tau2, 8) AS tau_squared, k AS trials_included, tn AS total_patients FROM pooled")


def _arms(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    arms = rows.groupBy(F.col("c_nationkey").alias("nk"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("treatment_name")).agg(
        F.count(F.lit(1)).alias("sample_size"), F.round(F.avg("l_discount"), 9).alias("mean_efficacy"), F.coalesce(F.stddev_samp("l_discount"), F.lit(0.0)).alias("std_efficacy"))
    quality = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(
        F.col("n_nationkey").alias("nk"), F.col("r_name").alias("indication")).agg(F.round(F.coalesce(F.avg("s_acctbal") / 8000.0, F.lit(0.5)), 6).alias("quality_score"))
    return arms.join(quality, "nk").select(
        F.concat(F.col("nk").cast("string"), F.lit("-"), F.col("year").cast("string")).alias("trial_id"), "indication", "year", "quality_score",
        F.substring("treatment_name", 1, 1).cast("int").alias("pos"), "treatment_name",
        F.when(F.col("treatment_name").isin("1-URGENT", "2-HIGH"), "classic").otherwise("modern").alias("treatment_type"), "sample_size", "mean_efficacy", "std_efficacy")


def _studies(t: Tables) -> DataFrame:
    return cut_lineage(M.smd_studies(_arms(t), "classic"))


def _summary(df: DataFrame) -> DataFrame:
    return df.select("indication", *[F.round(c, n).alias(c) for c, n in (
        ("pooled_effect_size", 6), ("ci_low", 6), ("ci_high", 6), ("p_value", 6), ("i_squared", 4), ("heterogeneity_p", 6), ("tau_squared", 8))],
        "trials_included", "total_patients")


@query("head_to_head", with_ctes(*STUDIES, body="SELECT trial_id, indication, first_arm, second_arm FROM h2h"))
def head_to_head(t: Tables) -> DataFrame:
    return M.head_to_head(_arms(t), "classic").select("trial_id", "indication", F.col("c.treatment_name").alias("first_arm"), F.col("m.treatment_name").alias("second_arm"))


@query("smd_studies", with_ctes(*STUDIES, body="SELECT study_id, indication, year, round(effect_size, 6) AS effect_size, round(variance, 8) AS variance, n, quality FROM studies"))
def smd_studies(t: Tables) -> DataFrame:
    return M.smd_studies(_arms(t), "classic").select("study_id", "indication", "year", F.round("effect_size", 6).alias("effect_size"), F.round("variance", 8).alias("variance"), "n", "quality")


@query("meta_analysis", with_ctes(*POOL, body=SUMMARY))
def meta_analysis(t: Tables) -> DataFrame:
    return _summary(M.meta_analysis(_studies(t), ["indication"]))


@query("meta_analysis_quality", with_ctes(*STUDIES, *pool_sql("studies", "indication", "pooled", QW), body=SUMMARY))
def meta_analysis_quality(t: Tables) -> DataFrame:
    return _summary(M.meta_analysis(_studies(t), ["indication"], quality_exponent=1.0))


@query("dose_study_pooling", with_ctes(*STUDIES, ("by_year", "SELECT *, year AS grp FROM studies"), *pool_sql("by_year", "grp", "pooled"), body=(
    "SELECT grp AS year, round(es, 6) AS pooled_effect_size, round(tau2, 8) AS tau_squared, round(i2, 4) AS i_squared, k AS studies_included FROM pooled")))
def dose_study_pooling(t: Tables) -> DataFrame:
    out = M.meta_analysis(_studies(t), ["year"])
    return out.select("year", F.round("pooled_effect_size", 6).alias("pooled_effect_size"), F.round("tau_squared", 8).alias("tau_squared"),
                      F.round("i_squared", 4).alias("i_squared"), F.col("trials_included").alias("studies_included"))


@query("forest_table", with_ctes(*POOL, body=(
    "SELECT s.indication, study_id, round(100 / (variance + tau2) * se * se, 5) AS weight, round(effect_size, 6) AS effect_size, round(effect_size - 1.96 * sqrt(variance), 6) AS ci_low, "
    "round(effect_size + 1.96 * sqrt(variance), 6) AS ci_high FROM studies s JOIN pooled x ON s.indication = x.indication UNION ALL "
    "SELECT indication, 'pooled', 100.0, round(es, 6), round(es - 1.96 * se, 6), round(es + 1.96 * se, 6) FROM pooled")))
def forest_table(t: Tables) -> DataFrame:
    return M.forest_table(_studies(t), ["indication"]).select(
        "indication", "study_id", F.round("weight", 5).alias("weight"), *[F.round(c, 6).alias(c) for c in ("effect_size", "ci_low", "ci_high")])


LOO = [*POOL,
       ("omit", "SELECT a.study_id AS omitted, b.* FROM studies a JOIN studies b ON a.indication = b.indication AND a.study_id <> b.study_id"),
       *pool_sql("omit", "indication, omitted", "loo"),
       ("chg", "SELECT loo.indication, omitted, loo.es AS without, loo.es - pooled.es AS change, loo.i2 AS i2w, pooled.es AS base, abs(loo.es - pooled.es) > 0.1 * abs(pooled.es) AS infl FROM loo JOIN pooled ON loo.indication = pooled.indication")]


@query("meta_loo", with_ctes(*LOO, body="SELECT indication, omitted AS study_id, round(without, 6) AS pooled_without, round(change, 6) AS change, round(i2w, 4) AS i_squared_without, infl AS influential FROM chg"))
def meta_loo(t: Tables) -> DataFrame:
    return M.meta_loo(_studies(t), ["indication"]).select("indication", "study_id", F.round("pooled_without", 6).alias("pooled_without"), F.round("change", 6).alias("change"),
                                                          F.round("i_squared_without", 4).alias("i_squared_without"), "influential")


@query("meta_loo_summary", with_ctes(*LOO, body=(
    "SELECT indication, true AS testable, round(max(abs(change)), 6) AS max_change, CAST(sum(CAST(infl AS INTEGER)) AS BIGINT) AS n_influential, max(abs(change)) < 0.1 * abs(any_value(base)) AS robust FROM chg GROUP BY indication")))
def meta_loo_summary(t: Tables) -> DataFrame:
    return M.loo_summary(_studies(t), ["indication"]).withColumn("max_change", F.round("max_change", 6))


@query("meta_quality_sensitivity", with_ctes(*POOL, ("good", "SELECT * FROM studies WHERE quality >= 0.5"), *pool_sql("good", "indication", "hq"), body=(
    "SELECT p.indication, (SELECT count(*) FROM good g WHERE g.indication = p.indication) AS kept, p.k - (SELECT count(*) FROM good g WHERE g.indication = p.indication) AS excluded, round(p.es, 6) AS base_effect, "
    "round(hq.es, 6) AS high_quality_effect, round(abs(hq.es - p.es), 6) AS es_difference, round(abs(hq.i2 - p.i2), 4) AS i2_difference, coalesce(sign(hq.es) = sign(p.es), false) AS direction_consistent FROM pooled p LEFT JOIN hq ON hq.indication = p.indication")))
def meta_quality_sensitivity(t: Tables) -> DataFrame:
    out = M.meta_quality_sensitivity(_studies(t), ["indication"])
    return out.select("indication", "kept", "excluded", *[F.round(c, 6).alias(c) for c in ("base_effect", "high_quality_effect", "es_difference")],
                      F.round("i2_difference", 4).alias("i2_difference"), "direction_consistent")


BIAS = [*STUDIES,
        ("rk", "SELECT *, sqrt(variance) AS sev, row_number() OVER (PARTITION BY indication ORDER BY effect_size, study_id) - row_number() OVER (PARTITION BY indication ORDER BY sqrt(variance), study_id) AS d, "
               "row_number() OVER (PARTITION BY indication ORDER BY sqrt(variance), study_id) - 1 AS rs, count(*) OVER (PARTITION BY indication) AS k, avg(effect_size) OVER (PARTITION BY indication) AS me FROM studies"),
        ("med", "SELECT indication, sev AS med FROM rk WHERE rs = k // 2"),
        ("bias", "SELECT rk.indication, any_value(k) AS k, 1 - 6.0 * sum(d * d) / (any_value(k) * (any_value(k) * any_value(k) - 1.0)) AS rho, sum(CASE WHEN sev > med AND effect_size > me THEN 1 ELSE 0 END) / greatest(1, any_value(k) // 2) AS ratio FROM rk JOIN med ON med.indication = rk.indication GROUP BY rk.indication")]
BIAS_LEVEL = "CASE WHEN abs(rho) > 0.6 OR ratio > 1.5 THEN 'high' WHEN abs(rho) > 0.3 OR ratio > 1.1 THEN 'medium' ELSE 'low' END"


@query("publication_bias", with_ctes(*BIAS, body=f"SELECT indication, k, true AS testable, round(rho, 6) AS rank_correlation, round(ratio, 6) AS asymmetry_ratio, {BIAS_LEVEL} AS bias_level FROM bias"))
def publication_bias(t: Tables) -> DataFrame:
    out = M.publication_bias(_studies(t), ["indication"])
    return out.withColumn("rank_correlation", F.round("rank_correlation", 6)).withColumn("asymmetry_ratio", F.round("asymmetry_ratio", 6))


@query("meta_subgroup", with_ctes(*STUDIES, ("tiers", "SELECT *, CASE WHEN quality >= 0.8 THEN 'high (>=0.8)' WHEN quality >= 0.5 THEN 'medium (0.5-0.8)' ELSE 'low (<0.5)' END AS subgroup FROM studies"),
                                  *pool_sql("tiers", "indication, subgroup", "pooled"), body=(
    "SELECT indication, subgroup, round(es, 6) AS pooled_effect_size, round(i2, 4) AS i_squared, k AS trials_included FROM pooled WHERE k >= 2")))
def meta_subgroup(t: Tables) -> DataFrame:
    out = M.meta_subgroup(_studies(t), ["indication"])
    return out.select("indication", "subgroup", F.round("pooled_effect_size", 6).alias("pooled_effect_size"), F.round("i_squared", 4).alias("i_squared"), "trials_included")


@query("meta_conclusion", with_ctes(*POOL, body=(
    "SELECT indication, CASE WHEN p < 0.05 AND es > 0 THEN printf('significant effect (SMD=%.3f), first group better', es) WHEN p < 0.05 AND es < 0 THEN printf('significant effect (SMD=%.3f), second group better', es) "
    "ELSE printf('no significant difference (SMD=%.3f)', es) END || printf('; I2=%.1f%%', i2) || CASE WHEN i2 > 75 THEN '; high heterogeneity' WHEN i2 > 50 THEN '; moderate heterogeneity' ELSE '' END AS conclusion FROM pooled")))
def meta_conclusion(t: Tables) -> DataFrame:
    return M.conclusion(M.meta_analysis(_studies(t), ["indication"])).select("indication", "conclusion")


LOO_BIAS = [*LOO, *BIAS[len(STUDIES):], ("good", "SELECT * FROM studies WHERE quality >= 0.5"), *pool_sql("good", "indication", "hq"),
            ("rob", "SELECT indication, max(abs(change)) < 0.1 * abs(any_value(base)) AS robust FROM chg GROUP BY indication"),
            ("fin", f"SELECT p.indication, p.es, p.k, robust, coalesce(sign(hq.es) = sign(p.es), false) AS dir, {BIAS_LEVEL} AS lvl FROM pooled p JOIN rob ON rob.indication = p.indication JOIN bias ON bias.indication = p.indication LEFT JOIN hq ON hq.indication = p.indication")]


@query("compare_treatments", with_ctes(*LOO_BIAS, body=(
    "SELECT indication, round(es, 6) AS pooled_effect_size, k AS trials_included, CASE WHEN robust AND dir AND lvl = 'low' THEN 'high' WHEN robust THEN 'medium' ELSE 'low' END AS overall_confidence FROM fin")))
def compare_treatments(t: Tables) -> DataFrame:
    out = M.compare_treatments(_arms(t), "classic", sensitivity=True)
    return out.select("indication", F.round("pooled_effect_size", 6).alias("pooled_effect_size"), "trials_included", "overall_confidence")


NMA = [*ARMS,
       ("pr", "SELECT a.indication, a.treatment_name AS t1, b.treatment_name AS t2, a.mean_efficacy - b.mean_efficacy AS diff, a.sample_size + b.sample_size AS n FROM arms a JOIN arms b ON a.trial_id = b.trial_id AND a.treatment_name < b.treatment_name"),
       ("net", "SELECT indication, t1, t2, count(*) AS trials, CAST(sum(n) AS BIGINT) AS total_patients, avg(diff) AS d FROM pr GROUP BY 1, 2, 3"),
       ("sides", "SELECT indication, t1 AS treatment, sign(diff) AS net FROM pr UNION ALL SELECT indication, t2, -sign(diff) FROM pr"),
       ("sc", "SELECT indication, treatment, count(*) AS studies, (sum(net) + count(*)) / (2.0 * count(*)) AS net_score FROM sides GROUP BY 1, 2"),
       ("mx", "SELECT indication, max(net_score) AS m FROM sc GROUP BY indication"),
       ("pb", "SELECT sc.*, round(CASE WHEN m > 0 THEN net_score / m * 100 ELSE 0 END, 2) AS best_prob FROM sc JOIN mx ON mx.indication = sc.indication"),
       ("rk", "SELECT *, row_number() OVER (PARTITION BY indication ORDER BY best_prob DESC, treatment) AS rank, count(*) OVER (PARTITION BY indication) AS nt FROM pb")]


@query("evidence_network", with_ctes(*NMA, body="SELECT indication, t1, t2, trials, total_patients, round(d, 6) AS avg_effect_diff FROM net"))
def evidence_network(t: Tables) -> DataFrame:
    return M.evidence_network(_arms(t)).withColumn("avg_effect_diff", F.round("avg_effect_diff", 6))


@query("arm_pairs", with_ctes(*ARMS, body=(
    "SELECT a.trial_id, a.treatment_name AS t1, b.treatment_name AS t2, round(a.mean_efficacy - b.mean_efficacy, 6) AS diff FROM arms a JOIN arms b ON a.trial_id = b.trial_id AND a.treatment_name < b.treatment_name")))
def arm_pairs(t: Tables) -> DataFrame:
    return M.arm_pairs(_arms(t)).select("trial_id", "t1", "t2", F.round("diff", 6).alias("diff"))


@query("treatment_ranking", with_ctes(*NMA, body="SELECT indication, treatment, studies, round(net_score, 6) AS net_score, best_prob, rank FROM rk"))
def treatment_ranking(t: Tables) -> DataFrame:
    return M.treatment_ranking(_arms(t)).select("indication", "treatment", "studies", F.round("net_score", 6).alias("net_score"), "best_prob", "rank")


@query("rank_score", with_ctes(*NMA, body=(
    "SELECT indication, treatment, rank, round((nt - rank) / (nt - 1) * 100, 4) AS rank_score, round(sum(best_prob) OVER (PARTITION BY indication ORDER BY rank ROWS UNBOUNDED PRECEDING), 2) AS cumulative_prob FROM rk")))
def rank_score(t: Tables) -> DataFrame:
    return M.rank_score(M.treatment_ranking(_arms(t))).withColumn("rank_score", F.round("rank_score", 4)).withColumn("cumulative_prob", F.round("cumulative_prob", 2))


@query("league_table", with_ctes(*NMA, body="SELECT indication, t1 AS row, t2 AS column, round(d, 6) AS diff FROM net UNION ALL SELECT indication, t2, t1, round(-d, 6) FROM net".replace("AS row", 'AS "row"').replace("AS column", 'AS "column"')))
def league_table(t: Tables) -> DataFrame:
    return M.league_table(_arms(t)).withColumn("diff", F.round("diff", 6))


@query("league_matrix", with_ctes(*NMA, ("both_ways", "SELECT indication, t1 AS a, t2 AS b, d FROM net UNION ALL SELECT indication, t2, t1, -d FROM net"), body=(
    "SELECT x.indication, x.treatment, count(b) AS compared, max(CASE WHEN b = '5-LOW' THEN round(d, 3) + 0.0 END) AS against_low FROM sc x "
    "LEFT JOIN both_ways w ON w.indication = x.indication AND w.a = x.treatment GROUP BY 1, 2")))
def league_matrix(t: Tables) -> DataFrame:
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    m = M.league_matrix(_arms(t), names)
    cells = F.array(*[F.col(f"`{n}`") for n in names])
    compared = F.size(F.filter(cells, lambda c: ~c.isin("-", "NA")))
    return m.select("indication", F.col("row").alias("treatment"), compared.cast("long").alias("compared"), (F.col("`5-LOW`").try_cast("double") + 0.0).alias("against_low"))


@query("trials_summary", with_ctes(*ARMS, body="SELECT indication, count(DISTINCT trial_id) AS trials, min(year) AS first_year, max(year) AS last_year, CAST(sum(sample_size) AS BIGINT) AS total_patients FROM arms GROUP BY indication"))
def trials_summary(t: Tables) -> DataFrame:
    arms = _arms(t)
    return P.trials_summary(arms.select("trial_id", "indication", "year").distinct(), arms)


@query("evidence_lookup", with_ctes(*ARMS, ("asked", "SELECT DISTINCT o_orderpriority AS name FROM orders UNION SELECT DISTINCT p_type FROM part"), body=(
    "SELECT asked.name, count(DISTINCT indication) AS n_labels, min(indication) AS first_label, coalesce(list(DISTINCT indication ORDER BY indication) FILTER (indication IS NOT NULL), []) AS labels, count(DISTINCT indication) > 0 AS has_evidence FROM asked LEFT JOIN arms ON arms.treatment_name = asked.name GROUP BY asked.name")))
def evidence_lookup(t: Tables) -> DataFrame:
    asked = t.orders.select(F.col("o_orderpriority").alias("name")).union(t.part.select("p_type"))
    return P.evidence_lookup(asked, _arms(t).select(F.col("treatment_name").alias("name"), F.col("indication").alias("label")))
