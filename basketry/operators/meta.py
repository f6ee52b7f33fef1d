"""Random-effects meta-analysis per group key, its sensitivity checks, and network meta-analysis.

``studies(<keys>, study_id, year, effect_size, variance, n, quality)``. A group may be large: pooling is two map-side
combined passes, ranks are distributed, and leave-one-out works on blocks of pre-aggregated studies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.groups import BLOCK_ITEMS, pairs_in_groups
from ..functions.lineage import cut_lineage
from ..functions.ranks import ranked, upper_median
from ..functions.scalars import normal_cdf, two_sided_p


def _quality(exponent: float | None) -> Column:
    if exponent is None:
        return F.lit(1.0)
    return F.pow(F.greatest(F.lit(0.1), F.coalesce("quality", F.lit(0.5))), F.lit(float(exponent)))


def _cochran_q(sw, swy, swyy) -> Column:
    return F.greatest(F.lit(0.0), swyy - swy * swy / sw)


def _tau2(q, k, sw, sww) -> Column:
    """DerSimonian-Laird between-study variance; 0 for a single study."""
    c = sw - sww / sw
    return F.when((k > 1) & (c > 0), F.greatest(F.lit(0.0), (q - (k - 1)) / c)).otherwise(0.0)


def _i2(q, k) -> Column:
    return F.when(q > 0, F.greatest(F.lit(0.0), (q - (k - 1)) / q * 100.0)).otherwise(0.0)


def _fixed_sums(studies: DataFrame, keys: Sequence[str], exponent: float | None) -> DataFrame:
    w = _quality(exponent) / F.col("variance")
    y = F.col("effect_size")
    return studies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"), F.sum(w * w).alias("sww"),
        F.sum(F.coalesce("n", F.lit(0))).alias("total_patients"), F.avg(_quality(exponent)).alias("avg_quality_weight"))


def meta_analysis(studies: DataFrame, keys: Sequence[str], quality_exponent: float | None = None) -> DataFrame:
    """Pooled effect per group: effect, SE, 95% interval, z, p, I2, tau2, heterogeneity p (``1 - Phi(sqrt Q)``).

    With ``quality_exponent`` the weights are ``max(.1, quality)^e / variance``.
    """
    keys = list(keys)
    sums = _fixed_sums(studies, keys, quality_exponent)
    q = _cochran_q(F.col("sw"), F.col("swy"), F.col("swyy"))
    fixed = sums.withColumn("q", q).withColumn("tau2", _tau2(F.col("q"), F.col("k"), F.col("sw"), F.col("sww")))
    rw = _quality(quality_exponent) / (F.col("variance") + F.col("tau2"))
    second = studies.join(fixed.select(*keys, "tau2"), keys).groupBy(*keys).agg(
        F.sum(rw).alias("rsw"), F.sum(rw * F.col("effect_size")).alias("rswy"))
    out = fixed.join(second, keys).withColumn("pooled", F.col("rswy") / F.col("rsw")).withColumn("se", F.sqrt(1.0 / F.col("rsw")))
    out = out.withColumn("z", F.col("pooled") / F.col("se"))
    return out.select(
        *keys, F.col("pooled").alias("pooled_effect_size"), "se", (F.col("pooled") - 1.96 * F.col("se")).alias("ci_low"),
        (F.col("pooled") + 1.96 * F.col("se")).alias("ci_high"), "z", two_sided_p("z").alias("p_value"), _i2(F.col("q"), F.col("k")).alias("i_squared"),
        (1.0 - normal_cdf(F.sqrt("q"))).alias("heterogeneity_p"), F.col("tau2").alias("tau_squared"), F.col("k").alias("trials_included"),
        "total_patients", "avg_quality_weight")


def conclusion(pooled: DataFrame) -> DataFrame:
    """Add a text by rule: significance and direction, then the heterogeneity band (I2 above 50 or 75)."""
    es, p, i2 = F.col("pooled_effect_size"), F.col("p_value"), F.col("i_squared")
    first = F.when((p < 0.05) & (es > 0), F.format_string("significant effect (SMD=%.3f), first group better", es)).when(
        (p < 0.05) & (es < 0), F.format_string("significant effect (SMD=%.3f), second group better", es)).otherwise(
        F.format_string("no significant difference (SMD=%.3f)", es))
    band = F.when(i2 > 75, "; high heterogeneity").when(i2 > 50, "; moderate heterogeneity").otherwise("")
    return pooled.withColumn("conclusion", F.concat(first, F.format_string("; I2=%.1f%%", i2), band))


def forest_table(studies: DataFrame, keys: Sequence[str], quality_exponent: float | None = None) -> DataFrame:
    """Study rows with their weight in percent, effect and interval, plus one pooled row per group."""
    keys = list(keys)
    pooled = meta_analysis(studies, keys, quality_exponent)
    j = studies.join(pooled.select(*keys, "se", "tau_squared"), keys)
    w = _quality(quality_exponent) / (F.col("variance") + F.col("tau_squared")) * F.col("se") * F.col("se") * 100.0
    half = 1.96 * F.sqrt("variance")
    rows = j.select(*keys, "study_id", "year", w.alias("weight"), "effect_size", (F.col("effect_size") - half).alias("ci_low"),
                    (F.col("effect_size") + half).alias("ci_high"))
    total = pooled.select(*keys, F.lit("pooled").alias("study_id"), F.lit(None).cast("int").alias("year"), F.lit(100.0).alias("weight"),
                          F.col("pooled_effect_size").alias("effect_size"), "ci_low", "ci_high")
    return rows.unionByName(total)


def meta_loo(studies: DataFrame, keys: Sequence[str], block: int = BLOCK_ITEMS) -> DataFrame:
    """Pooled effect of every group without each of its studies (groups of three and more).

    tau2 without study i follows from the group's sums minus i. The random-effects sums need every other study at
    that tau2; they are folded over blocks of studies merged by variance, inside an expression, so the pairs of
    studies never become rows and a large group is spread over many tasks.
    """
    keys = list(keys)
    sums = cut_lineage(_fixed_sums(studies, keys, None).filter(F.col("k") >= 3).drop("avg_quality_weight", "total_patients"))
    merged = studies.groupBy(*keys, "variance").agg(F.count(F.lit(1)).alias("c"), F.sum("effect_size").alias("sy"))
    nblocks = merged.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    sums = sums.join(nblocks, keys)
    blocks = merged.join(nblocks, keys).groupBy(*keys, F.pmod(F.hash("variance"), F.col("_nb")).alias("_b")).agg(
        F.collect_list(F.struct("variance", "c", "sy")).alias("_items"))
    w, y = 1.0 / F.col("variance"), F.col("effect_size")
    left = studies.join(sums, keys).select(
        *keys, "study_id", "year", "effect_size", "variance", "_nb", (F.col("k") - 1).alias("k"), (F.col("sw") - w).alias("sw"),
        (F.col("swy") - w * y).alias("swy"), (F.col("swyy") - w * y * y).alias("swyy"), (F.col("sww") - w * w).alias("sww"))
    left = left.withColumn("q", _cochran_q(F.col("sw"), F.col("swy"), F.col("swyy"))).withColumn(
        "tau2", _tau2(F.col("q"), F.col("k"), F.col("sw"), F.col("sww")))
    left = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    met = left.join(blocks, [*keys, "_b"])
    part = met.select(
        *keys, "study_id", "year", "effect_size", "variance", "k", "q", "tau2",
        F.aggregate("_items", F.lit(0.0), lambda a, s: a + s["c"] / (s["variance"] + F.col("tau2"))).alias("_s0"),
        F.aggregate("_items", F.lit(0.0), lambda a, s: a + s["sy"] / (s["variance"] + F.col("tau2"))).alias("_s1"))
    tot = part.groupBy(*keys, "study_id", "year", "effect_size", "variance", "k", "q", "tau2").agg(F.sum("_s0").alias("_s0"), F.sum("_s1").alias("_s1"))
    own = 1.0 / (F.col("variance") + F.col("tau2"))
    tot = tot.withColumn("rsw", F.col("_s0") - own).withColumn("pooled_without", (F.col("_s1") - own * F.col("effect_size")) / F.col("rsw"))
    base = meta_analysis(studies, keys).select(*keys, F.col("pooled_effect_size").alias("base_effect"))
    out = tot.join(base, keys)
    half = 1.96 * F.sqrt(1.0 / F.col("rsw"))
    change = F.col("pooled_without") - F.col("base_effect")
    return out.select(
        *keys, "study_id", "year", "base_effect", "pooled_without", change.alias("change"), (F.col("pooled_without") - half).alias("ci_low"),
        (F.col("pooled_without") + half).alias("ci_high"), _i2(F.col("q"), F.col("k")).alias("i_squared_without"),
        (F.abs(change) > 0.1 * F.abs(F.col("base_effect"))).alias("influential"))


def loo_summary(studies: DataFrame, keys: Sequence[str], loo: DataFrame | None = None) -> DataFrame:
    """Per group: largest change, number of influential studies, robust or not; ``testable`` is false below three studies."""
    keys = list(keys)
    loo = meta_loo(studies, keys) if loo is None else loo
    per = loo.groupBy(*keys).agg(F.max(F.abs("change")).alias("max_change"), F.sum(F.col("influential").cast("long")).alias("n_influential"),
                                 F.max("base_effect").alias("_base"))
    groups = studies.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    robust = F.when(F.col("_base") != 0, F.col("max_change") < 0.1 * F.abs("_base")).otherwise(F.col("max_change") < 0.05)
    return groups.join(per, keys, "left").select(
        *keys, (F.col("k") >= 3).alias("testable"), F.coalesce("max_change", F.lit(0.0)).alias("max_change"),
        F.coalesce("n_influential", F.lit(0).cast("long")).alias("n_influential"), F.coalesce(robust, F.lit(False)).alias("robust"))


def meta_quality_sensitivity(studies: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Pooling again with good studies only; differences and whether the direction stays."""
    keys = list(keys)
    good = F.coalesce("quality", F.lit(0.5)) >= threshold
    counts = studies.groupBy(*keys).agg(F.sum(good.cast("long")).alias("kept"), F.sum((~good).cast("long")).alias("excluded"))
    base = meta_analysis(studies, keys).select(*keys, F.col("pooled_effect_size").alias("base_effect"), F.col("i_squared").alias("_i2"))
    high = meta_analysis(studies.filter(good), keys).select(*keys, F.col("pooled_effect_size").alias("high_quality_effect"), F.col("i_squared").alias("_h2"))
    j = counts.join(base, keys).join(high, keys, "left")
    same = F.signum("base_effect") == F.signum("high_quality_effect")
    return j.select(*keys, "kept", "excluded", "base_effect", "high_quality_effect", F.abs(F.col("high_quality_effect") - F.col("base_effect")).alias("es_difference"),
                    F.abs(F.col("_h2") - F.col("_i2")).alias("i2_difference"), F.coalesce(same, F.lit(False)).alias("direction_consistent"))


def publication_bias(studies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Asymmetry of imprecise positive studies and rank correlation of effect with its standard error (five and more)."""
    keys = list(keys)
    s = studies.select(*keys, "study_id", "effect_size", F.sqrt("variance").alias("_se"))
    both = ranked(ranked(s, keys, "effect_size", "study_id", "_re"), keys, "_se", "study_id", "_rs")
    med = upper_median(s, keys, "_se", "study_id", "_med")
    mean = s.groupBy(*keys).agg(F.avg("effect_size").alias("_mean"))
    j = both.join(med, keys).join(mean, keys)
    d = (F.col("_re") - F.col("_rs")).cast("double")
    agg = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum(d * d).alias("_d2"),
        F.sum(((F.col("_se") > F.col("_med")) & (F.col("effect_size") > F.col("_mean"))).cast("long")).alias("_low"))
    k = F.col("k").cast("double")
    testable = F.col("k") >= 5
    rho = F.when(testable, 1.0 - 6.0 * F.col("_d2") / (k * (k * k - 1.0)))
    ratio = F.when(testable, F.col("_low") / F.greatest(F.lit(1), F.floor(F.col("k") / 2)))
    out = agg.select(*keys, "k", testable.alias("testable"), rho.alias("rank_correlation"), ratio.alias("asymmetry_ratio"))
    rho, ratio = F.abs("rank_correlation"), F.col("asymmetry_ratio")
    level = F.when(~F.col("testable"), None).when((rho > 0.6) | (ratio > 1.5), "high").when((rho > 0.3) | (ratio > 1.1), "medium").otherwise("low")
    return out.withColumn("bias_level", level)


def quality_tier() -> Column:
    q = F.coalesce("quality", F.lit(0.5))
    return F.when(q >= 0.8, "high (>=0.8)").when(q >= 0.5, "medium (0.5-0.8)").otherwise("low (<0.5)")


def meta_subgroup(studies: DataFrame, keys: Sequence[str], subgroup: Column | None = None) -> DataFrame:
    """Pooling within subgroups (quality tier by default) that have two or more studies."""
    tagged = studies.withColumn("subgroup", quality_tier() if subgroup is None else F.coalesce(subgroup.cast("string"), F.lit("unknown")))
    return meta_analysis(tagged, [*keys, "subgroup"]).filter(F.col("trials_included") >= 2)


# --- trials -> studies --------------------------------------------------------------------------------------

def trial_arms(trials: DataFrame) -> DataFrame:
    """Long form of nested trials: one row per arm with its position."""
    return trials.select("trial_id", "indication", "year", "quality_score", F.posexplode("arms").alias("pos", "_a")).select(
        "trial_id", "indication", "year", "quality_score", "pos", "_a.*")


def head_to_head(arms: DataFrame, first_type: str) -> DataFrame:
    """First arm of the given type against the first arm of another type, per trial; trials lacking one are left out."""
    arm = F.struct("treatment_name", "sample_size", "mean_efficacy", "std_efficacy")
    is_first = F.col("treatment_type") == first_type
    per = arms.groupBy("trial_id", "indication", "year", "quality_score").agg(
        F.min_by(arm, F.when(is_first, F.col("pos"))).alias("c"), F.min_by(arm, F.when(~is_first, F.col("pos"))).alias("m"))
    return per.filter(F.col("c").isNotNull() & F.col("m").isNotNull())


def smd_studies(arms: DataFrame, first_type: str) -> DataFrame:
    """Standardised mean difference of the head-to-head arms, as studies."""
    h = head_to_head(arms, first_type)
    nc, nm = F.col("c.sample_size"), F.col("m.sample_size")
    sd = F.sqrt(((nc - 1) * F.pow("c.std_efficacy", F.lit(2.0)) + (nm - 1) * F.pow("m.std_efficacy", F.lit(2.0))) / F.greatest(nc + nm - 2, F.lit(1)))
    d = F.when(sd > 0, (F.col("c.mean_efficacy") - F.col("m.mean_efficacy")) / sd).otherwise(0.0)
    out = h.withColumn("effect_size", d)
    return out.select(
        "indication", F.col("trial_id").alias("study_id"), "year", "effect_size",
        (1.0 / nc + 1.0 / nm + F.col("effect_size") * F.col("effect_size") / (2.0 * (nc + nm))).alias("variance"),
        (nc + nm).cast("long").alias("n"), F.col("quality_score").alias("quality"), F.col("c.treatment_name").alias("first_arm"), F.col("m.treatment_name").alias("second_arm"))


def compare_treatments(arms: DataFrame, first_type: str, quality_exponent: float | None = None, sensitivity: bool = False) -> DataFrame:
    """Pooled head-to-head comparison per indication, with overall confidence when ``sensitivity`` is asked for.

    Indications without any head-to-head trial get the empty result (effect 0, p 1, no trials).
    """
    keys = ["indication"]
    studies = cut_lineage(smd_studies(arms, first_type))
    pooled = meta_analysis(studies, keys, quality_exponent)
    out = arms.select("indication").distinct().join(conclusion(pooled), keys, "left").na.fill(
        {"pooled_effect_size": 0.0, "ci_low": 0.0, "ci_high": 0.0, "p_value": 1.0, "i_squared": 0.0, "heterogeneity_p": 1.0, "trials_included": 0,
         "total_patients": 0, "conclusion": "no head-to-head trial"})
    if not sensitivity:
        return out
    loo = loo_summary(studies, keys).select("indication", "robust")
    low = meta_quality_sensitivity(studies, keys).select("indication", "direction_consistent")
    bias = publication_bias(studies, keys).select("indication", "bias_level")
    j = out.join(loo, keys, "left").join(low, keys, "left").join(bias, keys, "left")
    robust = F.coalesce("robust", F.lit(False))
    all_good = robust & F.coalesce("direction_consistent", F.lit(False)) & (F.coalesce("bias_level", F.lit("high")) == "low")
    return j.withColumn("overall_confidence", F.when(all_good, "high").when(robust, "medium").otherwise("low"))


# --- network meta-analysis ----------------------------------------------------------------------------------

def arm_pairs(arms: DataFrame) -> DataFrame:
    """Comparisons between different treatments of one trial, oriented so that ``t1 < t2``.

    Equal arms of a trial are merged with a multiplicity first.
    """
    merged = arms.groupBy("trial_id", "indication", "treatment_name", "mean_efficacy").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("sample_size").cast("long")).alias("n"))
    items = merged.select("trial_id", F.struct("treatment_name", "mean_efficacy", "indication", "c", "n").alias("arm"))
    p = pairs_in_groups(items, "trial_id", "arm").filter(F.col("item_a.treatment_name") != F.col("item_b.treatment_name"))
    pairs = F.col("item_a.c") * F.col("item_b.c")
    diff = F.col("item_a.mean_efficacy") - F.col("item_b.mean_efficacy")
    return p.select(
        "trial_id", F.col("item_a.indication").alias("indication"), F.col("item_a.treatment_name").alias("t1"), F.col("item_b.treatment_name").alias("t2"),
        pairs.alias("comparisons"), (diff * pairs).alias("diff"), (F.signum(diff) * pairs).alias("net"),
        (F.col("item_a.n") * F.col("item_b.c") + F.col("item_b.n") * F.col("item_a.c")).alias("patients"))


def evidence_network(arms: DataFrame) -> DataFrame:
    """Per treatment pair: comparisons, patients, mean effect difference (first minus second, by name)."""
    return arm_pairs(arms).groupBy("indication", "t1", "t2").agg(
        F.sum("comparisons").alias("trials"), F.sum("patients").alias("total_patients"), (F.sum("diff") / F.sum("comparisons")).alias("avg_effect_diff"))


def treatment_ranking(arms: DataFrame) -> DataFrame:
    """Net win score ``(wins - losses + n) / 2n`` per treatment (ties count for neither), share of the best, rank score.

    Treatments without a comparison score .5. ``rank_score`` = (n - rank) / (n - 1) * 100; ``cumulative_prob`` sums the
    shares down to the rank.
    """
    p = arm_pairs(arms)
    both = p.select("indication", F.explode(F.array(
        F.struct(F.col("t1").alias("treatment"), F.col("net").alias("net"), F.col("comparisons").alias("n")),
        F.struct(F.col("t2").alias("treatment"), (-F.col("net")).alias("net"), F.col("comparisons").alias("n")))).alias("_s")).select("indication", "_s.*")
    score = both.groupBy("indication", "treatment").agg(F.sum("net").alias("net"), F.sum("n").alias("studies"))
    everyone = arms.select("indication", F.col("treatment_name").alias("treatment")).distinct()
    s = everyone.join(score, ["indication", "treatment"], "left").select(
        "indication", "treatment", F.coalesce("studies", F.lit(0).cast("long")).alias("studies"),
        F.when(F.col("studies") > 0, (F.col("net") + F.col("studies")) / (2.0 * F.col("studies"))).otherwise(0.5).alias("net_score"))
    s = cut_lineage(s)
    top = s.groupBy("indication").agg(F.max("net_score").alias("_max"))
    s = s.join(top, "indication").withColumn("best_prob", F.round(F.when(F.col("_max") > 0, F.col("net_score") / F.col("_max") * 100.0).otherwise(0.0), 2))
    r = ranked(s.drop("_max").withColumn("_neg", -F.col("best_prob")), ["indication"], "_neg", "treatment", "_r").drop("_neg")
    n = F.col("_r_n")
    run = Window.partitionBy("indication").orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per treatment
    return r.select("indication", "treatment", "studies", "net_score", "best_prob", (F.col("_r") + 1).alias("rank"),
                    F.when(n > 1, (n - F.col("_r") - 1) / (n - 1) * 100.0).otherwise(100.0).alias("rank_score"), F.sum("best_prob").over(run).alias("cumulative_prob"))


def rank_score(ranking: DataFrame) -> DataFrame:
    return ranking.select("indication", "treatment", "rank", "rank_score", "cumulative_prob")


def league_table(arms: DataFrame) -> DataFrame:
    """Long league table: mean difference of every ordered pair that was compared."""
    e = evidence_network(arms)
    return e.select("indication", F.explode(F.array(
        F.struct(F.col("t1").alias("row"), F.col("t2").alias("column"), F.col("avg_effect_diff").alias("diff")),
        F.struct(F.col("t2").alias("row"), F.col("t1").alias("column"), (-F.col("avg_effect_diff")).alias("diff")))).alias("_s")).select("indication", "_s.*")


def league_matrix(arms: DataFrame, treatments: Sequence[str]) -> DataFrame:
    """Matrix form for the given treatments: "-" on the diagonal, "NA" where nothing was compared."""
    t = arms.select("indication", F.col("treatment_name").alias("row")).distinct()
    cells = league_table(arms).groupBy("indication", "row").pivot("column", list(treatments)).agg(F.first(F.round("diff", 3).cast("string")))
    return t.join(cells, ["indication", "row"], "left").select(
        "indication", "row", *[F.when(F.col("row") == c, "-").otherwise(F.coalesce(F.col(f"`{c}`"), F.lit("NA"))).alias(c) for c in treatments])
