"""Link prediction on an undirected graph ``edges(src < dst)``: scores of pairs that are not linked yet."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.groups import pairs_in_groups
from ..functions.lineage import cut_lineage
from ..functions.ranks import global_rank
from ..functions.scalars import one_row, safe_div
from .graph import symmetric

NEIGHBOUR_METHODS = ("common_neighbors", "jaccard", "adamic_adar", "resource_allocation")


def _unweighted(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1.0).alias("weight")).distinct()


def _degree_table(sym: DataFrame) -> DataFrame:
    return sym.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def neighbour_scores(edges: DataFrame, linked: bool = False) -> DataFrame:
    """Common neighbours, Jaccard, Adamic-Adar and resource allocation of every pair with a common neighbour.

    One two-hop pass computes all four: the pairs of each node's neighbour list, combined map-side. A hub's list is
    handled block by block (see ``pairs_in_groups``). Pairs already linked are removed unless ``linked``.
    """
    base = _unweighted(edges)
    sym = symmetric(base)
    two_hop = pairs_in_groups(sym, "u", "v")
    deg = F.col("group_size")
    scored = two_hop.groupBy("item_a", "item_b").agg(
        F.count(F.lit(1)).alias("common_neighbors"),
        F.coalesce(F.sum(F.when(deg > 1, 1.0 / F.log(deg.cast("double")))), F.lit(0.0)).alias("adamic_adar"),
        F.sum(1.0 / deg).alias("resource_allocation"),
    )
    if not linked:
        scored = scored.join(base.select(F.col("src").alias("item_a"), F.col("dst").alias("item_b")), ["item_a", "item_b"], "left_anti")
    d = _degree_table(sym)
    scored = scored.join(d.withColumnsRenamed({"node": "item_a", "degree": "degree_a"}), "item_a").join(
        d.withColumnsRenamed({"node": "item_b", "degree": "degree_b"}), "item_b")
    jaccard = safe_div("common_neighbors", F.col("degree_a") + F.col("degree_b") - F.col("common_neighbors"))
    return scored.select("item_a", "item_b", "common_neighbors", jaccard.alias("jaccard"), "adamic_adar", "resource_allocation",
                         "degree_a", "degree_b")


def preferential_attachment(edges: DataFrame, top_n: int) -> DataFrame:
    """Top non-linked pairs by degree product, exactly and without a cross join.

    With nodes ordered by degree, the node at position i can be in the answer only with one of the next
    ``degree_i + top_n`` nodes (of any more, top_n are unlinked and at least as good), and only while fewer than
    ``edges + top_n`` pairs lie above it. So 2*edges + nodes*top_n candidates are enough.
    """
    base = _unweighted(edges)
    d = _degree_table(symmetric(base)).withColumn("_neg", -F.col("degree"))
    r = cut_lineage(global_rank(d, "_neg", "node", "pos").drop("_neg"))
    m = base.count()
    left = r.filter(F.col("pos") * (F.col("pos") - 1) / 2 <= m + top_n)
    last = r.agg(F.max("pos")).first()[0] or 0
    cand = left.select(
        F.col("node").alias("_a"), F.col("degree").alias("_da"),
        F.explode(F.sequence(F.col("pos") + 1, F.least(F.lit(last).cast("long"), F.col("pos") + 1 + F.col("degree") + top_n))).alias("pos"),
    ).filter(F.col("pos") <= last)
    pairs = cand.join(r, "pos").filter(F.col("_a") != F.col("node")).select(
        F.least("_a", "node").alias("item_a"), F.greatest("_a", "node").alias("item_b"), (F.col("_da") * F.col("degree")).cast("double").alias("score"))
    pairs = pairs.distinct().join(base.select(F.col("src").alias("item_a"), F.col("dst").alias("item_b")), ["item_a", "item_b"], "left_anti")
    return pairs.orderBy(F.desc("score"), "item_a", "item_b").limit(top_n)


def zero_pairs(edges: DataFrame, scored: DataFrame, top_n: int) -> DataFrame:
    """First ``top_n`` unlinked pairs (by name) without a score, found without a cross join.

    In name order, a node with p linked or scored partners meets an unscored one within its next p + top_n nodes.
    """
    base = _unweighted(edges)
    used = base.select(F.col("src").alias("item_a"), F.col("dst").alias("item_b")).unionByName(scored.select("item_a", "item_b")).distinct()
    nodes = base.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    r = cut_lineage(global_rank(nodes, "node", "node", "pos"))
    last = r.agg(F.max("pos")).first()[0] or 0
    busy = used.groupBy(F.col("item_a").alias("node")).agg(F.count(F.lit(1)).alias("_p"))
    cand = r.join(busy, "node", "left").select(
        F.col("node").alias("item_a"),
        F.explode(F.sequence(F.col("pos") + 1, F.greatest(F.col("pos") + 1, F.least(F.lit(last).cast("long"), F.col("pos") + F.coalesce("_p", F.lit(0)) + top_n)))).alias("pos"),
    )
    pairs = cand.join(r, "pos").select("item_a", F.col("node").alias("item_b"))
    return pairs.join(used, ["item_a", "item_b"], "left_anti").orderBy("item_a", "item_b").limit(top_n)


#: Methods whose score is a sum over the common neighbours, by what a neighbour of some degree adds.
SUMMED = {
    "common_neighbors": lambda degree: F.lit(1.0),
    "adamic_adar": lambda degree: F.when(degree > 1, 1.0 / F.log(degree.cast("double"))).otherwise(0.0),
    "resource_allocation": lambda degree: 1.0 / degree,
}


def top_links(edges: DataFrame, method: str = "adamic_adar", top_n: int = 50, digits: int | None = None) -> DataFrame:
    """The exact first ``top_n`` unlinked pairs of a summed method, without the pairs that cannot be among them.

    The score of a pair is a sum over common neighbours, so it is at most what all neighbours of either node add up to: its bound.
    1. The nodes of largest bound, ``4 * sqrt(2 * top_n)`` of them, are paired; their n-th score is a score that the n-th of all pairs reaches too.
    2. Only nodes whose bound reaches it are paired. Where the first pairs are fewer than ``top_n``, that is every node.
    With ``digits`` scores are rounded before they are ranked. Returns ``item_a, item_b, score, method``; ties go by name.
    """
    if method not in SUMMED:
        raise ValueError(f"no bound for method: {method}")
    base = cut_lineage(_unweighted(edges))
    sym = symmetric(base)
    adds = _degree_table(sym).select(F.col("node").alias("u"), SUMMED[method](F.col("degree")).alias("adds"))
    rows = sym.select("u", "v").join(adds, "u")
    bounds = rows.groupBy("v").agg(F.sum("adds").alias("bound"))
    rows, bounds = cut_lineage(rows.join(bounds, "v")), cut_lineage(bounds)
    linked = base.select(F.col("src").alias("item_a"), F.col("dst").alias("item_b"))

    def best(part: DataFrame) -> DataFrame:
        # hubs keep what they add although their lists are shorter now
        pairs = pairs_in_groups(part.select("u", "v"), "u", "v", carry=adds)
        scored = pairs.groupBy("item_a", "item_b").agg(F.sum("adds").alias("score")).join(linked, ["item_a", "item_b"], "left_anti")
        scored = scored if digits is None else scored.withColumn("score", F.round("score", digits))
        return scored.orderBy(F.desc("score"), "item_a", "item_b").limit(top_n)

    seeds = bounds.orderBy(F.desc("bound"), "v").limit(4 * math.isqrt(2 * top_n) + 4).select("v")  # bounded by top_n
    n, least = best(rows.join(F.broadcast(seeds), "v", "left_semi")).agg(F.count(F.lit(1)), F.min("score")).first()
    if n >= top_n:
        room = 1e-9 * abs(least) + (0.0 if digits is None else 10.0**-digits)
        rows = rows.filter(F.col("bound") >= least - room)
    return best(rows).select("item_a", "item_b", "score", F.lit(method).alias("method"))


def predict_links(edges: DataFrame, method: str = "adamic_adar", top_n: int = 50, include_zero: bool = False) -> DataFrame:
    """Best unlinked pairs by one method: ``item_a, item_b, score, method``. Unknown methods are an error.

    Pairs without a common neighbour score 0 and are listed only with ``include_zero``, after all others.
    """
    if method == "preferential_attachment":
        out = preferential_attachment(edges, top_n)
    elif method == "katz":
        out = katz(edges).orderBy(F.desc("score"), "item_a", "item_b").limit(top_n)
    elif method in NEIGHBOUR_METHODS:
        scored = neighbour_scores(edges)
        out = scored.select("item_a", "item_b", F.col(method).cast("double").alias("score"))
        out = out.orderBy(F.desc("score"), "item_a", "item_b").limit(top_n)
        if include_zero:
            rest = zero_pairs(edges, scored, top_n).withColumn("score", F.lit(0.0))
            out = out.unionByName(rest).orderBy(F.desc("score"), "item_a", "item_b").limit(top_n)
    else:
        raise ValueError(f"unknown method: {method}")
    return out.select("item_a", "item_b", "score", F.lit(method).alias("method"))


def walk_tables(edges: DataFrame, longest: int) -> list[DataFrame]:
    """Number of walks between each ordered pair ``u, v``, a table (``u, v, n``) for each length from 2 to ``longest``.

    Walks of two steps are common neighbours, which a hub's neighbour list gives block by block, and the degree for a node and itself. They
    are stored and every further length is one product of the table before with the links, stored in turn.
    """
    base = cut_lineage(_unweighted(edges))
    sym = symmetric(base).select("u", "v")
    half = pairs_in_groups(sym, "u", "v").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n"))
    both = half.select(F.explode(F.array(F.struct(F.col("item_a").alias("u"), F.col("item_b").alias("v"), "n"), F.struct(F.col("item_b").alias("u"), F.col("item_a").alias("v"), "n"))).alias("e")).select("e.*")
    tables = [cut_lineage(both.unionByName(_degree_table(sym).select(F.col("node").alias("u"), F.col("node").alias("v"), F.col("degree").alias("n"))))]
    step = sym.select(F.col("u").alias("v"), F.col("v").alias("_next"))
    for _ in range(longest - 2):
        tables.append(cut_lineage(tables[-1].join(step, "v").groupBy("u", F.col("_next").alias("v")).agg(F.sum("n").alias("n"))))
    return tables


def katz(edges: DataFrame, beta: float = 0.001, max_path: int = 3) -> DataFrame:
    """Truncated Katz index of unlinked pairs with at least one walk: sum of beta^k times the walks of length k."""
    base = _unweighted(edges)
    total = None
    for k, walks in enumerate(walk_tables(edges, max(max_path, 2)), 2):  # walks of length 1 are links
        part = walks.filter(F.col("u") < F.col("v")).select("u", "v", (F.col("n") * F.lit(beta**k)).alias("s"))
        total = part if total is None else total.unionByName(part)
    scored = total.groupBy(F.col("u").alias("item_a"), F.col("v").alias("item_b")).agg(F.sum("s").alias("score"))
    return scored.join(base.select(F.col("src").alias("item_a"), F.col("dst").alias("item_b")), ["item_a", "item_b"], "left_anti")


def target_similarity(item_targets: DataFrame) -> DataFrame:
    """Jaccard similarity of target sets for item pairs with a common target (all other pairs are 0)."""
    t = item_targets.select("item", "target").filter(F.col("target").isNotNull()).distinct()
    common = pairs_in_groups(t, "target", "item").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("common_targets"))
    n = t.groupBy("item").agg(F.count(F.lit(1)).alias("_n"))
    both = common.join(n.withColumnsRenamed({"item": "item_a", "_n": "_na"}), "item_a").join(
        n.withColumnsRenamed({"item": "item_b", "_n": "_nb"}), "item_b")
    return both.select("item_a", "item_b", "common_targets",
                       safe_div("common_targets", F.col("_na") + F.col("_nb") - F.col("common_targets")).alias("target_similarity"))


def predict_with_targets(edges: DataFrame, item_targets: DataFrame, top_n: int = 50,
                         weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Best unlinked pairs by the combined score of :func:`combined_scores`."""
    return combined_scores(edges, item_targets, weights).orderBy(F.desc("score"), "item_a", "item_b").limit(top_n)


def combined_scores(edges: DataFrame, item_targets: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Unlinked pairs by ``w1 * Adamic-Adar + w2 * Jaccard + w3 * target similarity``.

    Candidates are pairs with a common neighbour or a common target; both ends must be graph nodes.
    """
    base = _unweighted(edges)
    nodes = base.select(F.explode(F.array("src", "dst")).alias("item")).distinct()
    sims = target_similarity(item_targets.join(nodes, "item", "left_semi"))
    sims = sims.join(base.select(F.col("src").alias("item_a"), F.col("dst").alias("item_b")), ["item_a", "item_b"], "left_anti")
    scores = neighbour_scores(edges).select("item_a", "item_b", "adamic_adar", "jaccard")
    both = scores.join(sims, ["item_a", "item_b"], "full_outer").na.fill(
        {"adamic_adar": 0.0, "jaccard": 0.0, "target_similarity": 0.0, "common_targets": 0})
    wa, wj, wt = weights
    score = wa * F.col("adamic_adar") + wj * F.col("jaccard") + wt * F.col("target_similarity")
    return both.withColumn("score", score).select(
        "item_a", "item_b", "score", "adamic_adar", "jaccard", "target_similarity", "common_targets", F.lit("combined").alias("method"))


def items_for_target(item_targets: DataFrame, items: DataFrame, target: str, top_n: int = 20) -> DataFrame:
    """Items that hit a target, strongest first, with their category and nature ("" when unknown)."""
    hits = item_targets.filter(F.col("target") == target).orderBy(F.desc("affinity"), "item").limit(top_n)
    dim = items.select(F.col("name").alias("item"), "category", "nature")
    return hits.join(dim, "item", "left").select(
        "item", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("nature", F.lit("")).alias("nature"),
        "target", "affinity", "effect_type").orderBy(F.desc("affinity"), "item")


def pair_detail(basket_items: DataFrame, baskets: DataFrame, items: DataFrame, item_targets: DataFrame, edges: DataFrame,
                item_a: str, item_b: str, attributes: tuple[str, ...] = ("category", "nature"), min_count: int = 3,
                top_baskets: int = 10) -> dict[str, DataFrame]:
    """Dossier of one pair: a summary row (statistics, target overlap, link status and score) and its top baskets.

    ``edges(src, dst, count)`` is the co-occurrence graph; a pair that is not in it gets its Adamic-Adar score
    over the edges with at least ``min_count`` baskets.
    """
    from .baskets import pair_support
    from .rows import search_by_items

    lo, hi = sorted((item_a, item_b))
    stats = pair_support(basket_items, item_a, item_b)
    sets = item_targets.filter(F.col("item").isin(item_a, item_b)).groupBy("target").agg(
        F.max((F.col("item") == item_a).cast("int")).alias("_a"), F.max((F.col("item") == item_b).cast("int")).alias("_b"))
    overlap = sets.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("targets_a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("targets_b"),
        F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("common_target_count"),
        F.count(F.lit(1)).alias("_all"))
    known = edges.filter((F.least("src", "dst") == lo) & (F.greatest("src", "dst") == hi)).agg((F.count(F.lit(1)) > 0).alias("is_known_pair"))
    strong = symmetric(_unweighted(edges.filter(F.col("count") >= min_count)))
    common = strong.filter(F.col("u").isin(item_a, item_b)).groupBy("v").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 2)
    deg = strong.join(common.select(F.col("v").alias("u")), "u", "left_semi").groupBy("u").agg(F.count(F.lit(1)).alias("_d"))
    aa = deg.agg(F.coalesce(F.sum(F.when(F.col("_d") > 1, 1.0 / F.log("_d"))), F.lit(0.0)).alias("_aa"))
    parts = [overlap, known, aa]
    for side, name in (("a", item_a), ("b", item_b)):
        parts.append(items.filter(F.col("name") == name).agg(*[F.coalesce(F.first(x), F.lit("")).alias(f"{x}_{side}") for x in attributes]))
    row = stats.select("*", *[one_row(p).alias(f"_part{i}") for i, p in enumerate(parts)])
    row = row.select(*stats.columns, *[f"_part{i}.*" for i in range(len(parts))])
    summary = row.withColumn("target_similarity", safe_div("common_target_count", "_all")).withColumn(
        "prediction_score", F.when(F.col("is_known_pair"), 0.0).otherwise(F.col("_aa"))).drop("_all", "_aa")
    both = search_by_items(basket_items, [item_a, item_b], match_all=True).select("basket_id")
    top = baskets.join(both, "basket_id", "left_semi").orderBy(F.desc("frequency"), "basket_id").limit(top_baskets)
    either = search_by_items(basket_items, [item_a, item_b], match_all=False).select("basket_id")
    top_either = baskets.join(either, "basket_id", "left_semi").orderBy(F.desc("frequency"), "basket_id").limit(top_baskets)
    return {"summary": summary, "baskets_with_both": top, "baskets_with_either": top_either}
