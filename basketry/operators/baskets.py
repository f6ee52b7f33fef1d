"""Basket mining: co-occurrence, frequent itemsets, association rules, pair statistics.

``basket_items(basket_id, item)`` is the input; repeated items inside one basket count once.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from ..functions.groups import pairs_in_groups, small_side
from ..functions.lineage import cut_lineage
from ..functions.scalars import safe_div
from .rows import top_k_per_group


#: Baskets whose membership is one row of bits; a multiple of 64 that divides 2^33.
SLICE = 4096


def co_occurrence(basket_items: DataFrame, basket_weights: DataFrame | None = None, weight: str = "frequency", min_count: int = 1) -> DataFrame:
    """Unordered item pairs that share baskets: ``item_a < item_b, count, weight`` (sum of the basket weight).

    With ``basket_weights(basket_id, <weight>)`` the weight column is that sum, otherwise it equals the count.
    """
    if basket_weights is None:
        pairs = pairs_in_groups(basket_items, "basket_id", "item")
        out = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("count"))
        out = out.withColumn("weight", F.col("count").cast("double"))
    else:
        w = basket_weights.select("basket_id", F.col(weight).alias("_w"))
        out = pairs_in_groups(basket_items, "basket_id", "item", carry=w).groupBy("item_a", "item_b").agg(
            F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("weight"))
    return out.filter(F.col("count") >= min_count) if min_count > 1 else out


def item_counts(basket_items: DataFrame) -> DataFrame:
    """Baskets per item (map-side combined, so a hot item is only a number per task)."""
    return basket_items.select("basket_id", "item").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("count"))


def basket_total(basket_items: DataFrame) -> int:
    """Number of distinct baskets."""
    return basket_items.select("basket_id").distinct().count()


def frequent_baskets(basket_items: DataFrame, min_support: float) -> tuple[DataFrame, DataFrame, int]:
    """Frequent items, the distinct baskets cut down to them, and the number of all baskets.

    At most (mean basket size / min_support) items can be frequent, so that table and every remaining basket
    are small by construction, whatever the largest basket was. Equal baskets are merged with a multiplicity.
    """
    items = cut_lineage(basket_items.select("basket_id", "item").filter(F.col("item").isNotNull()).distinct())
    n = basket_total(items)
    counts = cut_lineage(items.groupBy("item").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= _min_count(min_support, n)))
    kept = items.join(small_side(counts.count(), counts.select("item")), "item", "left_semi")
    baskets = kept.groupBy("basket_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    merged = baskets.groupBy("items").agg(F.count(F.lit(1)).alias("multiplicity"))
    return counts, cut_lineage(merged), n


def _min_count(min_support: float, n: int) -> int:
    """Smallest count whose support reaches min_support."""
    if n == 0:
        return 1
    k = max(1, math.ceil(min_support * n) - 1)
    while k / n < min_support:
        k += 1
    return k


def _vertical(baskets: DataFrame) -> DataFrame:
    """Which baskets hold an item, as bits: ``slice, prefix, last, words, times`` per slice of ``SLICE`` baskets and item.

    A multiplicity is written in binary: a merged basket has a place for each of its bits, and a slice holds places of one bit only, each
    worth ``times`` baskets. Places follow the order of a stored table, so they are settled once. A row has a bounded size, and a
    slice has at most one row per frequent item, however long its baskets are.
    """
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit(F.col("multiplicity"), b) == 1)).alias("_bit")
    placed = cut_lineage(baskets.select("items", bit).sortWithinPartitions("_bit").withColumn("_at", F.monotonically_increasing_id()))
    # the id counts from 0 in each partition, whose number is in the bits from 33 upwards; SLICE divides 2^33
    place = F.pmod("_at", F.lit(SLICE))
    flat = placed.select(F.struct(F.floor(F.col("_at") / SLICE).alias("number"), "_bit").alias("slice"), place.alias("_p"), F.explode("items").alias("last"))
    word = flat.groupBy("slice", "last", F.floor(F.col("_p") / 64).cast("int").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_p % 64 AS INT))")).alias("_v"))
    rows = word.groupBy("slice", "last").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_v"))).alias("_m"))
    words = F.transform(F.sequence(F.lit(0), F.lit(SLICE // 64 - 1)), lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0).cast("long")))
    nothing = F.slice(F.array("last"), 1, 0)  # an empty array of the items' type
    return rows.select("slice", nothing.alias("prefix"), "last", words.alias("words"), F.expr("shiftleft(1L, slice._bit)").alias("times"))


def _intersections(sets: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Sets one item longer, from two that differ in the last item only: ``slice, itemset, words, times``; only ``wanted`` itemsets."""
    right = sets.select("slice", "prefix", F.col("last").alias("_last"), F.col("words").alias("_words"))
    both = sets.join(right, ["slice", "prefix"]).filter(F.col("last") < F.col("_last"))
    both = both.withColumn("itemset", F.concat("prefix", F.array("last", "_last")))
    if wanted is not None:
        both = both.join(wanted, "itemset", "left_semi")
    return both.select("slice", "itemset", F.zip_with("words", "_words", lambda x, y: x.bitwiseAND(y)).alias("words"), "times")


def _candidates(found: DataFrame, size: int) -> DataFrame:
    """Itemsets of ``size`` items (3 or more) of which every subset one item shorter is in ``found``: ``itemset``."""
    parts = found.select(F.slice("itemset", 1, size - 2).alias("prefix"), F.element_at("itemset", -1).alias("last"))
    pairs = parts.join(parts.withColumnRenamed("last", "_last"), "prefix").filter(F.col("last") < F.col("_last"))
    pairs = pairs.select(F.concat("prefix", F.array("last", "_last")).alias("itemset"))
    # the two it is made of are found; the others leave out an item of the prefix
    subsets = F.transform(F.sequence(F.lit(0), F.lit(size - 3)), lambda k: F.filter("itemset", lambda _, i: i != k))
    known = pairs.select("itemset", F.explode(subsets).alias("_sub")).join(found.select(F.col("itemset").alias("_sub")), "_sub", "left_semi")
    return known.groupBy("itemset").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size - 2).select("itemset")


def _vertical_levels(baskets: DataFrame, threshold: int, max_length: int | None) -> list[DataFrame]:
    """Frequent itemsets of two items and more, a stored table per size, until a size has none.

    A level is counted from the intersections without storing them (a number per itemset and task is shuffled); those of the
    frequent itemsets are then taken once more and stored for the next level, so sets that fail are never written.
    """
    sets, wanted, levels = cut_lineage(_vertical(baskets)), None, []
    while max_length is None or len(levels) + 2 <= max_length:
        held = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w)) * F.col("times")
        counted = _intersections(sets, wanted).groupBy("itemset").agg(F.sum(held).alias("count"))
        found = cut_lineage(counted.filter(F.col("count") >= threshold))
        n = found.count()
        if n == 0:
            break
        levels.append(found)
        size = len(levels) + 2
        if max_length is not None and size > max_length:
            break
        wanted = cut_lineage(_candidates(found, size))
        n_wanted = wanted.count()
        if n_wanted == 0:
            break
        wanted = small_side(n_wanted, wanted)
        grown = _intersections(sets, small_side(n, found.select("itemset"))).filter(F.exists("words", lambda w: w != 0))
        sets = cut_lineage(grown.select("slice", F.slice("itemset", 1, size - 2).alias("prefix"), F.element_at("itemset", -1).alias("last"), "words", "times"))
    return levels


def frequent_itemsets(basket_items: DataFrame, min_support: float = 0.05, max_length: int | None = 3, method: str = "levelwise") -> DataFrame:
    """Itemsets with support >= min_support and at most ``max_length`` items: ``itemset, size, count, support``.

    ``levelwise`` grows itemsets by one item per level, only from frequent prefixes; ``fpgrowth`` uses MLlib; ``vertical`` keeps the baskets
    of an itemset as bits and intersects them, for candidates whose every subset is frequent, so a long basket costs bits instead
    of all its combinations. Only ``vertical`` takes ``max_length=None`` (any size).
    All read the merged baskets, so the raw table is scanned three times whatever the number of levels.
    """
    if method not in ("levelwise", "fpgrowth", "vertical") or (max_length is None and method != "vertical"):
        raise ValueError(f"unknown method: {method}")
    counts, baskets, n = frequent_baskets(basket_items, min_support)
    threshold = _min_count(min_support, n)
    if method == "fpgrowth":
        # multiplicity is expanded because MLlib has no weights
        rows = baskets.select("items", F.explode(F.sequence(F.lit(1).cast("long"), "multiplicity"))).select("items")
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, threshold / max(n, 1) * 0.999999)).fit(rows)
        # supports are relative to baskets with a frequent item, so the exact count decides
        out = model.freqItemsets.select(F.sort_array("items").alias("itemset"), F.col("freq").alias("count"))
        out = out.filter((F.col("count") >= threshold) & (F.size("itemset") <= max_length))
    elif method == "vertical":
        out = counts.select(F.array("item").alias("itemset"), "count")
        if max_length is None or max_length > 1:
            for found in _vertical_levels(baskets, threshold, max_length):
                out = out.unionByName(found)
    else:
        out = counts.select(F.array("item").alias("itemset"), "count")
        grown = baskets.select("items", "multiplicity", F.explode("items").alias("_i")).select("items", "multiplicity", F.array("_i").alias("itemset"))
        for level in range(2, max_length + 1):
            grown = grown.select(
                "items", "multiplicity", "itemset",
                F.explode(F.filter("items", lambda x: x > F.element_at("itemset", -1))).alias("_next"),
            ).select("items", "multiplicity", F.concat("itemset", F.array("_next")).alias("itemset"))
            found = grown.groupBy("itemset").agg(F.sum("multiplicity").alias("count")).filter(F.col("count") >= threshold)
            found = cut_lineage(found)
            if level < max_length:
                grown = grown.join(found.select("itemset"), "itemset", "left_semi")
            out = out.unionByName(found)
    return out.select("itemset", F.size("itemset").alias("size"), "count", (F.col("count") / F.lit(max(n, 1))).alias("support"))


def itemsets_by_size(itemsets: DataFrame, limit: int = 50) -> DataFrame:
    """Top ``limit`` itemsets of every size."""
    return top_k_per_group(itemsets, ["size"], [F.desc("count"), F.asc("itemset")], limit)


def association_rules(itemsets: DataFrame, min_confidence: float = 0.3, min_lift: float = 1.0) -> DataFrame:
    """Rules from every non-empty proper subset of every itemset: support, confidence, lift.

    Subsets come from the bits of 1..2^k-2 (k <= 5). Two joins on the itemset give the supports of both sides.
    """
    bases = itemsets.filter(F.col("size") >= 2).select("itemset", "count", "support")
    masks = bases.withColumn("_m", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("itemset")).cast("int") - 2)))

    def side(bit):
        return F.filter("itemset", lambda x, i: F.getbit(F.col("_m"), i) == bit)

    rules = masks.select(side(1).alias("antecedent"), side(0).alias("consequent"), "count", "support")
    supports = itemsets.select(F.col("itemset"), F.col("support").alias("_s"))
    out = (
        rules.join(supports.withColumnsRenamed({"itemset": "antecedent", "_s": "antecedent_support"}), "antecedent")
        .join(supports.withColumnsRenamed({"itemset": "consequent", "_s": "consequent_support"}), "consequent")
        .withColumn("confidence", F.col("support") / F.col("antecedent_support"))
        .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
    )
    return out.filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).select(
        "antecedent", "consequent", "count", "support", "confidence", "lift")


def rank_rules(rules: DataFrame, limit: int) -> DataFrame:
    """Best rules by support, confidence, then the items."""
    return rules.orderBy(F.desc("support"), F.desc("confidence"), F.asc("antecedent"), F.asc("consequent")).limit(limit)


def pair_stats(basket_items: DataFrame, total: int | None = None) -> DataFrame:
    """All co-occurring pairs with counts, support, both confidences and lift.

    The de-duplicated basket table is stored once; counting, pairing and the item counts all read it.
    """
    basket_items = cut_lineage(basket_items.select("basket_id", "item").distinct())
    n = F.lit(basket_total(basket_items) if total is None else total)
    pairs = co_occurrence(basket_items).select("item_a", "item_b", "count")
    singles = item_counts(basket_items)
    a = singles.withColumnsRenamed({"item": "item_a", "count": "count_a"})
    b = singles.withColumnsRenamed({"item": "item_b", "count": "count_b"})
    return (
        pairs.join(a, "item_a").join(b, "item_b")
        .withColumn("support", safe_div("count", n))
        .withColumn("confidence_a_to_b", safe_div("count", "count_a"))
        .withColumn("confidence_b_to_a", safe_div("count", "count_b"))
        .withColumn("lift", safe_div(F.col("count") * n, F.col("count_a").cast("double") * F.col("count_b")))
        .select("item_a", "item_b", "count", "count_a", "count_b", "support", "confidence_a_to_b", "confidence_b_to_a", "lift")
    )


def pair_support(basket_items: DataFrame, item_a: str, item_b: str) -> DataFrame:
    """Statistics of one pair; a single pass, no self-join."""
    flags = (
        basket_items.groupBy("basket_id")
        .agg(F.max((F.col("item") == item_a).cast("int")).alias("_a"), F.max((F.col("item") == item_b).cast("int")).alias("_b"))
        .agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("_a"), F.lit(0)).alias("count_a"),
             F.coalesce(F.sum("_b"), F.lit(0)).alias("count_b"), F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("count_ab"))
    )
    expected = safe_div("count_a", "total") * safe_div("count_b", "total")
    return flags.select(
        F.lit(item_a).alias("item_a"), F.lit(item_b).alias("item_b"), "total", "count_a", "count_b", "count_ab",
        safe_div("count_ab", "total").alias("support"),
        safe_div("count_ab", "count_a").alias("confidence_a_to_b"),
        safe_div("count_ab", "count_b").alias("confidence_b_to_a"),
        safe_div(safe_div("count_ab", "total"), expected).alias("lift"),
    )


def top_pairs(basket_items: DataFrame, n: int = 20, min_support: float = 0.0) -> DataFrame:
    """Most frequent pairs with count and support."""
    total = basket_total(basket_items)
    pairs = co_occurrence(basket_items, min_count=_min_count(min_support, total))
    out = pairs.select("item_a", "item_b", "count", (F.col("count") / F.lit(max(total, 1))).alias("support"))
    return out.orderBy(F.desc("count"), F.asc("item_a"), F.asc("item_b")).limit(n)


def top_itemsets(itemsets: DataFrame, size: int, n: int = 20) -> DataFrame:
    """Most frequent itemsets of one size (pairs, triplets)."""
    return itemsets.filter(F.col("size") == size).orderBy(F.desc("count"), F.asc("itemset")).limit(n)


def mine_label(label_items: DataFrame, min_support: float = 0.05, min_confidence: float = 0.3, min_lift: float = 1.0,
               max_length: int = 3, n_pairs: int = 20, n_triplets: int = 10, n_rules: int = 30) -> dict[str, DataFrame]:
    """Pairs, triplets and rules within the baskets of one label (see ``sources.tables.with_label``)."""
    itemsets = cut_lineage(frequent_itemsets(label_items, min_support, max_length))
    return {
        "pairs": top_itemsets(itemsets, 2, n_pairs),
        "triplets": top_itemsets(itemsets, 3, n_triplets),
        "rules": rank_rules(association_rules(itemsets, min_confidence, min_lift), n_rules),
    }


def recommend_for_label(basket_items: DataFrame, basket_labels: DataFrame, label: str, top_n: int = 10, n_labels: int = 5) -> dict[str, DataFrame]:
    """Core items of a label, its most frequent pairs with confidence, and the labels those pairs also serve."""
    chosen = basket_items.join(basket_labels.filter(F.col("label") == label).select("basket_id"), "basket_id", "left_semi")
    counts = item_counts(chosen)
    pairs = co_occurrence(chosen).select("item_a", "item_b", "count").orderBy(F.desc("count"), "item_a", "item_b").limit(top_n)
    pairs = pairs.join(counts.select(F.col("item").alias("item_a"), F.col("count").alias("_ca")), "item_a")
    pairs = cut_lineage(pairs.withColumn("confidence", safe_div("count", "_ca")).drop("_ca"))
    wanted = pairs.select("item_a", "item_b").select(F.explode(F.array("item_a", "item_b")).alias("item")).distinct()
    # at most 2 * top_n items remain, and a basket counts for a pair when it holds both of them
    holders = basket_items.select("basket_id", "item").join(F.broadcast(wanted), "item", "left_semi").distinct()
    a = holders.withColumnRenamed("item", "item_a").join(F.broadcast(pairs.select("item_a", "item_b")), "item_a")
    both = a.join(holders.withColumnRenamed("item", "item_b"), ["basket_id", "item_b"])
    related = both.join(basket_labels, "basket_id").groupBy("item_a", "item_b", "label").agg(F.count_distinct("basket_id").alias("_n"))
    ranked = top_k_per_group(related, ["item_a", "item_b"], [F.desc("_n"), F.asc("label")], n_labels, "_r")
    related = ranked.groupBy("item_a", "item_b").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "label"))), lambda s: s["label"]).alias("related_labels"))
    return {
        "core_items": counts.orderBy(F.desc("count"), F.asc("item")).limit(top_n),
        "pairs": pairs.join(related, ["item_a", "item_b"], "left").orderBy(F.desc("count"), "item_a", "item_b"),
    }
