"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, multi-index Hamming blocks.

1. Words: maximal runs of letters and digits of the lower-cased text. A shingle is five words in a row, and weighs
   ``ln(1 + M / m)`` for a shingle found in m of the M items (a phrase of many items says little about one).
2. Fingerprints: each item with n words has a 64-bit SimHash of its weighted shingles. A window of a document is n
   words, for each length n that an item has, and is fingerprinted alike, a shingle outside the benchmark weighing
   ``ln(1 + M)``, no less than any other. So a window of which less than the threshold's share of shingles is in the benchmark
   is below the threshold with every item; it is left out before anything is fingerprinted, which loses nothing.
3. Candidates: fingerprints are cut into ``RADIUS + 1`` blocks. Two that differ in at most ``RADIUS`` bits agree in one block
   at least (pigeonhole), so an equi-join on (length, block, value) finds every window within the radius of an item.
4. Verification: exact weighted Jaccard similarity of the window's and the item's shingle counts.

The expected distance of two sets with similarity 0.8 is 9.7 bits of 64, so a radius of 19 lies 3.3 standard deviations above.

Scale: the documents' words are never shuffled but for documents that hold a benchmark shingle. The benchmark's shingle
table is broadcast up to ``BROADCAST_ROWS`` (counted); a larger one is joined by shuffle.

Defined cases: null and empty texts, and items of fewer than five words, have no shingle and match nothing; items that
repeat a text are reported each, rows that repeat an item_id must have one text; rows that repeat a doc_id are windowed each and reported together; a null doc_id is reported
as null; of equally similar windows the first is reported; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut_lineage
from ..functions.scalars import once

WIDTH, RADIUS, THRESHOLD = 5, 19, 0.8
#: Rows of the benchmark's shingle table up to which it is broadcast.
BROADCAST_ROWS = 500_000
#: Bits per counting lane (two lanes to a number), and the factor by which weights become whole numbers.
LANE, SCALE = 31, 16


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", -1), lambda w: w != "")


def with_shingles(df: DataFrame, text: Column, name: str = "hs") -> DataFrame:
    """Add the 64-bit hash of each run of five words, by position, and ``n_words``.

    The words are computed once per row, behind a boundary: inside the lambda an expression would be evaluated anew for
    every position.
    """
    df = once(df, "_words", words_of(text))
    last = F.size("_words") - WIDTH
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice("_words", i + 1, WIDTH)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("n_words", F.size("_words")).withColumn(name, hashes).drop("_words")


def _lanes(h: Column, w: Column) -> list[Column]:
    """The weight ``w`` in the lane of each set bit of ``h``: 32 numbers of two lanes."""
    return [(F.shiftright(h, k).bitwiseAND(F.lit(1)) * w + F.shiftleft(F.shiftright(h, k + 1).bitwiseAND(F.lit(1)) * w, LANE)).alias(f"s{k // 2}") for k in range(0, 64, 2)]


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash per group of ``rows (keys, h, weight)``, a row per shingle occurrence."""
    whole = rows.select(*keys, F.xxhash64("h").alias("_h"), F.round(F.col("weight") * SCALE).cast("long").alias("_w"))
    summed = whole.select(*keys, "_w", *_lanes(F.col("_h"), F.col("_w"))).groupBy(*keys).agg(F.sum("_w").alias("_w"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(32)))
    bits = F.lit(0).cast("long")
    for k in range(64):
        lane = F.shiftright(F.col(f"s{k // 2}"), LANE * (k % 2)).bitwiseAND(F.lit((1 << LANE) - 1))
        bits = bits.bitwiseOR(F.shiftleft((lane * 2 > F.col("_w")).cast("long"), k))
    return summed.select(*keys, bits.alias("fingerprint"))


def blocks(fingerprint: Column) -> Column:
    """``RADIUS + 1`` blocks of three or four bits, as (block number, value) in one number each."""
    out, at, n = [], 0, RADIUS + 1
    for k in range(n):
        width = 64 // n + (1 if k < 64 % n else 0)
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1))
        out.append(value + F.lit(k << 8).cast("long"))
        at += width
    return F.array(*out)


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, n_words, hs`` (shingles by position) of items with at least one shingle."""
    return with_shingles(benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("_text")), F.col("_text")).drop("_text").filter(F.size("hs") > 0)


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, position, n_words, similarity``: the most similar window of every document and item at ``threshold`` or above.

    ``position`` counts words; a document shorter than an item is one window.
    """
    items = cut_lineage(items_of(benchmark))
    of_items = items.select("item_id", "n_words", F.explode("hs").alias("h"))
    n_items = float(items.count())
    rare = F.log1p(F.lit(n_items))
    # shingle, weight and the lengths of the items that hold it
    table = cut_lineage(of_items.groupBy("h").agg(F.log1p(F.lit(n_items) / F.count_distinct("item_id")).alias("weight"), F.collect_set("n_words").alias("lengths")))
    small = F.broadcast if table.count() <= BROADCAST_ROWS else (lambda df: df)

    # where documents hold a shingle of an item, and how long such items are
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("_text"))
    hashed = with_shingles(rows, F.col("_text")).select("doc_id", "row", F.posexplode("hs").alias("at", "h"))
    hits = hashed.join(small(table), "h").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("ats"), F.array_distinct(F.flatten(F.collect_set("lengths"))).alias("lengths"))
    hits = cut_lineage(hits)

    # item-sized windows over those places
    held = hits.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))
    found = with_shingles(rows.join(held, same, "left_semi"), F.col("_text")).select("doc_id", "row", "hs").dropDuplicates(["doc_id", "row"])
    found = cut_lineage(found).withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    size = F.col("n_words") - (WIDTH - 1)
    last = F.greatest(F.size("hs") - size, F.lit(0))
    window = ["doc_id", "row", "n_words", "position"]
    windows = hits.select("doc_id", "row", "ats", F.explode("lengths").alias("n_words")).join(found, same)
    # windows that hold ``least`` places or more: those between the end of such a run of places and its begin
    windows = windows.withColumn("least", F.ceil(F.least(size, F.size("hs")) * F.lit(threshold) - 1e-9).cast("int")).filter(F.size("ats") >= F.col("least"))
    runs = F.filter(F.sequence(F.lit(0), F.size("ats") - F.col("least")), lambda i: F.get("ats", i + F.col("least") - 1) - F.get("ats", i) < size)
    begins = F.transform(runs, lambda i: F.sequence(F.greatest(F.get("ats", i + F.col("least") - 1) - size + 1, F.lit(0)), F.least(F.get("ats", i), last)))
    windows = windows.select("doc_id", "row", "n_words", "hs", F.explode(F.array_distinct(F.flatten(begins))).alias("position"))
    windows = windows.select(*window, F.explode(F.slice("hs", F.col("position") + 1, size)).alias("h"))
    weighed = windows.join(small(table.select("h", "weight")), "h", "left").select(*window, "h", F.coalesce("weight", rare).alias("weight"))
    prints = fingerprints(weighed, window)

    # candidates within the radius
    item_prints = fingerprints(of_items.join(small(table.select("h", "weight")), "h"), ["item_id", "n_words"])
    right = item_prints.select("item_id", "n_words", F.col("fingerprint").alias("_fingerprint"), F.explode(blocks(F.col("fingerprint"))).alias("block"))
    left = prints.select(*window, "fingerprint", F.explode(blocks(F.col("fingerprint"))).alias("block"))
    near = left.join(small(cut_lineage(right)), ["n_words", "block"]).filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("_fingerprint"))) <= RADIUS)
    near = cut_lineage(near.select(*window, "item_id").distinct())

    # exact similarity: the counts of both sides by shingle
    pair = [*window, "item_id"]
    ours = near.join(found, same).select(*pair, F.explode(F.slice("hs", F.col("position") + 1, size)).alias("h"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    theirs = near.join(small(items.select("item_id", "hs").dropDuplicates(["item_id"])), "item_id").select(*pair, F.explode("hs").alias("h"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    counts = ours.unionByName(theirs).groupBy(*pair, "h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = counts.join(small(table.select("h", "weight")), "h", "left").withColumn("weight", F.coalesce("weight", rare))
    alike = counts.groupBy(*pair).agg((F.sum(F.least("a", "b") * F.col("weight")) / F.sum(F.greatest("a", "b") * F.col("weight"))).alias("similarity"))
    best = alike.filter(F.col("similarity") >= threshold).groupBy("doc_id", "item_id", "n_words").agg(
        F.max(F.struct(F.col("similarity"), (-F.col("position")).alias("p"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.p")).alias("position"), "n_words", F.col("best.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` of the documents with a match."""
    return matches(docs, benchmark, doc_id, text, threshold).select("doc_id").distinct()
