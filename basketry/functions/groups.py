"""Work inside groups whose size is not known in advance.

One group may hold a third of all rows, so nothing here collects a whole group into one task: groups above
``limit`` rows are cut into hash blocks and the blocks are spread over the cluster. Results stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import cut_lineage

#: Largest number of items held together in one array (per group, or per block of a hot group).
BLOCK_ITEMS = 2048
#: Bytes of input files whose rows go to one partition, where rows are dealt out to be told apart.
DEALT_BYTES = 8 << 20
#: Key tables up to this many rows (counted, not assumed) are broadcast; larger ones are joined by shuffle.
BROADCAST_KEYS = 500_000


def hot_groups(df: DataFrame, key: str, limit: int = BLOCK_ITEMS) -> tuple[int, DataFrame]:
    """Keys with more than ``limit`` rows and their row count: (number of such keys, table of keys).

    The count runs once, combined map-side, and its (normally empty) result is stored, so the caller can leave
    the hot-group branch out of the plan when there is none.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    stored = cut_lineage(counted)
    return stored.count(), stored


def small_side(n: int, df: DataFrame) -> DataFrame:
    """Broadcast ``df`` when its counted size allows it; otherwise leave the join to shuffle and AQE."""
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by hash of the keys in as many partitions as its input files ask for, if these are more than the session's; else as it is.

    Without it a task that drops repeats holds a share of the rows that grows with the table, and holds it twice.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in df.inputFiles()]
    n = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) // DEALT_BYTES
    return df.repartition(n, *keys) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def pairs_in_groups(df: DataFrame, group: str, item: str, limit: int = BLOCK_ITEMS, carry: DataFrame | None = None,
                    counted: bool = False) -> DataFrame:
    """Distinct unordered item pairs of each group: ``group, item_a < item_b, group_size``, and the columns of ``carry``.

    ``carry(group, ...)`` has a row per group; it is joined to the groups before they are paired out, never to the pairs.

    Ordinary groups take one shuffle: a de-duplicated array per group, from which the pairs are generated row by
    row (streamed by Generate, and combined map-side by the aggregation that follows). A group with more than
    ``limit`` rows is split into blocks by item hash; each pair of blocks is a separate row, so its pairs are
    produced by many tasks. ``counted`` spares the count of the rows where the caller knows that no group has more than ``limit``.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(item).alias("_i")).filter(F.col("_g").isNotNull() & F.col("_i").isNotNull())
    n_hot, hot = (0, rows) if counted else hot_groups(rows, "_g", limit)
    more = [c for c in carry.columns if c != group] if carry is not None else []
    cols = [F.col("_g").alias(group), "item_a", "item_b", "group_size", *more]

    def carrying(groups: DataFrame) -> DataFrame:
        return groups.join(carry.withColumnRenamed(group, "_g"), "_g", "left") if more else groups

    small = rows.join(small_side(n_hot, hot.select("_g")), "_g", "left_anti") if n_hot else rows
    arrays = small.groupBy("_g").agg(F.sort_array(F.collect_set("_i")).alias("_items")).filter(F.size("_items") > 1)
    pairs = (
        carrying(arrays).select("_g", *more, "_items", F.size("_items").cast("long").alias("group_size"), F.posexplode("_items").alias("_p", "item_a"))
        .select("_g", *more, "item_a", "group_size", F.explode(F.slice("_items", F.col("_p") + 2, F.size("_items"))).alias("item_b"))
        .select(*cols)
    )
    if n_hot == 0:
        return pairs

    big = rows.join(small_side(n_hot, hot), "_g").distinct()
    sizes = carrying(big.groupBy("_g").agg(F.count(F.lit(1)).alias("group_size")))
    big = big.withColumn("_n", F.ceil(F.col("_rows") / limit).cast("int")).withColumn("_b", F.pmod(F.hash("_i"), F.col("_n")))
    blocks = big.groupBy("_g", "_n", "_b").agg(F.collect_set("_i").alias("_items"))
    tagged = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    left = tagged.filter(F.col("_b") <= F.col("_o")).select("_g", F.col("_b").alias("_x"), F.col("_o").alias("_y"), F.col("_items").alias("_l"))
    right = tagged.filter(F.col("_o") <= F.col("_b")).select("_g", F.col("_o").alias("_x"), F.col("_b").alias("_y"), F.col("_items").alias("_r"))
    big_pairs = (
        left.join(right, ["_g", "_x", "_y"])
        .join(small_side(n_hot, sizes), "_g")
        .select("_g", *more, "_x", "_y", "_r", "group_size", F.explode("_l").alias("_u"))
        .select("_g", *more, "_x", "_y", "_u", "group_size", F.explode("_r").alias("_v"))
        .filter((F.col("_x") != F.col("_y")) | (F.col("_u") < F.col("_v")))
        .select("_g", F.least("_u", "_v").alias("item_a"), F.greatest("_u", "_v").alias("item_b"), "group_size", *more)
    )
    return pairs.unionByName(big_pairs.select(*cols))
