"""Exact ranks inside groups of any size and of any sortable type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import cut_lineage


def ranked(df: DataFrame, keys: Sequence[str], value: str, tie: str, rank_col: str = "rank") -> DataFrame:
    """Add the 0-based position of each row of its group in (value, tie) order, and the group size ``<rank>_n``.

    The table is range-partitioned by (keys, value, tie), which cuts a large group into as many ranges as its size needs,
    strings by their whole value; rows that tie in all of these are told apart by a hash of the row. The sorted
    table is stored, so that a recomputed task sees the same ranges. Each range of a group is numbered by itself, and the
    rows of the group's ranges before it - one number per range - are added.
    """
    keys = list(keys)
    order = [*keys, value, tie]
    sorted_ = df.withColumn("_h", F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])).repartitionByRange(*order, "_h")
    placed = cut_lineage(sorted_.withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(F.asc(value), F.asc(tie), "_h"))
    sizes = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*keys)
    before = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                          (F.sum("_c").over(by.orderBy("_range")) - F.col("_c")).alias("_before"), F.sum("_c").over(by).alias(rank_col + "_n"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.withColumn("_i", inside).join(before, same).withColumn(rank_col, (F.col("_i") - 1 + F.col("_before")).cast("long"))
    return out.select(*df.columns, rank_col, rank_col + "_n")


def upper_median(df: DataFrame, keys: Sequence[str], value: str, tie: str, alias: str = "median") -> DataFrame:
    """``sorted(values)[n // 2]`` per group."""
    r = ranked(df.filter(F.col(value).isNotNull()), keys, value, tie, "_r")
    return r.filter(F.col("_r") == F.floor(F.col("_r_n") / 2)).select(*keys, F.col(value).alias(alias))


def global_rank(df: DataFrame, order: str, tie: str, rank_col: str = "rank") -> DataFrame:
    """0-based rank over the whole table, in (order, tie) order."""
    return ranked(df.withColumn("_all", F.lit(1)), ["_all"], order, tie, rank_col).drop("_all", rank_col + "_n")
