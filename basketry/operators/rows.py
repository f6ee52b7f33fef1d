"""Filters, search, counts, paging and top-k over plain tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.groups import small_side
from ..functions.lineage import cut_lineage
from ..functions.scalars import as_col, conjunction, once


def filter_rows(df: DataFrame, **equals) -> DataFrame:
    """AND of equality filters; arguments that are None are ignored."""
    return df.filter(conjunction(F.col(c) == v for c, v in equals.items() if v is not None))


def has_member(array, value) -> Column:
    """Array column contains the value."""
    return F.array_contains(as_col(array), value)


def has_struct_member(array, field: str, value) -> Column:
    """Array of structs has an element whose field equals the value."""
    return F.exists(as_col(array), lambda s: s[field] == value)


def name_matches(column, keyword: str) -> Column:
    """Case-insensitive regular expression match."""
    return as_col(column).rlike("(?i)" + keyword)


def search_by_items(basket_items: DataFrame, items: Sequence[str], match_all: bool = True) -> DataFrame:
    """Baskets of ``basket_items(basket_id, item)`` that hold ALL (or ANY) of the given items, with the hit count."""
    wanted = sorted(set(items))
    hits = (
        basket_items.filter(F.col("item").isin(wanted))
        .groupBy("basket_id")
        .agg(F.count_distinct("item").alias("matched"))
    )
    return hits.filter(F.col("matched") == len(wanted)) if match_all else hits


def search_array_items(df: DataFrame, array: str, items: Sequence[str], match_all: bool = True) -> DataFrame:
    """As :func:`search_by_items` for an array column, without any shuffle."""
    wanted = sorted(set(items))
    lits = F.array(*[F.lit(i) for i in wanted])
    if match_all:
        return df.filter(F.size(F.array_intersect(F.col(array), lits)) == len(wanted))
    return df.filter(F.arrays_overlap(F.col(array), lits))


def text_search(df: DataFrame, query: str, weights: dict[str, float], key: str, sort_by: str, then: str | None = None) -> DataFrame:
    """Weighted full-text search: rows holding any query token, with ``score`` = sum of field weight x token count.

    Tokens are lower-case runs of letters and digits, counted over the whole text by one pattern per field (no token
    arrays, no shuffle). Array fields are searched as their joined text. Ordered by score, then ``sort_by``, then the key.
    """
    tokens = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    if not tokens:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    pattern = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(tokens) + r")(?![\p{L}\p{N}])"
    types = dict(df.dtypes)
    score = F.lit(0.0)
    for field, weight in weights.items():
        text = F.concat_ws(" ", F.col(field)) if types[field].startswith("array") else F.coalesce(F.col(field).cast("string"), F.lit(""))
        score = score + F.lit(float(weight)) * F.regexp_count(F.lower(text), F.lit(pattern))
    out = once(df, "score", score).filter(F.col("score") > 0)
    return out.orderBy(F.desc("score"), F.desc(sort_by), F.asc(key))


def search_many(df: DataFrame, queries: DataFrame, weights: dict[str, float], key: str, sort_by: str, top_k: int = 20) -> DataFrame:
    """:func:`text_search` for all strings of ``queries(query_id, query)`` at once: ``query_id, <key>, score, rank``, the first ``top_k`` of each.

    The documents are read once. Their tokens are kept only where some query asks for them and counted per document, weighted by field;
    these postings meet the queries' tokens by equality. A repeated token of a query counts once; ranks go by score, then
    ``sort_by`` (largest first), then the key; null texts hold no token, and a query without a token finds nothing.
    """
    def tokens(text):
        return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")

    asked = cut_lineage(queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("token")).distinct())
    wanted = cut_lineage(asked.select("token").distinct())
    types = dict(df.dtypes)
    fields = [F.struct(F.lit(float(w)).alias("weight"), tokens(F.concat_ws(" ", c) if types[c].startswith("array") else F.col(c).cast("string")).alias("tokens")) for c, w in weights.items()]
    rows = df.select(F.col(key).alias("_key"), F.col(sort_by).alias("_sort"), F.inline(F.array(*fields))).select("_key", "_sort", "weight", F.explode("tokens").alias("token"))
    postings = rows.join(small_side(wanted.count(), wanted), "token", "left_semi").groupBy("_key", "_sort", "token").agg(F.sum("weight").alias("score"))
    found = postings.join(asked, "token").groupBy("query_id", "_key", "_sort").agg(F.sum("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("_sort"), F.asc("_key"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_k).select("query_id", F.col("_key").alias(key), "score", "rank")


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Row with the given key; an empty result means "not found"."""
    return df.filter(F.col(column) == value).limit(1)


def count_rows(df: DataFrame, **equals) -> DataFrame:
    return filter_rows(df, **equals).agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, sort_by: str, key: str, skip: int = 0, limit: int = 20, descending: bool = True) -> DataFrame:
    """One page of a sorted listing; the unique key breaks ties so that pages never overlap."""
    first = F.desc(sort_by) if descending else F.asc(sort_by)
    return df.orderBy(first, F.asc(key)).offset(skip).limit(limit)


def page_with_total(df: DataFrame, sort_by: str, key: str, skip: int = 0, limit: int = 20, descending: bool = True) -> DataFrame:
    """A page plus the size of the whole listing on every row."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return page(df, sort_by, key, skip, limit, descending).withColumn("total", total)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First k rows of every group. Spark trims each partition to k rows per group before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k_per_group(df, keys, order, 1, "_rn").drop("_rn")


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """Group sizes, largest first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *[F.asc(c) for c in columns])


def count_by_exploded(df: DataFrame, array: str, alias: str) -> DataFrame:
    """Group sizes over the elements of an array column."""
    return count_by(df.select(F.explode(array).alias(alias)), alias)


def table_inventory(tables: dict[str, DataFrame], fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Row count per table, plus how many rows of a table have a field set: ``fields[name] = (table, column)``."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("name"), "count")
        out = part if out is None else out.unionByName(part)
    for name, (table, column) in (fields or {}).items():
        out = out.unionByName(tables[table].agg(F.count(column).alias("count")).select(F.lit(name).alias("name"), "count"))
    return out


def enrich(df: DataFrame, dimension: DataFrame, on: str, attributes: Sequence[str], default: str = "") -> DataFrame:
    """Left join of dimension attributes; a missing value becomes the default."""
    joined = df.join(dimension.select(on, *attributes), on, "left")
    types = dict(joined.dtypes)
    for a in attributes:
        if types[a] == "string":
            joined = joined.withColumn(a, F.coalesce(F.col(a), F.lit(default)))
    return joined
