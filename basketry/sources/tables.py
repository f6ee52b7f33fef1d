"""Reading, writing and changing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

#: Nested basket document.
BASKET_SCHEMA = T.StructType([
    T.StructField("basket_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("dynasty", T.StringType()),
    T.StructField("frequency", T.DoubleType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("dosage", T.StringType()),
        T.StructField("preparation", T.StringType()),
    ]))),
    T.StructField("indications", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
])

ITEM_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("nature", T.StringType()),
    T.StructField("flavor", T.ArrayType(T.StringType())),
    T.StructField("meridians", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
])

LABEL_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("symptoms", T.ArrayType(T.StringType())),
])

TARGETS_SCHEMA = T.StructType([
    T.StructField("item", T.StringType()),
    T.StructField("targets", T.ArrayType(T.StructType([
        T.StructField("target", T.StringType()),
        T.StructField("affinity", T.DoubleType()),
        T.StructField("effect_type", T.StringType()),
    ]))),
])

TRIAL_SCHEMA = T.StructType([
    T.StructField("trial_id", T.StringType()),
    T.StructField("indication", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("arms", T.ArrayType(T.StructType([
        T.StructField("treatment_name", T.StringType()),
        T.StructField("treatment_type", T.StringType()),
        T.StructField("sample_size", T.IntegerType()),
        T.StructField("mean_efficacy", T.DoubleType()),
        T.StructField("std_efficacy", T.DoubleType()),
        T.StructField("adverse_event_rate", T.DoubleType()),
    ]))),
])


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a table. Text formats need an explicit schema (nothing is inferred from data)."""
    if schema is None and fmt not in ("parquet", "orc"):
        raise ValueError(f"reading {fmt} needs a schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write nodes, edges and their totals as JSON lines under ``path``."""
    write_table(nodes, f"{path}/nodes", "json")
    write_table(edges, f"{path}/edges", "json")
    totals = (nodes.agg(F.count(F.lit(1)).alias("total")).select(F.lit("nodes").alias("kind"), "total")
              .unionByName(edges.agg(F.count(F.lit(1)).alias("total")).select(F.lit("edges").alias("kind"), "total")))
    write_table(totals, f"{path}/totals", "json")


def basket_items_from_documents(docs: DataFrame) -> DataFrame:
    """Long form ``basket_id, item, dosage`` of nested basket documents."""
    return docs.select("basket_id", F.explode("items").alias("_s")).select(
        "basket_id", F.col("_s.name").alias("item"), F.col("_s.dosage").alias("dosage"))


def transactions(docs: DataFrame) -> DataFrame:
    """Nested documents as ``basket_id, items ARRAY<STRING>`` without duplicates. No shuffle."""
    return docs.select("basket_id", F.array_distinct(F.transform("items", lambda s: s["name"])).alias("items"))


def with_label(basket_items: DataFrame, basket_labels: DataFrame, label: str) -> DataFrame:
    """Rows of the baskets that carry the label (``basket_labels(basket_id, label)``)."""
    chosen = basket_labels.filter(F.col("label") == label).select("basket_id")
    return basket_items.join(chosen, "basket_id", "left_semi")


def documents_with_label(docs: DataFrame, label: str) -> DataFrame:
    return docs.filter(F.array_contains("indications", label))


def insert_unique(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Append rows whose key is new: (table after the insert, rejected rows with a reason).

    Of several new rows with one key the first by ``order`` is taken (all columns when not given).
    """
    cols = [F.col(c) for c in (order or new.columns)]
    rn = new.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*cols)))
    checked = rn.join(existing.select(F.col(key), F.lit(True).alias("_old")).distinct(), key, "left")
    accepted = checked.filter(F.col("_old").isNull() & (F.col("_rn") == 1)).select(*new.columns)
    rejected = checked.filter(F.col("_old").isNotNull() | (F.col("_rn") > 1)).select(
        *new.columns, F.when(F.col("_old").isNotNull(), "exists").otherwise("duplicate").alias("reason"))
    return existing.unionByName(accepted, allowMissingColumns=True), rejected


def upsert(existing: DataFrame, changes: DataFrame, key: str, insert: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """Replace the fields that a change sets (non-null) on rows with its key; unknown keys are inserted or ignored.

    Of several changes with one key the last by ``order`` counts (by all columns when not given, so the result does not hang on
    the order of rows).
    """
    fields = [x for x in changes.columns if x != key]
    last = F.max_by(F.struct(*fields), F.struct(*(order or fields))) if fields else F.first(F.lit(None))
    one = changes.groupBy(key).agg(last.alias("_new"))
    joined = existing.join(one, key, "full_outer" if insert else "left")
    return joined.select(*[F.coalesce(F.col("_new").getField(x), F.col(x)).alias(x) if x in fields else F.col(x) for x in existing.columns])


def delete_by_key(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")
