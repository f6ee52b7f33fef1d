"""Streaming jobs run to the end over the supplied tables (file source, available-now trigger)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import checkpoint_dir, cut_lineage
from ..operators import graph as G
from ..streaming import jobs as J, tasks as K
from . import bindings as Bd
from .catalog import Tables, query, with_ctes
from .text_queries import LEXICON, PATTERNS, lexicon_sql


def _source(t: Tables, table: str) -> DataFrame:
    """A table as a stream, be it a file or a folder of files; what is there at the start is one batch, so the order of its files says nothing.

    The path is a pattern because the file source takes a path without one for a folder.
    """
    return t.spark.readStream.schema(getattr(t, table).schema).parquet(f"{t.folder}/{table}.parque[t]")


def _folder(t: Tables) -> str:
    return f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def _to_table(t: Tables, stream: DataFrame) -> DataFrame:
    """Append-mode result as a written table."""
    base = _folder(t)
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def _each_batch(t: Tables, stream: DataFrame, f, mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(f).outputMode(mode).option("checkpointLocation", f"{_folder(t)}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def _last_state(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    """Batches of an aggregation written one after another; the newest row per key is the state."""
    base = _folder(t)

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/b{batch_id}")

    _each_batch(t, stream, write, mode)
    return t.spark.read.parquet(f"{base}/b*")


TASK_TYPE = "CASE role WHEN 'user' THEN 'adverse_extract' WHEN 'assistant' THEN 'batch_efficacy' ELSE role END"


def _tasks(t: Tables) -> DataFrame:
    kind = F.when(F.col("role") == "user", "adverse_extract").when(F.col("role") == "assistant", "batch_efficacy").otherwise(F.col("role"))
    return _source(t, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("task_id"), kind.alias("task_type"), F.array("text").alias("texts"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=(F.col("conv_id") % 3000).cast("decimal(18,6)"))).alias("ts"))


CONV = ("tasks", f"SELECT min(concat_ws('-', conv_id, turn)) AS doc_id, {TASK_TYPE} AS source, '' AS lang, text FROM conversations GROUP BY conv_id, turn, role, text")


@query("stream_text_mining", with_ctes(CONV, *lexicon_sql(LEXICON, "tasks"), body=(
    "SELECT ana.doc_id AS task_id, ana.source AS task_type, CASE WHEN ana.source IN ('adverse_extract', 'batch_efficacy') THEN 'completed' ELSE 'failed' END AS status, "
    "CASE WHEN ana.source = 'batch_efficacy' THEN round(s, 4) END AS sentiment_score, CASE WHEN ana.source = 'adverse_extract' THEN ("
    + " + ".join(f"CAST(regexp_matches(tasks.text, '{p}') AS BIGINT)" for p, _, _ in PATTERNS) + ") END AS reactions FROM ana JOIN tasks ON tasks.doc_id = ana.doc_id")))
def stream_text_mining(t: Tables) -> DataFrame:
    out = _to_table(t, J.stream_text_mining(_tasks(t), LEXICON, PATTERNS))
    return out.select("task_id", "task_type", "status", "sentiment_score", F.when(F.col("reactions").isNotNull(), F.size("reactions")).cast("long").alias("reactions"))


@query("stream_status", f"SELECT CASE WHEN {TASK_TYPE} IN ('adverse_extract', 'batch_efficacy') THEN 'completed' ELSE 'failed' END AS status, count(*) AS count FROM conversations GROUP BY 1")
def stream_status(t: Tables) -> DataFrame:
    state = _last_state(t, J.stream_status(_tasks(t)), "complete")
    return state.groupBy("status").agg(F.max_by("count", "batch").alias("count"))


#: Conversations as tasks of all their turns. A fifth of them is not answered yet, another fifth for the first turn only.
CONV_KIND = "CASE conv_id % 4 WHEN 0 THEN 'batch_adverse' WHEN 1 THEN 'batch_efficacy' WHEN 2 THEN 'efficacy_analyze' ELSE 'guess' END"
CONV_TEXTS = [
    ("turns", f"SELECT conv_id, {CONV_KIND} AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i, text FROM conversations"),
    ("tasks", "SELECT conv_id || '-' || i AS doc_id, kind AS source, '' AS lang, text FROM turns"),
]


def _conversation_tasks(t: Tables) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t.conversations.groupBy("conv_id").agg(turns.alias("texts")).select(
        "conv_id", F.col("conv_id").cast("string").alias("task_id"), F.expr(CONV_KIND).alias("task_type"), "texts", F.timestamp_seconds("conv_id").alias("ts"))


def _run_tasks(t: Tables) -> str:
    """Three files of events, each run from the checkpoint of the one before; a task's rows come in any of them."""
    base = _folder(t)
    tasks = _conversation_tasks(t)
    answers = K.answers(tasks, LEXICON, PATTERNS).filter("task_id % 5 > 1 or (task_id % 5 = 1 and text_index = 0)")
    events = cut_lineage(K.submissions(tasks).unionByName(answers).withColumn("_file", F.pmod(F.col("task_id").cast("long") + F.coalesce("text_index", F.lit(1)), F.lit(3))))
    for k in range(3):
        events.filter(F.col("_file") == k).drop("_file").coalesce(4).write.mode("append").parquet(f"{base}/in")
        states = K.task_states(t.spark.readStream.schema(K.EVENTS).parquet(f"{base}/in"))
        with K.settings(t.spark):
            states.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/state"


REACTIONS_SQL = " + ".join(f"CAST(regexp_matches(turns.text, '{p}') AS BIGINT)" for p, _, _ in PATTERNS)


@query("stream_task_states", with_ctes(*CONV_TEXTS, *lexicon_sql(LEXICON, "tasks"), (
    "parts", f"SELECT turns.conv_id, turns.kind, turns.kind <> 'guess' AND (conv_id % 5 > 1 OR (conv_id % 5 = 1 AND i = 0)) AS done, CASE WHEN kind IN ('batch_efficacy', 'efficacy_analyze') THEN round(s, 4) END AS s, "
             f"CASE WHEN kind = 'batch_adverse' THEN {REACTIONS_SQL} END AS r FROM turns JOIN ana ON ana.doc_id = conv_id || '-' || i"), body=(
    "SELECT CAST(conv_id AS VARCHAR) AS task_id, CASE WHEN kind = 'guess' THEN 'failed' WHEN count(*) FILTER (done) = count(*) THEN 'completed' WHEN count(*) FILTER (done) > 0 THEN 'processing' ELSE 'pending' END AS status, "
    "CAST(count(*) AS INTEGER) AS n_texts, CAST(count(*) FILTER (done) AS INTEGER) AS n_results, round(sum(s) FILTER (done), 4) AS sentiment, CAST(sum(r) FILTER (done) AS BIGINT) AS reactions FROM parts GROUP BY conv_id, kind")))
def stream_task_states(t: Tables) -> DataFrame:
    """Final states of the tasks and what their results say, by id, read from the state."""
    checkpoint = _run_tasks(t)
    results = K.task_results(t.spark, checkpoint).select(
        "task_id", F.get_json_object("result", "$.sentiment_score").cast("double").alias("s"), F.size(F.from_json(F.get_json_object("result", "$.reactions"), "array<string>")).alias("r"))
    sums = results.groupBy("task_id").agg(F.round(F.sum("s"), 4).alias("sentiment"), F.sum(F.when(F.col("r") >= 0, F.col("r"))).cast("long").alias("reactions"))
    return K.current_tasks(t.spark, checkpoint).join(sums, "task_id", "left").select("task_id", "status", "n_texts", "n_results", "sentiment", "reactions")


@query("drop_old_results", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 3600 SECOND")
def drop_old_results(t: Tables) -> DataFrame:
    results = t.events.select("event_id", F.date_trunc("second", "ts").alias("completed_at"), "ts")
    kept = J.drop_old_results(results, F.to_timestamp(F.lit("2024-01-15 12:00:00")), 3600)
    return kept.select("event_id")


WHOLE = [("b", "SELECT p_partkey AS basket_id, list_distinct(list_concat(string_split(p_name, ' '), [p_type, p_brand])) AS items, p_retailprice AS frequency FROM part"),
         ("bi", "SELECT basket_id, frequency, unnest(items) AS item FROM b")]


def _whole(df: DataFrame) -> DataFrame:
    return df.select(F.col("p_partkey").alias("basket_id"), F.concat(F.split("p_name", " "), F.array("p_type", "p_brand")).alias("items"), F.col("p_retailprice").alias("frequency"))


PAIR_SQL = ("SELECT x.item AS item_a, y.item AS item_b, count(*) AS count, round(sum(x.frequency), 2) AS weight FROM bi x JOIN bi y ON x.basket_id = y.basket_id AND x.item < y.item GROUP BY 1, 2")


@query("stream_co_occurrence", with_ctes(*WHOLE, body=PAIR_SQL))
def stream_co_occurrence(t: Tables) -> DataFrame:
    state = _last_state(t, J.stream_co_occurrence(_whole(_source(t, "part"))), "update")
    return state.groupBy("item_a", "item_b").agg(F.max_by("count", "batch").alias("count"), F.round(F.max_by("weight", "batch"), 2).alias("weight"))


CHANGES = [("ch", "SELECT CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'create' ELSE 'update' END AS action, user_id AS basket_id, "
                  "['k' || CAST(floor(value) % 7 AS BIGINT), event_type, 'h' || CAST(hour(ts) % 6 AS BIGINT)] AS items, value AS frequency, ts FROM events"),
           ("lastc", "SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY ts DESC, action DESC) = 1"),
           ("alive", "SELECT * FROM lastc WHERE action <> 'delete'")]


def _changes(df: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "create").otherwise("update")
    items = F.array(F.concat(F.lit("k"), (F.floor("value") % 7).cast("string")), F.col("event_type"), F.concat(F.lit("h"), (F.hour("ts") % 6).cast("string")))
    return df.select(action.alias("action"), F.col("user_id").alias("basket_id"), items.alias("items"), F.col("value").alias("frequency"), "ts")


def _run_changes(t: Tables) -> str:
    base = _folder(t)
    _each_batch(t, _changes(_source(t, "events")), J.basket_change_writer(t.spark, base))
    return base


@query("stream_basket_changes", with_ctes(*CHANGES, body="SELECT basket_id, array_to_string(items, ',') AS items, frequency FROM alive"))
def stream_basket_changes(t: Tables) -> DataFrame:
    base = _run_changes(t)
    return J.basket_tables(t.spark, base)[0].read().select("basket_id", F.array_join("items", ",").alias("items"), "frequency")


@query("stream_changed_pairs", with_ctes(*CHANGES, ("bi", "SELECT DISTINCT basket_id, frequency, item FROM (SELECT basket_id, frequency, unnest(items) AS item FROM alive)"), body=PAIR_SQL))
def stream_changed_pairs(t: Tables) -> DataFrame:
    base = _run_changes(t)
    return J.basket_tables(t.spark, base)[1].read().withColumn("weight", F.round("weight", 2))


@query("stream_communities")
def stream_communities(t: Tables) -> DataFrame:
    """The co-occurrence edges arrive as files of a folder; communities are kept by incremental refinement."""
    base = _folder(t)
    edges = Bd.graph_edges(t).select("src", "dst", "weight")
    edges.repartition(2, "src", "dst").write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    _each_batch(t, stream, J.community_writer(t.spark, base))
    parts = J.VersionedTable(t.spark, f"{base}/communities", J.COMMUNITY_STATE).read()
    return G.community_members(edges, parts)
