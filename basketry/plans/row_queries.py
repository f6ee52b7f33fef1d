"""Scans, writes, filters, search, counts, paging and top-k over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as K
from ..operators import rows as R
from ..sources import tables as S
from . import bindings as Bd
from .catalog import Tables, query, with_ctes

WORDS = "string_split(p_name, ' ')"


@query("basket_transactions", with_ctes(Bd.BI, body=(
    "SELECT basket_id, count(*) AS n_items, min(item) AS first_item, max(item) AS last_item FROM bi GROUP BY basket_id")))
def basket_transactions(t: Tables) -> DataFrame:
    return Bd.basket_items(t).distinct().groupBy("basket_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("item").alias("first_item"), F.max("item").alias("last_item"))


@query("label_transactions", with_ctes(Bd.BI, Bd.BASKETS, body=(
    "SELECT bi.basket_id, bi.item FROM bi JOIN baskets USING (basket_id) WHERE label = '1-URGENT'")))
def label_transactions(t: Tables) -> DataFrame:
    return S.with_label(Bd.basket_items(t), Bd.basket_labels(t), "1-URGENT").distinct()


@query("insert_unique_parts", (
    "WITH old AS (SELECT p_name AS name, max(p_size) AS size FROM part WHERE p_type <> 'PROMO' GROUP BY p_name), "
    "new AS (SELECT p_name || CASE WHEN p_size > 40 THEN ' xl' ELSE '' END AS name, min(p_size) AS size FROM part WHERE p_type = 'PROMO' GROUP BY 1) "
    "SELECT * FROM old UNION ALL SELECT * FROM new WHERE name NOT IN (SELECT name FROM old)"))
def insert_unique_parts(t: Tables) -> DataFrame:
    old = t.part.filter("p_type <> 'PROMO'").groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias("size"))
    new = t.part.filter("p_type = 'PROMO'").select(
        F.concat("p_name", F.when(F.col("p_size") > 40, " xl").otherwise("")).alias("name"), F.col("p_size").alias("size"))
    return S.insert_unique(old, new, "name", ["size"])[0]


@query("insert_unique_rejected", (
    "WITH old AS (SELECT DISTINCT p_name AS name FROM part WHERE p_type <> 'PROMO'), "
    "new AS (SELECT p_partkey, p_name || CASE WHEN p_size > 40 THEN ' xl' ELSE '' END AS name FROM part WHERE p_type = 'PROMO'), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS rn, name IN (SELECT name FROM old) AS known FROM new) "
    "SELECT p_partkey, name, CASE WHEN known THEN 'exists' ELSE 'duplicate' END AS reason FROM r WHERE known OR rn > 1"))
def insert_unique_rejected(t: Tables) -> DataFrame:
    old = t.part.filter("p_type <> 'PROMO'").select(F.col("p_name").alias("name")).distinct()
    new = t.part.filter("p_type = 'PROMO'").select(
        "p_partkey", F.concat("p_name", F.when(F.col("p_size") > 40, " xl").otherwise("")).alias("name"))
    return S.insert_unique(old, new, "name", ["p_partkey"])[1]


@query("upsert_suppliers", (
    "WITH ch AS (SELECT c_custkey AS s_suppkey, 'renamed ' || c_name AS s_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS s_acctbal "
    "FROM customer WHERE c_nationkey = 3) "
    "SELECT coalesce(s.s_suppkey, ch.s_suppkey) AS s_suppkey, coalesce(ch.s_name, s.s_name) AS s_name, s.s_nationkey, "
    "coalesce(ch.s_acctbal, s.s_acctbal) AS s_acctbal FROM supplier s FULL JOIN ch ON s.s_suppkey = ch.s_suppkey"))
def upsert_suppliers(t: Tables) -> DataFrame:
    changes = t.customer.filter("c_nationkey = 3").select(
        F.col("c_custkey").alias("s_suppkey"), F.concat(F.lit("renamed "), "c_name").alias("s_name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("s_acctbal"))
    return S.upsert(t.supplier, changes, "s_suppkey")


@query("delete_orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def delete_orders(t: Tables) -> DataFrame:
    gone = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return S.delete_by_key(t.orders, gone, "o_custkey").select("o_orderkey", "o_totalprice")


@query("filter_equality", "SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#12'")
def filter_equality(t: Tables) -> DataFrame:
    return R.filter_rows(t.part, p_type="PROMO", p_brand="Brand#12", p_name=None).select("p_partkey", "p_name")


@query("array_membership", f"SELECT p_partkey FROM part WHERE list_contains({WORDS}, 'ring')")
def array_membership(t: Tables) -> DataFrame:
    words = t.part.select("p_partkey", F.split("p_name", " ").alias("words"))
    return words.filter(R.has_member("words", "ring")).select("p_partkey")


@query("struct_array_membership", f"SELECT p_partkey, p_name FROM part WHERE list_contains({WORDS}, 'small')")
def struct_array_membership(t: Tables) -> DataFrame:
    docs = t.part.select("p_partkey", "p_name", F.transform(
        F.split("p_name", " "), lambda w: F.struct(w.alias("name"), F.length(w).alias("dosage"))).alias("items"))
    return docs.filter(R.has_struct_member("items", "name", "small")).select("p_partkey", "p_name")


@query("search_items_all", with_ctes(Bd.BRANDS, body=(
    "SELECT basket_id, count(DISTINCT item) AS matched FROM bi WHERE item IN ('Brand#1', 'Brand#2') GROUP BY basket_id HAVING count(DISTINCT item) = 2")))
def search_items_all(t: Tables) -> DataFrame:
    return R.search_by_items(Bd.basket_brands(t), ["Brand#1", "Brand#2"], match_all=True)


@query("search_items_any", with_ctes(Bd.BRANDS, body=(
    "SELECT basket_id, count(DISTINCT item) AS matched FROM bi WHERE item IN ('Brand#1', 'Brand#2') GROUP BY basket_id")))
def search_items_any(t: Tables) -> DataFrame:
    return R.search_by_items(Bd.basket_brands(t), ["Brand#1", "Brand#2"], match_all=False)


@query("search_array_all", f"SELECT p_partkey FROM part WHERE list_has_all({WORDS}, ['red', 'ring'])")
def search_array_all(t: Tables) -> DataFrame:
    return R.search_array_items(t.part.withColumn("words", F.split("p_name", " ")), "words", ["red", "ring"]).select("p_partkey")


@query("search_array_any", f"SELECT p_partkey FROM part WHERE list_has_any({WORDS}, ['red', 'ring'])")
def search_array_any(t: Tables) -> DataFrame:
    return R.search_array_items(t.part.withColumn("words", F.split("p_name", " ")), "words", ["red", "ring"], match_all=False).select("p_partkey")


@query("regex_search", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '(?i)CUSTOMER#0+[1-4]7')")
def regex_search(t: Tables) -> DataFrame:
    return t.customer.filter(R.name_matches("c_name", "CUSTOMER#0+[1-4]7")).select("c_custkey", "c_name")


@query("text_search", (
    "WITH w AS (SELECT p_partkey, p_size, "
    "len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x IN ('ring', 'small', 'promo'))) AS a, "
    "len(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x IN ('ring', 'small', 'promo'))) AS b, "
    "len(list_filter(regexp_split_to_array(lower(p_brand), '[^a-z0-9]+'), lambda x: x IN ('ring', 'small', 'promo'))) AS c FROM part) "
    "SELECT p_partkey, CAST(10 * a + 5 * b + c AS DOUBLE) AS score FROM w WHERE a + b + c > 0 ORDER BY score DESC, p_size DESC, p_partkey LIMIT 50"))
def text_search(t: Tables) -> DataFrame:
    out = R.text_search(t.part, "small Ring promo", {"p_name": 10, "p_type": 5, "p_brand": 1}, "p_partkey", "p_size")
    return out.limit(50).select("p_partkey", "score")


@query("document_search", (
    "WITH w AS (SELECT doc_id, n_chars, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x IN ('the', 'les', 'und'))) AS hits FROM documents) "
    "SELECT doc_id, CAST(2 * hits AS DOUBLE) AS score FROM w WHERE hits > 0"))
def document_search(t: Tables) -> DataFrame:
    return R.text_search(t.documents, "the les und", {"text": 2}, "doc_id", "n_chars").select("doc_id", "score")


@query("search_many", (
    "WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM benchmark), "
    "p AS (SELECT doc_id, n_chars, token, count(*) AS c FROM (SELECT doc_id, n_chars, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents) WHERE token IN (SELECT token FROM q) GROUP BY ALL), "
    "s AS (SELECT query_id, doc_id, n_chars, CAST(2 * sum(c) AS DOUBLE) AS score FROM p JOIN q ON q.token = p.token GROUP BY ALL) "
    "SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_chars DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20"))
def search_many(t: Tables) -> DataFrame:
    """The first three words of every benchmark item, each as a search string of its own."""
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"))
    return R.search_many(t.documents, queries, {"text": 2}, "doc_id", "n_chars", 20)


@query("lookup_by_key", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def lookup_by_key(t: Tables) -> DataFrame:
    return R.lookup(t.orders, "o_orderkey", 77).select("o_orderkey", "o_totalprice")


@query("lookup_not_found", "SELECT o_orderkey FROM orders WHERE o_orderkey = -1")
def lookup_not_found(t: Tables) -> DataFrame:
    return R.lookup(t.orders, "o_orderkey", -1).select("o_orderkey")


@query("count_filtered", "SELECT count(*) AS total FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'")
def count_filtered(t: Tables) -> DataFrame:
    return R.count_rows(t.orders, o_orderpriority="5-LOW", o_orderstatus="F")


def _top_baskets(body: str) -> str:
    return with_ctes(Bd.BRANDS, Bd.BASKETS, ("hit", "SELECT basket_id, count(DISTINCT item) AS n FROM bi WHERE item IN ('Brand#3', 'Brand#7') GROUP BY basket_id"),
                     body="SELECT b.basket_id, b.frequency FROM baskets b JOIN hit USING (basket_id) " + body + " ORDER BY b.frequency DESC, b.basket_id LIMIT 10")


@query("baskets_with_both_items", _top_baskets("WHERE n = 2"))
def baskets_with_both_items(t: Tables) -> DataFrame:
    hit = R.search_by_items(Bd.basket_brands(t), ["Brand#3", "Brand#7"]).select("basket_id")
    return R.page(Bd.baskets(t).join(hit, "basket_id", "left_semi"), "frequency", "basket_id", 0, 10).select("basket_id", "frequency")


@query("baskets_with_either_item", _top_baskets(""))
def baskets_with_either_item(t: Tables) -> DataFrame:
    hit = R.search_by_items(Bd.basket_brands(t), ["Brand#3", "Brand#7"], match_all=False).select("basket_id")
    return R.page(Bd.baskets(t).join(hit, "basket_id", "left_semi"), "frequency", "basket_id", 0, 10).select("basket_id", "frequency")


@query("item_baskets_page", with_ctes(Bd.BI, Bd.BASKETS, ("mine", "SELECT baskets.* FROM baskets JOIN bi USING (basket_id) WHERE item = 'red ring'"), body=(
    "SELECT basket_id, frequency, (SELECT count(*) FROM mine) AS total FROM mine ORDER BY frequency DESC, basket_id LIMIT 20 OFFSET 20")))
def item_baskets_page(t: Tables) -> DataFrame:
    mine = Bd.basket_items(t).filter(F.col("item") == "red ring").select("basket_id")
    rows = Bd.baskets(t).join(mine, "basket_id", "left_semi").select("basket_id", "frequency")
    return R.page_with_total(rows, "frequency", "basket_id", 20, 20)


@query("label_baskets_page", "SELECT o_orderkey AS basket_id, o_totalprice AS frequency FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 30")
def label_baskets_page(t: Tables) -> DataFrame:
    return R.page(R.filter_rows(Bd.baskets(t), label="2-HIGH"), "frequency", "basket_id", 30, 15, descending=False).select("basket_id", "frequency")


@query("item_target_list", with_ctes(Bd.ITEMS, Bd.TARGETS, body=(
    "SELECT items.name AS item, count(target) AS n_targets, round(coalesce(max(affinity), 0), 6) AS best_affinity "
    "FROM items LEFT JOIN targets ON items.name = targets.item AND targets.affinity > 1 GROUP BY items.name")))
def item_target_list(t: Tables) -> DataFrame:
    strong = Bd.item_targets(t).filter("affinity > 1")
    return Bd.items(t).select(F.col("name").alias("item")).join(strong, "item", "left").groupBy("item").agg(
        F.count("target").alias("n_targets"), F.round(F.coalesce(F.max("affinity"), F.lit(0.0)), 6).alias("best_affinity"))


@query("dimension_enrichment", (
    "SELECT c_custkey, coalesce(s_name, '') AS s_name, coalesce(n_name, '') AS n_name FROM customer "
    "LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey"))
def dimension_enrichment(t: Tables) -> DataFrame:
    suppliers = t.supplier.withColumnRenamed("s_suppkey", "c_custkey")
    nations = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    out = R.enrich(R.enrich(t.customer, suppliers, "c_custkey", ["s_name"]), nations, "c_nationkey", ["n_name"])
    return out.select("c_custkey", "s_name", "n_name")


@query("count_by_category", "SELECT p_type, count(*) AS count FROM part GROUP BY p_type")
def count_by_category(t: Tables) -> DataFrame:
    return R.count_by(t.part, "p_type")


@query("count_by_exploded", "SELECT word, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def count_by_exploded(t: Tables) -> DataFrame:
    return R.count_by_exploded(t.part.withColumn("words", F.split("p_name", " ")), "words", "word")


@query("items_per_target", with_ctes(Bd.TARGETS, body="SELECT target, count(*) AS count FROM targets GROUP BY target"))
def items_per_target(t: Tables) -> DataFrame:
    return R.count_by(Bd.item_targets(t), "target")


@query("global_sum", "SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def global_sum(t: Tables) -> DataFrame:
    return t.orders.agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("table_inventory", (
    "SELECT 'orders' AS name, count(*) AS count FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL "
    "SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'labelled', count(quality) FROM documents LEFT JOIN labels USING (doc_id)"))
def table_inventory(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return R.table_inventory({"orders": t.orders, "parts": t.part, "documents": t.documents}).unionByName(
        docs.agg(F.count("quality").alias("count")).select(F.lit("labelled").alias("name"), "count"))


@query("page_orders", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_orders(t: Tables) -> DataFrame:
    return R.page_with_total(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50, 25)


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def top_orders(t: Tables) -> DataFrame:
    return R.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 30)


@query("top_orders_per_label", (
    "SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank "
    "FROM orders QUALIFY rank <= 10"))
def top_orders_per_label(t: Tables) -> DataFrame:
    return R.top_k_per_group(t.orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10).select("o_orderkey", "o_orderpriority", "rank")


@query("first_order_per_customer", (
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"))
def first_order_per_customer(t: Tables) -> DataFrame:
    return R.first_per_key(t.orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("set_algebra", (
    "SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ' ') AS both_sets, "
    "array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS any_set, "
    "array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS only_first "
    "FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, [lower(p_type), 'ring', 'red'] AS b FROM part)"))
def set_algebra(t: Tables) -> DataFrame:
    a, b = F.split("p_name", " "), F.array(F.lower("p_type"), F.lit("ring"), F.lit("red"))
    return t.part.select(
        "p_partkey", F.array_join(F.sort_array(F.array_intersect(a, b)), " ").alias("both_sets"),
        F.array_join(F.sort_array(F.array_union(a, b)), " ").alias("any_set"),
        F.array_join(F.sort_array(F.array_except(a, b)), " ").alias("only_first"))


@query("parse_dose", (
    "SELECT c_custkey, try_cast(regexp_replace(c_name, '[^0-9.]', '', 'g') AS DOUBLE) AS dose, "
    "try_cast(regexp_replace(c_mktsegment, '[^0-9.]', '', 'g') AS DOUBLE) AS no_dose FROM customer"))
def parse_dose(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", K.parse_dose("c_name").alias("dose"), K.parse_dose("c_mktsegment").alias("no_dose"))


_CDF = ("(CASE WHEN {x} >= 0 THEN 0.5 * (1 + {e}) ELSE 0.5 * (1 - {e}) END)")


def sql_normal_cdf(x: str) -> str:
    """The same polynomial as ``scalars.normal_cdf``, as DuckDB SQL over a column or expression."""
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {z}))"
    poly = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    e = f"(1.0 - {poly} * exp(-{z} * {z}))"
    return _CDF.format(x=x, e=e)


@query("scalar_helpers", (
    f"SELECT s_suppkey, round({sql_normal_cdf('(s_acctbal / 4000.0 - 1)')}, 6) AS cdf, "
    "greatest(0.0, least(100.0, round(s_acctbal / 50, 6))) AS clamped, "
    "CASE WHEN s_nationkey <> 0 THEN round(s_acctbal / s_nationkey, 6) ELSE 0 END AS ratio, "
    "CASE WHEN s_acctbal >= 7000 THEN 'high' WHEN s_acctbal >= 3000 THEN 'medium' ELSE 'low' END AS tier, "
    "len(list_filter(list_transform(regexp_split_to_array(s_name, '[#0]'), lambda x: trim(x)), lambda x: x <> '')) AS terms FROM supplier"))
def scalar_helpers(t: Tables) -> DataFrame:
    return t.supplier.select(
        "s_suppkey", F.round(K.normal_cdf(F.col("s_acctbal") / 4000.0 - 1), 6).alias("cdf"),
        K.clamp(F.round(F.col("s_acctbal") / 50, 6), 0, 100).alias("clamped"),
        F.round(K.safe_div("s_acctbal", "s_nationkey"), 6).alias("ratio"),
        K.tier("s_acctbal", [(7000, "high"), (3000, "medium")], "low").alias("tier"),
        F.size(K.split_terms("s_name", "#0")).cast("long").alias("terms"))


@query("message_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events")
def message_json(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "k INT")
    sent = F.to_json(F.struct(parsed["k"].alias("k"), F.col("event_type")))
    back = F.from_json(sent, "k INT, event_type STRING")
    return t.events.select("event_id", back["k"].alias("k"), back["event_type"].alias("event_type"))
