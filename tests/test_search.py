import re
from collections import Counter

from basketry.operators import rows as R


def test_many_searches_equal_single_ones(spark):
    texts = ["red ring red", "blue ring", "red, RED; ring!", None, "", "über ring", "rings redder", "blue blue blue ring"]
    docs = spark.createDataFrame([(k, t, ["blue", "ring"] if k % 3 == 0 else None, k % 4) for k, t in enumerate(texts)], "id int, text string, tags array<string>, size int")
    queries = {"a": "red ring", "b": "ring ring", "c": "nothing", "d": "", "e": "BLUE über"}
    table = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    got = Counter((r.query_id, r.id, r.score, r["rank"]) for r in R.search_many(docs, table, {"text": 2, "tags": 0.5}, "id", "size", 3).collect())
    want = Counter()
    for q, s in queries.items():
        if re.findall(r"\w+", s):
            single = R.text_search(docs, s, {"text": 2, "tags": 0.5}, "id", "size").limit(3).collect()
            want.update((q, r.id, r.score, k) for k, r in enumerate(single, 1))
    assert got == want and len(got) >= 8
    assert R.search_many(docs, table.limit(0), {"text": 1}, "id", "size").count() == 0
