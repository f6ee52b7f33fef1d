"""A sample of the registered queries against their oracle SQL on the smallest tables (all of them with CHECK_ALL=1)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["pair_stats", "association_rules", "subgraph_from_item", "links_with_targets", "detected_risk_pairs", "evaluate_texts", "meta_loo", "dose_knots", "dose_observations", "stream_changed_pairs",
          "stream_task_states", "top_links_adamic_adar", "search_many", "reaction_totals", "risk_pair_details", "basket_item_reactions", "links_katz"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
