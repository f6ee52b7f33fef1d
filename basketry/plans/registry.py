"""All registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import catalog
from . import row_queries  # noqa: F401
from . import basket_queries  # noqa: F401
from . import graph_queries  # noqa: F401
from . import text_queries  # noqa: F401
from . import evidence_queries  # noqa: F401
from . import dose_queries  # noqa: F401
from . import risk_queries  # noqa: F401
from . import stream_queries  # noqa: F401


def _run(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(catalog.Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, f) for name, f in catalog.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
