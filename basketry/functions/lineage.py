"""Cutting lineage through the shared checkpoint folder, so a lost executor never loses iteration state."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
#: Tables written by this process, by application.
_WRITTEN: dict[str, list[str]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="basketry-checkpoint-")
    return _LOCAL_DIRS[sc.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the checkpoint folder and continue from the written table.

    A written table rather than ``checkpoint()``: the plan that follows then starts from the real file sizes, so
    small state is broadcast by Spark's own size check. (A checkpointed DataFrame keeps the size *estimate* of its
    plan, which joins multiply; over the rounds of an iteration that estimate grows without bound.)
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_intermediates(spark: SparkSession) -> int:
    """Delete the tables that ``cut_lineage`` has written for this application; call it when their results are consumed."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        store, folder = fs.FileSystem.from_uri(path)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)
    return len(paths)
