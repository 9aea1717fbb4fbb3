"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}

_local_scratch: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on (UTC, AQE)."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """One runtime setting changed for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def build(app: str = "msgpulse", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    # Recording the Python call site of every column expression doubles the time it
    # takes to state a query.
    builder = SparkSession.builder.appName(app).config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets a
    temporary folder. A cluster session without it is an error, because a
    folder on one machine is lost to (and with) the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    key = context.applicationId
    if key not in _local_scratch:
        _local_scratch[key] = tempfile.mkdtemp(prefix="msgpulse-")
    return _local_scratch[key]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, never deleted here."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def local_form(path: str) -> str:
    """A ``file:`` URI as a plain path; other schemes have no local form."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: single-file stores need a mounted path")
    return os.path.abspath(path)


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write a small derived relation once and read it back.

    This cuts lineage and, more to the point, gives the optimizer exact file
    sizes: a following join is broadcast only if the table really is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
