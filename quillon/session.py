"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Adaptive execution is what splits skewed join partitions and picks broadcast joins
    from measured sizes; it is on by default in Spark and stated here because the plans
    rely on it. Shuffle partition counts are left to the cluster unless passed in.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@functools.lru_cache(maxsize=1)
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="quillon-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name for an intermediate table, under the cluster's shared folder.

    The base is ``spark.checkpoint.dir``. Only a local session, where driver and tasks are
    one process, may fall back to a temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_base()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a written table in the shared folder.

    For a frame that several branches of a plan read: it is computed once, and a lost executor
    costs a re-read instead of a re-computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def open_writers(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, a task that writes folders by a column keeps up to ``most`` files open and does not sort its rows by the column first.

    Rows of prompt records are wide, so that sort is what a task's memory goes to. A task that meets more folders than that sorts the rest.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread_input(scan: DataFrame) -> DataFrame:
    """A file scan with at least one partition per core.

    Scoring costs far more per row than moving the row. A small input, or one of few large
    row groups, would leave most cores idle, so its rows are dealt out; a scan that has enough
    splits, as any large table has, is returned as it is. Only for scans: counting their
    partitions runs nothing.
    """
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
