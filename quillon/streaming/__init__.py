"""The same columns on streams. All of them are stateless, so no watermark is needed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.reports import flatten_metrics
from quillon.operators.scoring import score_completions
from quillon.sources.metrics_table import append_batch
from quillon.sources.splits import write_metrics


def score_stream(
    completions: DataFrame, weights: Mapping[str, float] | None = None, **options
) -> DataFrame:
    """Scores of a stream of completions; each row carries its schema."""
    return score_completions(completions, weights, **options)


def metrics_stream(log: DataFrame, logs: str = "logs") -> DataFrame:
    """``step, metric, value`` of a stream of log records."""
    return flatten_metrics(log, logs)


def append_to(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to a Parquet table, exactly once per row."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def append_metrics(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Adds each micro-batch of metric rows to a metrics table that batch jobs write, too.

    A micro-batch is named after its stream's checkpoint and its number, so one that is run
    again replaces itself. There is a folder per micro-batch; a stream that runs for long is better added by
    :func:`append_metrics_merged`.
    """
    return _each_batch(df, checkpoint, available_now, lambda rows, name: write_metrics(rows, path, name))


def append_metrics_merged(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """As :func:`append_metrics`, to a table of few folders that is read by ``metrics_table.read_metrics``."""
    return _each_batch(df, checkpoint, available_now, lambda rows, name: append_batch(rows, path, name))


def _each_batch(df: DataFrame, checkpoint: str, available_now: bool, add: Callable[[DataFrame, str], None]) -> StreamingQuery:
    stream = hashlib.md5(checkpoint.encode()).hexdigest()
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, number: add(rows, f"stream-{stream}-{number}")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
