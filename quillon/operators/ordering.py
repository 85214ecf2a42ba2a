"""Sums over the rows ahead of a row in its group, without a group ever meeting in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import lookup_join
from quillon.session import stored


def running_sums(rows: DataFrame, group: str, order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` with a column per entry of ``sums``: the sum of its value over the rows of the group that come before in ``order``.

    Rows are sorted into ranges of group and order, so a large group lies in several of them. Each range adds up its own rows, and what the
    ranges before hold of a group, a row per group and range, is added. ``group`` must not be null; rows that tie in ``order`` should be equal.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"_v_{name}": value for name, value in sums.items()})
    ranged = valued.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    totals = ranged.groupBy(group, "_part").agg(*[F.sum(f"_v_{name}").alias(f"_v_{name}") for name in sums])
    ahead = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name, window: F.coalesce(F.sum(f"_v_{name}").over(window), F.lit(0))
    starts = totals.select(group, "_part", *[before(name, ahead).alias(f"_s_{name}") for name in sums])
    placed = lookup_join(ranged, stored(starts, "starts"), [group, "_part"])
    placed = placed.withColumns({name: F.col(f"_s_{name}") + before(name, inside) for name in sums})
    return placed.drop("_part", *[f"_v_{name}" for name in sums], *[f"_s_{name}" for name in sums])
