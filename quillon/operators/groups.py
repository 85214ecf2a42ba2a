"""Statistics over the rollouts of one prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import deviation_units
from quillon.operators.joins import spread_join
from quillon.session import stored


def group_stats(rollouts: DataFrame, group: str = "prompt_id", units: str = "reward_units") -> DataFrame:
    """Per group: rows, mean and sample deviation, from whole-number sums."""
    wide = F.col(units).cast("decimal(19,0)")
    sums = rollouts.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows_of_key"),
        F.count(units).alias("_n"),
        F.sum(units).alias("_total"),
        F.sum((wide * wide).cast("decimal(38,0)")).cast("decimal(38,0)").alias("_squares"),
    )
    return sums.select(
        group,
        "rows_of_key",
        (F.col("_total").cast("double") / F.nullif("_n", F.lit(0)).cast("double")).alias("group_mean"),
        deviation_units(F.col("_n"), F.col("_total"), F.col("_squares")).alias("group_std"),
    )


def group_advantage(rollouts: DataFrame, group: str = "prompt_id", units: str = "reward_units") -> DataFrame:
    """Adds ``advantage``: distance from the group's mean in its deviations, 0 without spread
    or without a group.

    The statistics are an aggregate, joined back with hot groups spread; a window would bring
    a whole group, however large, into one task. They are stored, since the hot groups are read
    off them, too: the rollouts are read twice in all.
    """
    stats = stored(group_stats(rollouts, group, units), "group-stats")
    weights = stats.select(group, "rows_of_key")
    joined = spread_join(rollouts, stats.drop("rows_of_key"), group, "left", weights=weights)
    spread = F.coalesce(F.col("group_std"), F.lit(0.0))
    score = F.when(spread > 0, (F.col(units).cast("double") - F.col("group_mean")) / spread).otherwise(0.0)
    return joined.withColumn("advantage", score).drop("group_mean", "group_std")


def zero_variance_groups(
    rollouts: DataFrame, database: str = "db_id", group: str = "prompt_id", units: str = "reward_units"
) -> DataFrame:
    """Per database: groups, groups whose rewards are all equal, and their share."""
    ranges = rollouts.groupBy(database, group).agg(F.min(units).alias("_low"), F.max(units).alias("_high"))
    return (
        ranges.groupBy(database)
        .agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_low") == F.col("_high")).alias("flat_groups"))
        .withColumn("flat_share", F.col("flat_groups").cast("double") / F.col("groups").cast("double"))
    )
