"""Splitting by database, balanced by source.

The unit is the group (database), the stratum is the source. The order within a source is
the MD5 of seed and group name, which is random enough and the same on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import BROADCAST_BYTES, lookup_join
from quillon.session import stored

RANK_DIGITS = 3


def group_frame(
    rows: DataFrame, group: str = "db_id", source: str = "source", order: str | Column | None = None
) -> DataFrame:
    """One row per group: its source (the first by ``order``, else by name) and its rows."""
    first = F.min(source) if order is None else F.min_by(source, order)
    return rows.groupBy(group).agg(first.alias(source), F.count(F.lit(1)).alias("rows_of_key"))


def rank_in_source(
    groups: DataFrame, seed: int, group: str = "db_id", source: str = "source",
    per_source: DataFrame | None = None,
) -> DataFrame:
    """Groups with ``position`` (from 1) in their source, in MD5 order.

    A source may hold any number of groups, so no task sees a whole source: groups are ranked
    within a bucket of leading MD5 digits, and buckets are placed by the sizes of the buckets
    before them. Buckets are uniform, and there are ``16 ** RANK_DIGITS`` per source. Columns of
    ``per_source`` come along on the way from the buckets to the groups, so that nothing is
    ever shuffled by source alone.
    """
    keyed = groups.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group)))).withColumn(
        "_bucket", F.left("_hash", F.lit(RANK_DIGITS))
    )
    before = Window.partitionBy(source).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(source, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if per_source is not None:
        offsets = offsets.join(per_source, source)
    inside = Window.partitionBy(source, "_bucket").orderBy("_hash", group)
    return (
        keyed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [source, "_bucket"])
        .withColumn("position", F.col("_rank") + F.col("_offset"))
        .drop("_rank", "_offset", "_hash", "_bucket")
    )


def source_quotas(
    groups: DataFrame, sample_size: int, train_ratio: float, val_ratio: float, source: str = "source",
    cap_val: bool = False, allocate: str = "even",
) -> DataFrame:
    """Per source: groups taken, and the positions at which train and val end.

    ``allocate="even"`` gives each source ``total // sources`` groups and the first
    ``total % sources`` sources by name one more, so with unequal sources some of a larger
    one are left out even for ``sample_size=-1``; ``"all"`` takes every group.
    """
    sizes = groups.groupBy(source).agg(F.count(F.lit(1)).alias("available"))
    # One row per source label from here on.
    everything = Window.partitionBy()
    n_sources, total = F.count(F.lit(1)).over(everything), F.sum("available").over(everything)
    place = F.row_number().over(Window.orderBy(source))
    wanted = total if sample_size == -1 else F.lit(sample_size)
    quota = F.floor(wanted / n_sources) + F.when(place <= wanted % n_sources, 1).otherwise(0)
    taken = F.col("available") if allocate == "all" else F.least(quota, F.col("available"))
    sized = sizes.select(source, taken.cast("long").alias("taken"))
    n_train = F.greatest(F.lit(1), F.floor(F.col("taken") * F.lit(float(train_ratio))))
    plain_val = F.floor(F.col("taken") * F.lit(float(val_ratio)))
    if cap_val:
        plain_val = F.least(plain_val, F.col("taken") - n_train)
    n_val = F.greatest(F.lit(1), plain_val)
    return sized.select(
        source, "taken", n_train.alias("train_end"), (n_train + n_val).alias("val_end")
    )


def split_map(
    groups: DataFrame, sample_size: int, train_ratio: float = 0.7, val_ratio: float = 0.15, seed: int = 42,
    group: str = "db_id", source: str = "source", cap_val: bool = False, allocate: str = "even",
) -> DataFrame:
    """``group, split`` (and the group's rows) for each group taken into a split."""
    if sample_size < -1:
        raise ValueError("sample_size is a number of groups, or -1 for all")
    quotas = source_quotas(groups, sample_size, train_ratio, val_ratio, source, cap_val, allocate)
    ranked = rank_in_source(groups, seed, group, source, per_source=quotas)
    placed = ranked.where(F.col("position") <= F.col("taken"))
    label = (
        F.when(F.col("position") <= F.col("train_end"), "train")
        .when(F.col("position") <= F.col("val_end"), "val")
        .otherwise("test")
    )
    return placed.select(group, "rows_of_key", label.alias("split"))


def stratified_split(
    rows: DataFrame, sample_size: int, train_ratio: float = 0.7, val_ratio: float = 0.15, seed: int = 42,
    group: str = "db_id", source: str = "source", order: str | Column | None = None, cap_val: bool = False,
    allocate: str = "even",
) -> DataFrame:
    """The rows of the sampled groups, with a ``split`` column: train, val or test.

    A group is in one split as a whole. Rows of groups not sampled are dropped. The rows are
    read twice: once for the table of groups, which is stored because quotas, ranks and hot
    groups all come from it, and once to be labelled. The labels are stored as well, so that
    measuring them does not rank the groups a second time.
    """
    groups = stored(group_frame(rows, group, source, order), "groups")
    chosen = split_map(groups, sample_size, train_ratio, val_ratio, seed, group, source, cap_val, allocate)
    return attach_split(rows, stored(chosen, "labels"), group, weights=groups)


def attach_split(
    rows: DataFrame, chosen: DataFrame, group: str = "db_id", weights: DataFrame | None = None, limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows joined to their group's split, without a whole hot group in one task.

    Labels of measured size up to ``limit`` are broadcast and the rows stay where they are. Beyond
    that, rows of groups that were not taken are left out where they are read, by a bitmap of those that were, and ``weights`` (``group, rows_of_key`` of all groups, so that hot ones that were not
    taken are spread too) say which groups to spread; without it the rows are counted.
    """
    weights = weights.select(group, "rows_of_key") if weights is not None else None
    return lookup_join(rows, chosen.select(group, "split"), group, limit=limit, weights=weights, selective=True)


def split_profile(split_rows: DataFrame, group: str = "db_id", source: str = "source") -> DataFrame:
    """Groups and rows per split and source."""
    per_group = split_rows.groupBy("split", source, group).agg(F.count(F.lit(1)).alias("_n"))
    return per_group.groupBy("split", source).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows")
    )


def split_overlap(split_rows: DataFrame, group: str = "db_id") -> DataFrame:
    """Groups found in more than one split; an empty answer is a clean split."""
    pairs = split_rows.select(group, "split").distinct()
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("splits")).where("splits > 1")


def missing_from_train(split_rows: DataFrame, source: str = "source") -> DataFrame:
    """Sources without a row in train; an empty answer is a balanced split."""
    in_train = F.count_if(F.col("split") == "train")
    return split_rows.groupBy(source).agg(in_train.alias("train_rows")).where("train_rows = 0")


def quick_sample(split_rows: DataFrame, order: list[str], n_train: int = 10, n_val: int = 5) -> DataFrame:
    """The first rows of train and val for a quick run, by an explicit order."""
    parts = [
        split_rows.where(F.col("split") == name).orderBy(*order).limit(n)
        for name, n in (("train", n_train), ("val", n_val))
    ]
    return parts[0].unionByName(parts[1])
