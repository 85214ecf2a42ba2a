"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.prefilter import with_membership
from quillon.session import stored

BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Text size of a whole frame: one aggregate over it, one row back."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    return df.agg(size.alias("bytes")).first()["bytes"]


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "inner",
    limit: int = BROADCAST_BYTES, weights: DataFrame | None = None, selective: bool = False,
) -> DataFrame:
    """Join rows to a lookup table that is expected, but not trusted, to be small.

    The lookup is measured. Within ``limit`` it is broadcast, so the rows are not shuffled;
    beyond it the join is shuffled with hot keys spread, by ``weights`` as in :func:`spread_join`. A ``selective`` inner or
    semi join, which few of the rows come through, then first leaves out at the scan what has no partner, so it is not shuffled to be dropped.
    """
    if measured_bytes(lookup) <= limit:
        return rows.join(F.broadcast(lookup), on, how)
    if rows.isStreaming:
        return rows.join(lookup, on, how)
    if selective and how in ("inner", "left_semi"):
        rows = with_membership(rows, lookup, [on] if isinstance(on, str) else list(on)).where("_maybe").drop("_maybe")
    return spread_join(rows, lookup, on, how, weights=weights)


def row_digest(*columns: str) -> Column:
    """SHA-256 of the named columns, with lengths between them: only equal values, null among them, share one."""
    texts = [F.col(c).cast("string") for c in columns]
    sized = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*sized), 256)


def settled(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` under a new name, as a value that later filters cannot be pushed through.

    A filter on a derived column is pushed below its projection by writing the definition out
    once per use, which would run costly definitions, Python ones among them, over and over.
    Unfolding a list of one keeps the filter above, while filters on the columns the frame
    came with still reach the scan.
    """
    return df.select("*", F.explode(F.array(column)).alias(name)).drop(column)


def split_plan(weights: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """``keys, _parts``: the keys with more rows than a task should have, and in how many parts to take them.

    ``weights`` has the rows of each key as ``rows_of_key``. A task should have the ``tasks``-th part of all
    rows, so there are fewer than ``tasks`` keys with more than that, and all their parts together are fewer than twice as many,
    whatever the data.
    """
    total = weights.agg(F.sum("rows_of_key").alias("total"))
    parts = F.ceil(F.col("rows_of_key") * F.lit(float(tasks)) / total.scalar()).cast("int")
    return weights.select(*keys, parts.alias("_parts")).where("_parts > 1")


def spread_join(
    rows: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "inner",
    weights: DataFrame | None = None, salts: int | None = None,
) -> DataFrame:
    """Shuffled equi join in which a key with many rows is taken in parts, as many as its size asks for.

    ``salts`` (by default the session's shuffle partitions) is how many parts a key of all rows would have; see :func:`split_plan`, whose
    bounded outcome is broadcast. A row of such a key is put into a part by a hash of its columns and of its input partition: the same on a rerun of
    the task, whatever the order of rows. The lookup rows of such a key are repeated once per part. Rows with
    a null key match nothing and are spread over all parts; everything else keeps part 0.

    ``weights`` may give the rows per key (columns of ``on`` and ``rows_of_key``) if they are
    known already; otherwise they are counted, which reads the key columns only.
    """
    keys = [on] if isinstance(on, str) else list(on)
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if weights is None:
        weights = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_key"))
    plan = stored(split_plan(weights, keys, salts), "split-plan")
    unmatched = F.lit(False)
    for key in keys:
        unmatched = unmatched | F.col(key).isNull()
    hashed = [f.name for f in rows.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    place = F.xxhash64(F.spark_partition_id(), *hashed)
    parts = F.when(unmatched, F.lit(salts)).otherwise(F.coalesce("_parts", F.lit(1)))
    salted = rows.join(F.broadcast(plan), keys, "left").withColumn("_salt", F.pmod(place, parts).cast("int")).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    repeated = lookup.join(F.broadcast(plan), keys, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
