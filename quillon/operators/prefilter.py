"""Leaving rows out at the scan that a later join or dedupe cannot need, by a bitmap of the wanted keys.

A key is hashed to one bit of a field that is as large as the number of keys asks for. The field is built in one
aggregate, in slices of ``SLICE_BITS``, and its size is bounded by ``MOST_SLICES`` whatever the keys are, so broadcasting it is
safe. A row whose bit is not set has none of the keys; of the others some few have none either, so what follows must still be exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import stored

SLICE_BITS = 32768  # a bitmap of 4 KB
MOST_SLICES = 8192  # 32 MB in all
BITS_PER_KEY = 16


def _bit(keys: Sequence[Column], slices: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slices * SLICE_BITS))


def key_bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """The field over all columns of ``keys`` as ``_slice, _bits``, and its number of slices. One pass counts the keys, one sets their bits."""
    slices = max(1, min(MOST_SLICES, -(-keys.count() * BITS_PER_KEY // SLICE_BITS)))
    bit = keys.select(_bit([F.col(c) for c in keys.columns], slices).alias("_bit"))
    at = (F.col("_bit") / SLICE_BITS).cast("int")
    bits = bit.groupBy(at.alias("_slice")).agg(F.bitmap_construct_agg((F.col("_bit") % SLICE_BITS).cast("long")).alias("_bits"))
    return stored(bits, "bitmap"), slices


def with_membership(rows: DataFrame, keys: DataFrame, on: Sequence[str], name: str = "_maybe") -> DataFrame:
    """``rows`` with a flag that is true for every row whose ``on`` columns are a row of ``keys``, and for few others.

    Rows stay where they are. A null is hashed like a value, so a row with a null key is flagged if ``keys`` holds that null.
    """
    bitmap, slices = key_bitmap(keys.select(*on))
    marked = rows.withColumn("_bit", _bit([F.col(c) for c in on], slices))
    marked = marked.withColumn("_slice", (F.col("_bit") / SLICE_BITS).cast("int"))
    joined = marked.join(F.broadcast(bitmap), "_slice", "left")  # bounded by MOST_SLICES
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_bit % {SLICE_BITS} div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_bit % 8 AS int)) & 1") == 1
    return joined.withColumn("_byte", byte).withColumn(name, F.coalesce(is_set, F.lit(False))).drop("_slice", "_bits", "_bit", "_byte")
