"""Documents into shards of near equal bytes, tokens and rows, by vector bin packing.

What is placed is a group: all documents with equal texts, so that copies meet in one shard. A group
is a vector of bytes, tokens and rows, in shares of the corpus. The largest are placed first, each in the shard
where the dot product of its vector with what the shard has left of each is highest: a group that is
long on tokens goes where tokens are short.

A group that fits into a shard is placed as one. Only one that is larger than a shard in bytes, tokens or rows
is cut, into pieces of at most ``PIECE`` of a shard each by a hash of the id, so that the shards can still be filled evenly.

Placing is sequential, so it must not grow with the corpus. Groups are bundled by a hash of the text into
``BUNDLES_PER_SHARD`` bundles per shard; only groups as large as a bundle should be stand for themselves, and there
cannot be more than three times as many of those. The rows of such a group are counted and numbered in cells
of a bundle's size, by a hash of the id, so that no task has to sort a whole group; cells are placed together. So the number
of cells is bounded by a multiple of the number of shards, whatever the corpus; they are placed on the driver, and the
outcome is a table of that size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import word_count
from quillon.session import stored

SHARDS = 24
BUNDLES_PER_SHARD = 64
PIECE = 0.25  # of a shard: most that a piece of a group has that no shard can hold
_MEASURES = ("size", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (a row per vector, a column per measure)."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1)
    left = np.full((shards, vectors.shape[1]), 1.0 / shards)
    order = np.argsort(-share.max(axis=1), kind="stable")
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in order:
        fits = (left >= share[i]).all(axis=1)
        gain = left @ share[i]
        # Where none has room in every measure, the shard that is least overdrawn afterwards.
        best = np.argmax(np.where(fits, gain, -np.inf)) if fits.any() else np.argmax((left - share[i]).min(axis=1))
        out[i] = best
        left[best] -= share[i]
    return out


def placed(docs: DataFrame, shards: int = SHARDS, bundles_per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """``docs`` with ``size, text_crc32, shard, slot``.

    ``docs`` has ``doc_id`` and ``text``; other columns are kept, those of the four new names replaced. ``size`` is the
    text's bytes in UTF-8 (null: none) plus 8; ``text_crc32`` is that of the same bytes; ``slot`` numbers the rows of a shard
    from 0 without gaps. Null and empty texts are one group. Rows that repeat an id and a text take neighbouring slots in any
    order. Ids may be null. An empty table gives an empty result.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.drop("size", "text_crc32", "shard", "slot").withColumns({
        "size": F.octet_length(data).cast("long") + 8, "text_crc32": F.crc32(data).cast("long"),
        "_a": F.xxhash64(data), "_b": F.xxhash64(F.lit(1), data),
    })
    keys = rows.select("size", "_a", "_b", word_count(F.col("text")).alias("tokens"), F.xxhash64("doc_id").alias("_id"))
    keys = stored(keys, "keys")
    measured = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = keys.agg(*measured).first()
    quota = [max(1.0, (total[m] or 0) / (shards * bundles_per_shard)) for m in _MEASURES]
    groups = keys.groupBy("_a", "_b").agg(*measured)
    parts = F.greatest(*[F.col(m) / F.lit(q) for m, q in zip(_MEASURES, quota)])
    large = stored(
        groups.where(parts >= 1).select("_a", "_b", F.ceil(parts).cast("int").alias("_pieces")).withColumn(
            "_large", F.row_number().over(Window.orderBy("_a", "_b")) - 1), "large",
    )  # at most three per bundle: the shares of each measure add up to one
    bundles = shards * bundles_per_shard
    units = _units(keys, large, bundles).groupBy("_large", "_unit").agg(*measured)
    units = units.orderBy("_large", "_unit").toPandas()
    sizes = units[list(_MEASURES)].to_numpy(np.float64)
    whole = _placed_as_one(units["_large"].to_numpy(), sizes, shards)
    vectors = np.zeros((whole.max(initial=-1) + 1, len(_MEASURES)))
    np.add.at(vectors, whole, sizes)
    shard = pack(vectors, shards)[whole]
    offset = np.zeros(len(units), dtype=np.int64)
    for s in range(shards):
        own = shard == s
        offset[own] = np.cumsum(units["rows"].to_numpy()[own]) - units["rows"].to_numpy()[own]
    units = units.assign(shard=shard.astype(np.int32), _offset=offset)[["_large", "_unit", "shard", "_offset"]]
    spark = docs.sparkSession
    table = spark.createDataFrame(units, "_large int, _unit int, shard int, _offset long")
    rows = _units(rows.withColumn("_id", F.xxhash64("doc_id")), large, bundles)
    rows = rows.join(F.broadcast(table), ["_large", "_unit"])  # the bounded table of units
    turn = Window.partitionBy("_large", "_unit").orderBy("doc_id", "_a", "_b")
    slot = (F.col("_offset") + F.row_number().over(turn) - 1).cast("long")
    return rows.withColumn("slot", slot).drop("_a", "_b", "_id", "_large", "_unit", "_pieces", "_offset")


def _placed_as_one(large: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """For each unit, in order of groups, the number of what it is placed with: its group, if a shard can hold that, or a piece of it."""
    room = np.maximum(sizes.sum(axis=0), 1) / shards
    out = np.zeros(len(large), dtype=np.int64)
    n = 0
    for g in np.unique(large):
        own = np.flatnonzero(large == g)
        share = (sizes[own].sum(axis=0) / room).max()
        if g < 0:
            pieces = len(own)  # bundles of small groups
        else:
            pieces = 1 if share <= 1 else min(len(own), int(np.ceil(share / PIECE)))
        out[own] = n + np.arange(len(own)) * pieces // len(own)
        n += pieces
    return out


def _units(rows: DataFrame, large: DataFrame, bundles: int) -> DataFrame:
    """With what is numbered as one: a cell of a large group, or (``_large`` -1) a bundle of others."""
    rows = rows.join(F.broadcast(large), ["_a", "_b"], "left")
    unit = F.when(F.col("_large").isNull(), F.pmod(F.col("_a"), F.lit(bundles))).otherwise(F.pmod("_id", F.col("_pieces")))
    return rows.withColumn("_unit", unit.cast("int")).withColumn("_large", F.coalesce("_large", F.lit(-1)))
