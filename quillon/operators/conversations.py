"""Turns of conversations as ordered message lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import message
from quillon.operators.joins import lookup_join
from quillon.operators.ordering import running_sums
from quillon.session import stored

CHUNK_BYTES = 4 * 1024 * 1024
TURN_BYTES = 64  # what a turn costs beside its text


def conversation_lists(
    turns: DataFrame, chunk_bytes: int = CHUNK_BYTES, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conversation, chunk, messages``: the turns of each conversation in order, as lists of role and content.

    A conversation whose texts (and ``TURN_BYTES`` a turn) take up to ``chunk_bytes`` is one list, chunk 0. A longer one is cut into numbered chunks:
    a turn is in the chunk that the bytes of the turns before it make full. So no list, and no buffer, holds more than
    ``chunk_bytes`` and one turn, whatever the conversation. Only sizes are summed to find the long ones; their turns are
    sorted by ranges and not by conversation, so one that holds a third of all turns is spread over many tasks.

    Turns without a conversation are one with a null id. Turns stand in order of number (null first), role and text; repeated
    turns are all kept. Chunks are the same on every run.
    """
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("-")).alias("_group"),
        F.col(conversation).alias("_id"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"),
    )
    cost = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long") + TURN_BYTES
    totals = rows.groupBy("_group").agg(F.sum(cost).alias("_bytes"))
    long_ones = stored(totals.where(F.col("_bytes") > chunk_bytes).select("_group"), "long")
    short = rows.withColumn("chunk", F.lit(0).cast("long"))
    if not long_ones.isEmpty():
        parts = lookup_join(rows, long_ones, "_group", "left_semi")
        parts = running_sums(parts, "_group", ["_turn", "_role", "_text"], {"_before": cost})
        parts = parts.withColumn("chunk", F.floor(F.col("_before") / chunk_bytes)).drop("_before")
        short = lookup_join(short, long_ones, "_group", "left_anti").unionByName(parts)
    listed = F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text")))
    lists = short.groupBy("_group", "_id", "chunk").agg(listed.alias("_turns"))
    messages = F.transform("_turns", lambda t: message(t["_role"], t["_text"]))
    return lists.select(F.col("_id").alias(conversation), "chunk", messages.alias("messages"))
