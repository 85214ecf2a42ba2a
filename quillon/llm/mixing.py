"""Mixing the documents of several sources to target weights by systematic sampling.

Each source gets a target: a share of all words by its weight, but no more than ``MOST`` times its
own words. A document's expected number of copies is its source's target over the source's words. Within
a source the documents stand in order of size, then of a hash of the id; their expected copies are
summed in that order from one random offset, and a document is taken once for each whole number that
its stretch of the sum crosses. So every document is taken a whole number of times, one of the two nearest to
its expectation, and documents of like size take turns, which keeps the words taken near the target.

The expectation is the same for all documents of a source, so the sum up to a document is its
number in the order times that. Numbers are given out without a source ever meeting in one
task: documents are counted by source and size, and sizes with many documents also by leading digits of the
hash, as many as bring a cell to about ``CELL`` rows. Counts are summed in order, rows are numbered inside cells only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import word_count
from quillon.operators.joins import lookup_join
from quillon.session import stored

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240229
CELL = 500
_HASH_DIGITS = 15


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (a row per ``source``, which may be null, with its words ``source_size``) with ``target``.

    Sources in order of code points, null last, weigh ``WEIGHTS`` in turn. The targets share the words of
    all sources by weight; one that would pass ``MOST`` times its source's words stops there, and the
    excess is shared out again by weight. Sources in order of that limit per weight: the first
    stop at theirs, and from the first whose share of what is left fits, all do.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("row") % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("row", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    rows = rows.withColumn("weight", weight).withColumn("limit", MOST * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "row")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    words = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("unit", (words - before) / weights)
    fitting = F.when(F.col("unit") * F.col("weight") <= F.col("limit"), F.col("unit"))
    unit = F.first(fitting, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("target", F.coalesce(unit * F.col("weight"), F.col("limit").cast("double")))
    return rows.drop("row", "weight", "limit", "unit")


def _offset(name: Column) -> Column:
    """The random offset of a source, from 0 to below 1: few enough bits that sums with it stay exact."""
    digest = F.md5(F.concat(F.lit(f"{SEED}|"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / F.lit(float(1 << 20))


def _order_hash(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("_name", name).withColumn(
        "_hash", _order_hash(F.col("doc_id"))
    )


def _cell(digits: Column) -> Column:
    """The leading digits of the order hash as a number."""
    return F.floor(F.col("_hash") / F.pow(F.lit(16.0), F.lit(_HASH_DIGITS) - digits)).cast("long")


def _starts(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the documents of each size, and of each cell of a size with many, begin in their source's order."""
    counts = keys.groupBy("_name", "size").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_name").orderBy("size"))
    digits = F.least(F.lit(6), F.greatest(F.lit(0), F.ceil(F.log2(F.col("c") / F.lit(float(CELL))) / 4))).cast("int")
    sizes = counts.select("_name", "size", (upto - F.col("c")).alias("_start"), digits.alias("_digits"))
    sizes = stored(sizes, "sizes")
    many = lookup_join(keys, sizes.where("_digits > 0"), ["_name", "size"])
    cells = many.groupBy("_name", "size", _cell(F.col("_digits")).alias("_cell")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_name", "size").orderBy("_cell"))
    return sizes, stored(cells.select("_name", "size", "_cell", (upto - F.col("c")).alias("_within")), "cells")


def with_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size, source_size, target`` and ``n_copies``, how often the mix takes each document.

    ``docs`` has ``doc_id, text, source``; other columns are kept, and columns of the four new names
    replaced. ``size`` is the number of words (null text: 0), ``target`` the words wanted of the source. A source without words
    has target 0 and gives no copies. A null source is a source of its own. Ids are ordered by a hash of their text (null as the
    empty text); rows that repeat an id and a size are told apart by a hash of the text and otherwise take any turn, so as
    a whole they are taken as often on every run. An empty table gives an empty result.
    """
    docs = _keyed(docs.drop("size", "source_size", "target", "n_copies"))
    keys = stored(docs.select("source", "_name", "size", "_hash"), "keys")
    sources = keys.groupBy("source", "_name").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sources).drop("source"), "targets")
    sizes, cells = _starts(keys)
    rows = lookup_join(docs, stored(sizes.join(targets, "_name"), "places"), ["_name", "size"])
    rows = rows.withColumn("_cell", F.when(F.col("_digits") > 0, _cell(F.col("_digits"))).otherwise(0))
    rows = lookup_join(rows, cells, ["_name", "size", "_cell"], "left")
    turn = Window.partitionBy("_name", "size", "_cell").orderBy("_hash", "doc_id", F.xxhash64("text"))
    number = F.col("_start") + F.coalesce("_within", F.lit(0)) + F.row_number().over(turn) - 1
    expected = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("_number", number).withColumn("_expected", expected)
    crossed = lambda n: F.floor(_offset(F.col("_name")) + F.col("_expected") * n)
    taken = F.least(F.lit(MOST), crossed(F.col("_number") + 1) - crossed(F.col("_number")))
    hidden = ("_name", "_hash", "_start", "_digits", "_cell", "_within", "_number", "_expected")
    return rows.withColumn("n_copies", taken.cast("int")).drop(*hidden)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`with_copies` says, with the columns it came with."""
    rows = with_copies(docs).where("n_copies > 0")
    return rows.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select(*docs.columns)
