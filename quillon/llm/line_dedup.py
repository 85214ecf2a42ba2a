"""Removing later copies of runs of lines.

A text is a sequence of line ids. Suffixes of all texts are ranked together by prefix doubling:
the rank of a suffix at level ``k`` names its first ``2 ** k`` lines, and follows from the ranks at
level ``k - 1`` of itself and of the suffix that many lines on. A rank is the first position at
which its lines stand, so the ranks of all levels, sorted, are the suffix array with its suffixes
in order of first occurrence, and a suffix whose rank is not its own position has an earlier
copy. Only lines that occur twice take part, and a level keeps only suffixes that share their
rank, so the tables shrink to what is repeated.

The suffixes that share their first ``L`` lines are an interval of the suffix array, with a longest
common prefix of ``L`` lines or more. The rank of a prefix of any length is the pair of ranks of two
overlapping powers of two, so intervals of any length are groups of pairs, and the smallest position in one is
the first copy. For each suffix the shortest prefix with ``min_words`` words is looked up, and if it has
an earlier copy, the longer ones up to where the next suffix takes over: that yields maximal
runs, though at most ``log2(min_words)`` levels are ever ranked, however long the copies.

All steps are DataFrame operations, joins and grouped minima; hot lines are summed before
they are shuffled, and their joins are between two shuffled sides, which Spark splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD
from quillon.operators.joins import lookup_join
from quillon.session import stored

MIN_WORDS = 50
_AT = ("did", "h")
_NO_ID = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    """With the document's key: its id (null counts as the smallest) and a hash of its text."""
    return docs.withColumn("_did", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("_h", F.xxhash64("text"))


def _has_words(line: Column) -> Column:
    return line.rlike(WORD)


def text_lines(docs: DataFrame) -> DataFrame:
    """Lines with words: ``did, h`` (document), ``i`` (number among them), ``r`` (among all), ``a, b`` (id), ``w`` (words)."""
    lines = F.transform(F.split("text", "\n"), lambda line, r: F.struct(r.alias("r"), line.alias("line")))
    rows = _keyed(docs.select("doc_id", "text")).select(
        F.col("_did").alias("did"), F.col("_h").alias("h"),
        F.posexplode(F.filter(lines, lambda x: _has_words(x["line"]))).alias("i", "x"),
    )
    line = F.col("x.line")
    return rows.select(
        "did", "h", "i", F.col("x.r").alias("r"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"),
        F.regexp_count(line, F.lit(WORD)).alias("w"),
    )


def _position() -> Column:
    return F.struct("did", "h", "i")


def _ranked(rows: DataFrame, prefix: list[str], label: str) -> DataFrame:
    """Rows whose prefix others share, with its rank: ``rank`` and the columns of the rows."""
    first = rows.groupBy(*prefix).agg(F.min(_position()).alias("rank"), F.count(F.lit(1)).alias("c"))
    first = stored(first.where("c > 1").drop("c"), label)
    return stored(rows.join(first, prefix), label)


def suffix_ranks(lines: DataFrame, levels: int) -> list[DataFrame]:
    """By level ``k``, the suffixes that share their first ``2 ** k`` lines: ``did, h, i, rank``.

    The first level also has ``r`` and ``w`` of the line.
    """
    ranks = [stored(_ranked(lines, ["a", "b"], "lines").drop("a", "b").distinct(), "ranks0")]
    for k in range(1, levels + 1):
        half = ranks[-1].select("did", "h", "i", F.col("rank").alias("x"))
        rest = half.select("did", "h", (F.col("i") - 2 ** (k - 1)).cast("int").alias("i"), F.col("x").alias("y"))
        level = _ranked(half.join(rest, ["did", "h", "i"]), ["x", "y"], f"ranks{k}").drop("x", "y")
        if level.isEmpty():
            break
        ranks.append(level)
    return ranks


def repeated_runs(ranks: list[DataFrame], min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal runs of at least ``min_words`` words with an earlier copy: ``did, h, i, length`` (in lines).

    One row per line at which such a run starts, with the longest of them; runs may overlap.
    """
    by_level = None
    for k, level in enumerate(ranks):
        rows = level.select("did", "h", "i", F.lit(k).alias("k"), "rank")
        by_level = rows if by_level is None else by_level.unionByName(rows)
    in_order = Window.partitionBy(*_AT).orderBy("i")
    upto = F.sum("w").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    starts = ranks[0].select("did", "h", "i", "w", F.coalesce(upto, F.lit(0)).alias("c"))
    ahead = Window.partitionBy(*_AT).orderBy("c").rangeBetween(0, min_words - 1)
    starts = starts.withColumn("n", F.count(F.lit(1)).over(ahead)).withColumn("words", F.sum("w").over(ahead))
    # Up to the length at which the next suffix's own shortest prefix is complete.
    starts = starts.withColumn("limit", F.greatest("n", F.lead("n", 1, 0).over(in_order) + 1)).where(F.col("words") >= min_words)
    tried = starts.select("did", "h", "i", F.explode(F.expr("sequence(int(n), int(limit))")).alias("length"))
    k = F.floor(F.log2(F.col("length") + 0.5)).cast("int")
    tried = tried.withColumn("k", k).withColumn("j", (F.col("i") + F.col("length") - F.pow(F.lit(2), F.col("k"))).cast("int"))
    at_end = by_level.select("did", "h", F.col("i").alias("j"), "k", F.col("rank").alias("y"))
    named = tried.join(by_level.withColumnRenamed("rank", "x"), ["did", "h", "i", "k"]).join(at_end, ["did", "h", "j", "k"])
    intervals = _ranked(named.select("did", "h", "i", "length", "x", "y"), ["length", "x", "y"], "intervals")
    later = intervals.where(F.col("rank") < _position())
    return later.groupBy("did", "h", "i").agg(F.max("length").alias("length"))


def _ranges(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Per document, the stretches of its text's lines (``r``) that runs cover: ``did, h, cut``."""
    before = Window.partitionBy(*_AT).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*_AT).orderBy("i")
    end = F.col("i") + F.col("length")
    new = (F.col("i") > F.coalesce(F.max(end).over(before), F.lit(-1))).cast("int")
    islands = runs.withColumn("new", new).withColumn("island", F.sum("new").over(upto)).groupBy(*_AT, "island").agg(
        F.min("i").alias("first"), (F.max(end) - 1).cast("int").alias("last")
    )
    at = lines.select("did", "h", "i", "r")
    islands = islands.join(at.toDF("did", "h", "first", "from"), ["did", "h", "first"])
    islands = islands.join(at.toDF("did", "h", "last", "to"), ["did", "h", "last"])
    return islands.groupBy(*_AT).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("cut"))


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the later copies of runs of lines, and with ``n_lines, n_removed`` (lines with words).

    A line goes if it lies in a run of consecutive lines with ``min_words`` words in all that also stands
    earlier: in a document with a smaller id, or further up in the same one. Lines are compared whole,
    white space included; lines without words are no part of a run, but go with a run they stand
    in, or right behind. Texts are cut at line feeds only.

    A null or empty text stays as it is. A null id counts as the smallest; rows that share it are in order
    of a hash of their texts, and so are other rows of one id. Rows that repeat both id and text are
    one document and come out alike. Columns of the input are kept, except that ``n_lines`` and ``n_removed`` are
    replaced. An empty table gives an empty result.
    """
    lines = stored(text_lines(docs), "lines")
    ranks = suffix_ranks(lines, (min_words - 1).bit_length())
    runs = stored(repeated_runs(ranks, min_words), "runs")
    cuts = stored(_ranges(runs, ranks[0]), "cuts").toDF("_did", "_h", "_cut")
    rows = lookup_join(_keyed(docs.drop("n_lines", "n_removed")), cuts, ["_did", "_h"], "left")
    every = F.split("text", "\n")
    inside = lambda r: F.exists("_cut", lambda c: (r >= c["from"]) & (r <= c["to"]))
    behind = lambda r: F.exists("_cut", lambda c: r == c["to"] + 1)
    kept = F.filter(every, lambda line, r: ~(inside(r) | (behind(r) & ~_has_words(line))))
    count = lambda x: F.size(F.filter(x, _has_words))
    rows = rows.withColumn("_kept", F.when(F.col("_cut").isNotNull(), kept))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(count(every)))
    rows = rows.withColumn("n_removed", F.when(F.col("_cut").isNull(), 0).otherwise(F.col("n_lines") - count(F.col("_kept"))))
    rows = rows.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")))
    return rows.drop("_did", "_h", "_cut", "_kept")
