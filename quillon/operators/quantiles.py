"""Exact order statistics of numbers of any kind, by narrowing down where they lie.

A buffer of all distinct values, which an exact percentile keeps, grows with the data. Here a round asks a bounded sketch for values
that stand about where the wanted ranks are, and counts exactly how many rows lie below, at and between two of them.
Each wanted rank then is one of those values, or lies in the open interval between two, which holds a small share of the
rows of the interval before: the sketch only proposes, the counts decide. After a few rounds the intervals are small enough to be sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import round4
from quillon.operators.joins import lookup_join
from quillon.session import stored

SHARES = (0.25, 0.5, 0.75)
GRID = 500  # the sketch is asked for this many steps between least and largest
ACCURACY = 10_000
SORTED_ROWS = 4096  # an interval of so many rows is sorted


def values_at_ranks(values: DataFrame, wanted: DataFrame, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """``key, rank, value``: the values with the given ranks (from 0) among the rows of their key.

    ``values`` has ``key`` (not null) and ``value`` (double, neither null nor NaN) and is read several times, so it should be stored. ``wanted`` has
    ``key``, ``rank``, and the key's rows as ``n``. The driver only learns whether any interval is still open.
    """
    start = {"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "before": F.lit(0).cast("long"), "inside": F.col("n")}
    state = stored(wanted.select("key", "rank", *[c.alias(n) for n, c in start.items()], F.lit(None).cast("double").alias("value"), F.lit(False).alias("done")), "ranks")
    found = []
    while True:
        found.append(state.where("done").select("key", "rank", "value"))
        small = state.where(~F.col("done") & (F.col("inside") <= sorted_rows))
        found.append(_sorted_out(values, small))
        still = state.where(~F.col("done") & (F.col("inside") > sorted_rows))
        if still.isEmpty():
            break
        state = stored(_narrowed(values, still), "ranks")
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def _held(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each value with the open intervals of its key that it lies in."""
    joined = lookup_join(values.withColumnRenamed("value", "v"), stored(intervals, "intervals"), "key")
    above, below = F.col("lo").isNull() | (F.col("v") > F.col("lo")), F.col("hi").isNull() | (F.col("v") < F.col("hi"))
    return joined.where(above & below)


def _sorted_out(values: DataFrame, small: DataFrame) -> DataFrame:
    """The wanted values of intervals with few rows."""
    kept = _held(values, small.select("key", "lo", "hi").distinct())
    lists = kept.groupBy("key", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    same = lambda c: F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}"))
    joined = small.alias("s").join(lists.alias("l"), (F.col("s.key") == F.col("l.key")) & same("lo") & same("hi"))
    return joined.select("s.key", "s.rank", F.get("l.vs", (F.col("s.rank") - F.col("s.before")).cast("int")).alias("value"))


def _narrowed(values: DataFrame, state: DataFrame) -> DataFrame:
    """The state after a round."""
    grid = [k / GRID for k in range(GRID + 1)]
    kept = _held(values, state.select("key", "lo", "hi").distinct())
    sketch = kept.groupBy("key", "lo", "hi").agg(F.approx_percentile("v", grid, ACCURACY).alias("at"))
    same = lambda c: F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}"))
    joined = state.alias("s").join(sketch.alias("k"), (F.col("s.key") == F.col("k.key")) & same("lo") & same("hi"))
    step = F.floor((F.col("s.rank") - F.col("s.before")) * F.lit(float(GRID)) / F.col("s.inside")).cast("int")
    proposed = stored(joined.select(
        "s.key", "s.rank", "s.lo", "s.hi", "s.before", "s.inside",
        F.get("k.at", F.greatest(F.lit(0), step - 1)).alias("p"), F.get("k.at", F.least(F.lit(GRID), step + 2)).alias("q"),
    ), "proposed")
    v, p, q = F.col("v"), F.col("p"), F.col("q")
    counts = _held(values, proposed.select("key", "rank", "lo", "hi", "p", "q")).groupBy("key", "rank").agg(
        F.count_if(v < p).alias("below"), F.count_if(v == p).alias("at_p"), F.count_if((v > p) & (v < q)).alias("between"),
        F.count_if((v == q) & (q > p)).alias("at_q"),
    )
    rows = proposed.join(counts, ["key", "rank"])
    at, upto = F.col("rank") - F.col("before"), F.col("below")
    ends = [upto, upto + F.col("at_p"), upto + F.col("at_p") + F.col("between"), upto + F.col("at_p") + F.col("between") + F.col("at_q")]
    case = lambda *values: F.when(at < ends[0], values[0]).when(at < ends[1], values[1]).when(at < ends[2], values[2]).when(at < ends[3], values[3]).otherwise(values[4])
    none, start = F.lit(None).cast("double"), F.col("before")
    return rows.select(
        "key", "rank",
        case(F.col("lo"), none, p, none, q).alias("lo"), case(p, none, q, none, F.col("hi")).alias("hi"),
        case(start, start, start + ends[1], start, start + ends[3]).alias("before"),
        case(F.col("below"), F.lit(0), F.col("between"), F.lit(0), F.col("inside") - ends[3]).alias("inside"),
        case(none, p, none, q, none).alias("value"), case(*[F.lit(x) for x in (False, True, False, True, False)]).alias("done"),
    )


def exact_quantiles(rows: DataFrame, value: str, by: str, shares: Sequence[float] = SHARES, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """``by, share, value``: exact quantiles with linear interpolation of the numbers of each ``by``. Null and NaN are left out, as is a null ``by``."""
    values = stored(_numbers(rows, value, by), "values")
    sizes = stored(values.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    asked = sizes.select("key", "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    asked = asked.withColumn("place", (F.col("n") - 1) * F.col("share"))
    ranks = asked.select("key", "n", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    found = stored(values_at_ranks(values, ranks, sorted_rows), "found")
    low, high = (found.select("key", F.col("rank").alias(r), F.col("value").alias(v)) for r, v in (("_l", "_a"), ("_h", "_b")))
    placed = asked.withColumns({"_l": F.floor("place"), "_h": F.ceil("place")}).join(low, ["key", "_l"]).join(high, ["key", "_h"])
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("place") - F.col("_l"))
    return placed.select(F.col("key").alias(by), "share", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("value"))


def _numbers(rows: DataFrame, value: str, by: str) -> DataFrame:
    number = F.col(value).cast("double")
    return rows.select(F.col(by).alias("key"), number.alias("value")).where(number.isNotNull() & ~F.isnan(number) & F.col(by).isNotNull())


def metric_summary(rows: DataFrame, value: str = "value", by: str = "metric") -> DataFrame:
    """Per ``by``: count, mean, sample deviation, minimum, exact quartiles (linear interpolation), maximum, to four decimals.

    For numbers of any range and however many distinct ones; see :func:`exact_quantiles`. The deviation is null for a single number.
    """
    values = stored(_numbers(rows, value, by), "values")
    totals = values.groupBy("key").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    quartiles = exact_quantiles(values, "value", "key").groupBy("key").agg(
        *[F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"p{round(100 * s)}") for s in SHARES]
    )
    joined = totals.join(quartiles, "key")
    numbers = ("mean", "std", "min", "p25", "p50", "p75", "max")
    return joined.select(F.col("key").alias(by), "count", *[round4(F.col(c)).alias(c) for c in numbers])
