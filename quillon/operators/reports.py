"""Reports over scored rows. Sums are whole numbers, so row order never shows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.fixed_values import TOKEN_PRICES
from quillon.functions.numbers import UNITS, deviation_units, mean_units, reward_units, round4


def _sums_by(scored: DataFrame, keys: Sequence[str], reward: str) -> DataFrame:
    units = reward_units(F.col(reward))
    return scored.groupBy(*keys).agg(F.count(reward).alias("_n"), F.sum(units).alias("_units"))


def _levels() -> Column:
    """Each sum twice: for its source and for all of them. The level, and not a null, tells them apart."""
    own = F.struct(F.lit(False).alias("overall"), F.col("source").cast("string").alias("source"))
    every = F.struct(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("source"))
    return F.explode(F.array(own, every)).alias("level")


def _labelled(name: str) -> Column:
    return F.when(F.col("overall"), F.lit(name)).otherwise(F.col("source")).alias("source")


def reward_report(scored: DataFrame, reward: str = "reward") -> DataFrame:
    """Mean reward per run and source, and per run over all sources (``source`` = 'avg'; ``level`` = 'overall', for others 'source').

    Rows are summed per run and source once; the row-weighted overall mean is formed from
    those few sums and not from a second expansion of the rows. Rows without a source are a
    source of their own, null.
    """
    sums = _sums_by(scored, ["run", "source"], reward)
    rolled = sums.select("run", _levels(), "_n", "_units").select("run", "level.*", "_n", "_units")
    return (
        rolled.groupBy("run", "overall", "source")
        .agg(F.sum("_n").alias("rows"), F.sum("_units").alias("_units"))
        .select(
            "run",
            F.when(F.col("overall"), "overall").otherwise("source").alias("level"),
            _labelled("avg"),
            "rows",
            round4(mean_units(F.col("_units"), F.col("rows"))).alias("mean_reward"),
        )
    )


def metric_rows(report: DataFrame) -> DataFrame:
    """Report rows as ``metric, value``: ``{run}_reward_{source}`` and ``{run}_reward_avg``.

    ``level`` tells the mean over all sources from that of a source called ``avg``, and a null ``source`` from one called ``null``.
    """
    name = F.concat(F.col("run"), F.lit("_reward_"), F.coalesce("source", F.lit("null")))
    return report.select("run", "level", "source", name.alias("metric"), F.col("mean_reward").alias("value"))


def compare_runs(
    scored: DataFrame, base: str = "baseline", other: str = "tuned", reward: str = "reward",
    reference_run: str | None = None,
) -> DataFrame:
    """Per source and overall: both means, absolute and relative change, and optionally the
    share of a reference run's mean that the other run reaches."""
    runs = [base, other] + ([reference_run] if reference_run else [])
    wanted = scored.where(F.col("run").isin(*runs))
    sums = _sums_by(wanted, ["source", "run"], reward)
    rolled = sums.select("run", _levels(), "_n", "_units").select("run", "level.*", "_n", "_units")

    def mean_of(run: str) -> Column:
        chosen = F.col("run") == run
        return mean_units(F.sum(F.when(chosen, F.col("_units"))), F.sum(F.when(chosen, F.col("_n"))))

    means = rolled.groupBy("overall", "source").agg(*[mean_of(r).alias(f"_m{i}") for i, r in enumerate(runs)])
    columns = [
        _labelled("avg"),
        round4(F.col("_m0")).alias(f"{base}_mean"),
        round4(F.col("_m1")).alias(f"{other}_mean"),
        round4(F.col("_m1") - F.col("_m0")).alias("change"),
        round4((F.col("_m1") - F.col("_m0")) * 100.0 / F.nullif(F.col("_m0"), F.lit(0.0))).alias("change_pct"),
    ]
    if reference_run:
        share = F.col("_m1") * 100.0 / F.nullif(F.col("_m2"), F.lit(0.0))
        columns.append(round4(share).alias("reference_pct"))
    return means.select(*columns)


def reward_summary(scored: DataFrame, reward: str = "reward") -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles (linear interpolation), maximum.

    Rows are first counted per distinct reward. Rewards have four decimals, so what the
    exact quartiles are taken from is bounded by the range of the score and not by the rows.
    """
    units = reward_units(F.col(reward))
    counted = (
        scored.where(F.col(reward).isNotNull())
        .groupBy(units.alias("units"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    u, n = F.col("units"), F.col("n")
    wide = u.cast("decimal(19,0)")
    squares = F.sum((wide * wide * n.cast("decimal(19,0)")).cast("decimal(38,0)"))
    quartiles = F.percentile(u, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    totals = counted.agg(
        F.sum("n").alias("count"),
        F.sum(u * n).alias("total"),
        squares.cast("decimal(38,0)").alias("squares"),
        F.min("units").alias("low"),
        F.max("units").alias("high"),
        quartiles.alias("quartiles"),
    )
    scale = F.lit(float(UNITS))
    return totals.select(
        "count",
        round4(mean_units(F.col("total"), F.col("count"))).alias("mean"),
        round4(deviation_units(F.col("count"), F.col("total"), F.col("squares")) / scale).alias("std"),
        (F.col("low") / scale).alias("min"),
        *[
            round4(F.get("quartiles", F.lit(i)) / scale).alias(name)
            for i, name in enumerate(("p25", "p50", "p75"))
        ],
        (F.col("high") / scale).alias("max"),
    )


def token_usage(usage: DataFrame) -> DataFrame:
    """Rows, non-empty answers and token sums per source and overall (``source`` = 'total').

    Wants ``source, prompt_tokens, completion_tokens`` and, to count answers, ``completion``.
    """
    prompt, completion = F.col("prompt_tokens"), F.col("completion_tokens")
    answered = (
        F.count_if(F.char_length("completion") > 0) if "completion" in usage.columns else F.count(F.lit(1))
    )
    sums = usage.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        answered.alias("answered"),
        F.sum(prompt).alias("prompt_tokens"),
        F.sum(completion).alias("completion_tokens"),
        F.sum(prompt + completion).alias("total_tokens"),
    )
    measures = ["rows", "answered", "prompt_tokens", "completion_tokens", "total_tokens"]
    rolled = sums.select(_levels(), *measures).select("level.*", *measures)
    summed = rolled.groupBy("overall", "source").agg(*[F.sum(m).alias(m) for m in measures])
    return summed.select(_labelled("total"), *measures)


def token_cost(
    usage: DataFrame, prices: Iterable[tuple[str, float, float]] = TOKEN_PRICES, calls_per_day: int = 10_000,
    days_per_month: int = 30,
) -> DataFrame:
    """Cost of the tokens by source and deployment, in all, per call, per day and per month.

    The price list is a short literal, unfolded over the few per-source sums.
    """
    sums = token_usage(usage).select("source", "rows", "prompt_tokens", "completion_tokens")
    entries = [
        F.struct(
            F.lit(name).alias("deployment"), F.lit(float(p)).alias("p"), F.lit(float(c)).alias("c")
        )
        for name, p, c in prices
    ]
    priced = sums.select("*", F.explode(F.array(*entries)).alias("price"))
    micro = F.col("prompt_tokens") * F.col("price.p") + F.col("completion_tokens") * F.col("price.c")
    per_call = micro / F.lit(1e6) / F.col("rows")

    def rounded(value: Column, scale: float) -> Column:
        return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)

    return priced.select(
        "source",
        F.col("price.deployment").alias("deployment"),
        rounded(micro / F.lit(1e6), 1e4).alias("cost"),
        rounded(per_call, 1e6).alias("cost_per_call"),
        rounded(per_call * F.lit(float(calls_per_day)), 1e4).alias("cost_per_day"),
        rounded(per_call * F.lit(float(calls_per_day * days_per_month)), 1e4).alias("cost_per_month"),
    )


def flatten_metrics(log: DataFrame, logs: str = "logs") -> DataFrame:
    """``step, metric, value`` from JSON log records: numbers, and booleans as 0 or 1.

    The type is that of the JSON value, so a number written as a string is text and left out.
    Needs no state, so it is the same on a stream.
    """
    entries = log.select("step", F.explode(F.from_json(logs, "map<string,variant>")).alias("metric", "_value"))
    kind = F.schema_of_variant("_value")
    numeric = kind.rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.when(kind == "BOOLEAN", F.try_variant_get("_value", "$", "boolean").cast("double")).when(
        numeric, F.try_variant_get("_value", "$", "double")
    )
    return entries.select("step", "metric", value.alias("value")).where(F.col("value").isNotNull())


def reward_crossings(metrics: DataFrame, levels: Sequence[float], metric: str = "reward") -> DataFrame:
    """First step at which the metric is at or above each level; null if never. One pass."""
    firsts = metrics.where(F.col("metric") == metric).agg(
        *[F.min(F.when(F.col("value") >= F.lit(float(x)), F.col("step"))).alias(f"_l{i}") for i, x in enumerate(levels)]
    )
    entries = [
        F.struct(F.lit(float(x)).alias("level"), F.col(f"_l{i}").alias("first_step")) for i, x in enumerate(levels)
    ]
    return firsts.select(F.inline(F.array(*entries)))
