import statistics

import pytest
from pyspark.sql import functions as F

from quillon.operators import groups, reports
from quillon.operators.joins import lookup_join, measured_bytes, spread_join
from quillon.plans.evaluate import evaluation_metrics


@pytest.fixture()
def scored(spark):
    rows = [
        (run, source, round(((i * 7919) % 10000) / 10000 - (0.4 if run == "baseline" else 0.2), 4))
        for run in ("baseline", "tuned") for source, n in (("spider", 37), ("bird", 81)) for i in range(n)
    ]
    return spark.createDataFrame(rows, "run string, source string, reward double")


def test_report_and_metrics(spark, scored):
    rows = [tuple(r) for r in scored.collect()]
    metrics = evaluation_metrics(scored)
    assert set(metrics) == {f"{r}_reward_{s}" for r in ("baseline", "tuned") for s in ("spider", "bird", "avg")}
    for run in ("baseline", "tuned"):
        values = [x for r, _, x in rows if r == run]
        assert metrics[f"{run}_reward_avg"] == pytest.approx(statistics.fmean(values), abs=1e-4)


def test_compare_runs(spark, scored):
    got = {r["source"]: r for r in reports.compare_runs(scored, reference_run="tuned").collect()}
    base = statistics.fmean(r["reward"] for r in scored.where("run = 'baseline' and source = 'bird'").collect())
    tuned = statistics.fmean(r["reward"] for r in scored.where("run = 'tuned' and source = 'bird'").collect())
    assert got["bird"]["change"] == pytest.approx(tuned - base, abs=1e-4)
    assert got["bird"]["change_pct"] == pytest.approx((tuned - base) / base * 100, abs=1e-3)
    assert got["avg"]["reference_pct"] == 100.0


def test_summary_is_describe(spark, scored):
    values = [r["reward"] for r in scored.collect()]
    import pandas as pd

    want = pd.Series(values).describe()
    got = reports.reward_summary(scored).first()
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}
    for ours, theirs in names.items():
        assert got[ours] == pytest.approx(want[theirs], abs=1.01e-4)


def test_summary_of_nothing_and_one(spark):
    kind = "reward double"
    assert reports.reward_summary(spark.createDataFrame([], kind)).first()["count"] in (0, None)
    one = reports.reward_summary(spark.createDataFrame([(0.5,), (None,)], kind)).first()
    assert (one["count"], one["mean"], one["std"], one["p50"]) == (1, 0.5, None, 0.5)


def test_token_reports(spark):
    usage = spark.createDataFrame(
        [("a", 600, 120, "x"), ("a", 600, 120, ""), ("b", 10, 0, "y")],
        "source string, prompt_tokens long, completion_tokens long, completion string",
    )
    got = {r["source"]: tuple(r)[1:] for r in reports.token_usage(usage).collect()}
    assert got == {"a": (2, 1, 1200, 240, 1440), "b": (1, 1, 10, 0, 10), "total": (3, 2, 1210, 240, 1450)}
    cost = {r["source"]: r for r in reports.token_cost(usage).collect()}["a"]
    assert (cost["cost_per_call"], cost["cost_per_day"], cost["cost_per_month"]) == (0.00195, 19.5, 585.0)


def test_flatten_metrics_types(spark):
    text = '{"loss": 0.5, "n": 3, "big": 12345678901234567890123, "flag": true, "note": "7", "none": null, "list": [1]}'
    got = reports.flatten_metrics(spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "step long, logs string"))
    assert {r["metric"]: r["value"] for r in got.collect()} == {
        "loss": 0.5, "n": 3.0, "big": 12345678901234567890123.0, "flag": 1.0
    }


def test_crossings(spark):
    rows = spark.createDataFrame(
        [(1, "reward", 0.6), (38, "reward", 0.75), (40, "reward", 0.7), (800, "reward", 0.86), (2, "loss", 9.0)],
        "step long, metric string, value double",
    )
    got = {r["level"]: r["first_step"] for r in reports.reward_crossings(rows, [0.75, 0.85, 0.99]).collect()}
    assert got == {0.75: 38, 0.85: 800, 0.99: None}


def test_group_advantage_with_a_hot_group(spark):
    """One prompt holds a third of the rows; it must neither lose rows nor its statistics."""
    hot = spark.range(0, 900, 1, 9).select(F.lit(7).alias("prompt_id"), (F.col("id") % 11).alias("reward_units"))
    rest = spark.range(1800).select((F.col("id") % 600 + 100).alias("prompt_id"), (F.col("id") % 7).alias("reward_units"))
    lone = spark.createDataFrame([(1, 5), (2, 4), (2, 4), (None, 3), (None, 9)], "prompt_id long, reward_units long")
    rows = hot.unionByName(rest).unionByName(lone)
    got = groups.group_advantage(rows).collect()
    assert len(got) == rows.count()
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r["prompt_id"], []).append(r["reward_units"])
    for r in got:
        values = by_group[r["prompt_id"]]
        spread = statistics.stdev(values) if len(values) > 1 and r["prompt_id"] is not None else 0.0
        want = (r["reward_units"] - statistics.fmean(values)) / spread if spread else 0.0
        assert r["advantage"] == pytest.approx(want, abs=1e-12)


def test_zero_variance(spark):
    rows = spark.createDataFrame(
        [("a", 1, 5), ("a", 1, 5), ("a", 2, 1), ("a", 2, 3), ("b", 3, 1)], "db_id string, prompt_id long, reward_units long"
    )
    got = {r["db_id"]: (r["groups"], r["flat_groups"], r["flat_share"]) for r in groups.zero_variance_groups(rows).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (1, 1, 1.0)}


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_spread_join_is_a_join(spark, how):
    rows = spark.range(0, 3000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id") % 50).otherwise(None).alias("k"), "id"
    )
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = rows.join(lookup, "k", how)
    for got in (spread_join(rows, lookup, "k", how, salts=8), lookup_join(rows, lookup, "k", how, limit=0),
                lookup_join(rows, lookup, "k", how)):
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_lookup_join_measures_before_it_broadcasts(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 10)
    lookup = spark.range(10).withColumnRenamed("id", "k")
    assert measured_bytes(lookup) == sum(len('{"k":%d}' % i) for i in range(10))
    small = lookup_join(rows, lookup, "k")._jdf.queryExecution().optimizedPlan().toString()
    large = lookup_join(rows, lookup, "k", limit=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in small and "_salt" in large


def test_rows_without_a_source_count_once(spark):
    rows = spark.createDataFrame(
        [("baseline", "a", 1.0), ("baseline", None, 0.0), ("baseline", "avg", 1.0)], "run string, source string, reward double"
    )
    got = sorted(((r["source"] or "", r["rows"], r["mean_reward"]) for r in reports.reward_report(rows).collect()))
    assert got == [("", 1, 0.0), ("a", 1, 1.0), ("avg", 1, 1.0), ("avg", 3, 0.6667)]
    means = sorted((r["source"] or "", r["baseline_mean"]) for r in reports.compare_runs(rows).collect())
    assert means == [("", 0.0), ("a", 1.0), ("avg", 0.6667), ("avg", 1.0)]
    usage = spark.createDataFrame([("a", 60, 40), (None, 5, 5)], "source string, prompt_tokens long, completion_tokens long")
    totals = {r["source"]: r["total_tokens"] for r in reports.token_usage(usage).collect()}
    assert totals == {"a": 100, None: 10, "total": 110}


def test_levels_tell_names_apart(spark):
    rows = spark.createDataFrame([("r", "avg", 1.0), ("r", None, 0.0), ("r", "null", 0.5)], "run string, source string, reward double")
    got = {(r["level"], r["source"]): r["value"] for r in reports.metric_rows(reports.reward_report(rows)).collect()}
    assert got == {("overall", "avg"): 0.5, ("source", "avg"): 1.0, ("source", None): 0.0, ("source", "null"): 0.5}
