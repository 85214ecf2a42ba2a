"""Operators whose point is what they do not do: shuffle texts, gather groups, read twice, or leave files behind."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import examples, quantiles
from quillon.operators.conversations import TURN_BYTES, conversation_lists
from quillon.operators.joins import lookup_join, split_plan, spread_join
from quillon.operators.ordering import running_sums
from quillon.operators.prefilter import with_membership
from quillon.operators.split import attach_split
from quillon.plans.prepare import prompt_datasets
from quillon.sources.metrics_table import MOST_FOLDERS, append_batch, read_metrics
from quillon.streaming import append_metrics_merged


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# --- bitmap --------------------------------------------------------------------------


def test_membership_loses_no_row_and_lets_few_through(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 1000 != 0, F.col("id")).alias("k"), F.col("id").cast("string").alias("s"))
    keys = rows.where("k % 10 = 3").select("k", "s")
    flagged = with_membership(rows, keys, ["k", "s"])
    assert flagged.columns == [*rows.columns, "_maybe"]
    assert flagged.where("k % 10 = 3 AND NOT _maybe").isEmpty()
    assert flagged.where("_maybe AND (k % 10 <> 3 OR k IS NULL)").count() < 0.1 * 90_000
    assert "hashpartitioning" not in plan_of(flagged)


def test_membership_of_nothing_and_of_null(spark):
    rows = spark.createDataFrame([(1,), (None,), (2,)], "k long")
    assert with_membership(rows, rows.limit(0), ["k"]).where("_maybe").isEmpty()
    assert with_membership(rows, rows.where("k IS NULL"), ["k"]).where("_maybe AND k IS NULL").count() == 1


# --- dedupe --------------------------------------------------------------------------


def repeated_rows(spark):
    rows = [("a", "x", None), ("a", "x", None), ("a", None, "x"), (None, "a", "x"), (None, None, None), (None, None, None)]
    rows += [("hot", "long " * 40, "z")] * 500 + [(str(i), "u", f"v{i % 3}") for i in range(900)]
    return spark.createDataFrame(rows, "p string, q string, r string").repartition(5)


def test_dedupe_keeps_one_of_equal_rows(spark):
    rows = repeated_rows(spark)
    want = rows.distinct()
    got = examples.dedupe_examples(rows)
    assert got.columns == rows.columns and same_rows(got, want)
    assert examples.duplicate_count(rows).first()[0] == rows.count() - want.count() == 501
    assert same_rows(examples.dedupe_examples(want), want) and examples.duplicate_count(want).first()[0] == 0
    none = rows.limit(0)
    assert examples.dedupe_examples(none).isEmpty() and examples.duplicate_count(none).first()[0] == 0


def test_dedupe_of_columns_with_awkward_names(spark):
    rows = spark.createDataFrame([(1, 2, [3]), (1, 2, [3]), (2, 1, None)], "`a.b` int, A int, a array<int>")
    got = examples.dedupe_examples(rows)
    assert got.columns == ["a.b", "A", "a"] and sorted(map(tuple, got.collect())) == [(1, 2, [3]), (2, 1, None)]
    assert examples.duplicate_count(rows).first()[0] == 1


def test_rows_that_do_not_repeat_are_not_shuffled(spark, tmp_path):
    """Of 900 rows with a text of their own, next to none reach the exchange."""
    repeated_rows(spark).write.parquet(str(tmp_path / "rows"))
    got = examples.dedupe_examples(spark.read.parquet(str(tmp_path / "rows")))
    exchanges = [line for line in plan_of(got).splitlines() if re.search(r"Exchange hashpartitioning", line)]
    assert "Union" in plan_of(got) and len(exchanges) == 1
    marked = with_membership(
        repeated_rows(spark).withColumns(examples._digests(repeated_rows(spark))), examples._repeated_digests(repeated_rows(spark)), list(examples._DIGESTS)
    )
    assert marked.where("_maybe AND q = 'u'").count() < 45


# --- exclusion -----------------------------------------------------------------------


@pytest.mark.parametrize("as_frame", [False, True])
def test_exclusion_counts_in_the_pass_that_filters(spark, tmp_path, as_frame):
    rows = spark.createDataFrame([("web", 1), ("web", 2), ("a", 3), (None, 4), ("b", 5)], "db_id string, n int").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    values = spark.createDataFrame([("web",), ("web",), (None,), ("zzz",)], "db_id string") if as_frame else ["web"]
    kept, seen = examples.exclude_groups_counted(source, values)
    assert kept.columns == source.columns
    assert sum("FileScan" in line and str(tmp_path) in line for line in plan_of(kept).splitlines()) == 1
    report = examples.exclusion_report(kept, seen, str(tmp_path / "out"))
    assert report.collect() == [(5, 2, 3)]
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 4, 5]


def test_exclusion_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "db_id string, n int")
    for k, values in enumerate(([], rows.limit(0))):
        assert examples.exclusion_report(*examples.exclude_groups_counted(rows, values), str(tmp_path / str(k))).collect() == [(1, 0, 1)]
    empty = examples.exclude_groups_counted(rows.limit(0), ["a"])
    assert examples.exclusion_report(*empty, str(tmp_path / "e")).collect() == [(0, 0, 0)]


# --- running sums and conversations --------------------------------------------------


def test_running_sums_of_a_group_with_most_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id", (F.col("id") % 7).alias("w"))
    got = running_sums(rows.repartition(6), "g", ["id"], {"places": F.lit(1), "weight": F.col("w")})
    assert got.columns == [*rows.columns, "places", "weight"]
    seen = {}
    for r in sorted(got.collect(), key=lambda r: r.id):
        n, w = seen.get(r.g, (0, 0))
        assert (r.places, r.weight) == (n, w)
        seen[r.g] = n + 1, w + r.w
    assert sum(n for n, _ in seen.values()) == 3000


def lists_by_hand(turns, chunk_bytes):
    first = lambda v: (v is not None, v)
    out = {}
    for conv in {t[0] for t in turns}:
        ahead = 0
        for _, _, role, text in sorted((t for t in turns if t[0] == conv), key=lambda t: tuple(map(first, t[1:]))):
            out.setdefault((conv, ahead // chunk_bytes), []).append((role, text))
            ahead += len((text or "").encode()) + TURN_BYTES
    return out


@pytest.mark.parametrize("chunk_bytes", [1, 700, 10**9])
def test_conversations_of_any_size(spark, chunk_bytes):
    """One conversation has a third of all turns, others one, none, repeated or null ones."""
    turns = [(1, i, "u" if i % 2 else "a", f"turn {i} " * (i % 20)) for i in range(400)]
    turns += [(2 + i // 4, i % 4, "u", "é" * (i % 9)) for i in range(800)]
    turns += [(None, 3, "u", "q"), (None, 2, "a", "p"), (-1, None, "u", "z"), (-1, 1, None, "y"), (-2, 1, "u", "dup"), (-2, 1, "u", "dup"), (-3, 0, "a", None), (-4, 0, "a", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("_group", F.lit("x")).repartition(5)
    got = {(r.conv_id, r.chunk): [tuple(m) for m in r.messages] for r in conversation_lists(df, chunk_bytes).collect()}
    assert got == lists_by_hand(turns, chunk_bytes)


def test_no_conversations(spark):
    assert conversation_lists(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# --- quantiles -----------------------------------------------------------------------

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0)


@pytest.mark.parametrize("sorted_rows", [1, 25, 4096])
def test_quantiles_of_numbers_of_any_kind(spark, sorted_rows):
    rng = np.random.default_rng(4)
    groups = {
        "wide": rng.lognormal(0, 60, 900), "signs": rng.normal(size=700) * 10.0 ** rng.integers(-200, 200, 700), "ties": rng.choice([1.0, 2.0, 3.5], 800, p=[0.7, 0.299, 0.001]),
        "one": np.array([7.25]), "two": np.array([1.0, 2.0]), "same": np.full(600, -3.0), "edge": np.append(np.full(1000, 5.0), [1.0, 9.0]), "infinite": np.array([-np.inf, 1.0, np.inf] * 60),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("nan", float("nan")), ("null", None), (None, 1.0), ("one", None), ("two", float("nan"))]
    got = {(r.k, r.share): r.value for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, x double").repartition(4), "x", "k", SHARES, sorted_rows).collect()}
    assert {k for k, _ in got} == set(groups)
    for k, values in groups.items():
        s = np.sort(values)
        for share in SHARES:
            place = (len(s) - 1) * share
            a, b = s[int(np.floor(place))], s[int(np.ceil(place))]
            want = a if a == b else a + (b - a) * (place - np.floor(place))
            assert got[k, share] == want or np.isnan(want) and np.isnan(got[k, share]), (k, share)


def test_summary_of_metrics(spark):
    rows = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 4.0), ("m", None), ("s", 5.0)], "metric string, value double")
    got = {r.metric: tuple(r)[1:] for r in quantiles.metric_summary(rows).collect()}
    assert got == {"m": (3, 2.3333, 1.5275, 1.0, 1.5, 2.0, 3.0, 4.0), "s": (1, 5.0, None, 5.0, 5.0, 5.0, 5.0, 5.0)}
    assert quantiles.metric_summary(rows.limit(0)).collect() == []


# --- joins ---------------------------------------------------------------------------


def test_keys_come_out_in_parts_of_bounded_size(spark):
    """A key with a third of the rows and one with a 300th: no part is far above a task's share."""
    n, tasks = 300_000, 1000
    rows = spark.range(0, n, 1, 16).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 300 == 1, -2).otherwise(F.col("id") % 5000).alias("k"), "id")
    weights = rows.groupBy("k").agg(F.count("*").alias("rows_of_key"))
    plan = {r.k: r._parts for r in split_plan(weights, ["k"], tasks).collect()}
    assert plan == {-1: 334, -2: 4}
    lookup = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = spread_join(rows, lookup, "k", salts=tasks, weights=weights)
    assert joined.count() == n and joined.where("v <> 2 * k").isEmpty()
    parts = F.when(F.col("k") == -1, plan[-1]).when(F.col("k") == -2, plan[-2]).otherwise(1)
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), "k", "id"), parts)
    assert rows.groupBy("k", salt).count().agg(F.max("count")).first()[0] < 1.3 * n / tasks


def test_lookup_of_few_keys_leaves_rows_out_at_the_scan(spark):
    rows = spark.range(50_000).select((F.col("id") % 5000).alias("k"), "id")
    lookup = spark.range(20).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    for how in ("inner", "left_semi"):
        got = lookup_join(rows, lookup, "k", how, limit=0, selective=True)
        assert "bitmap" in plan_of(got) and same_rows(got, rows.join(lookup, "k", how))


def test_labels_beyond_the_limit_filter_before_the_exchange(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("db_"), F.col("id") % 400).alias("db_id"), "id")
    labels = spark.range(40).select(F.concat(F.lit("db_"), "id").alias("db_id"), F.lit("train").alias("split"))
    got = attach_split(rows, labels, limit=0)
    assert same_rows(got, rows.join(labels, "db_id")) and "bitmap" in plan_of(got)


def test_prompt_datasets_read_each_source_once(spark, tmp_path):
    rows = [(f"db_{i % 30}", f"question {i}?", "SELECT 1", "spider" if i % 2 else "bird") for i in range(300)] + [("unknown", None, None, "bird")]
    spark.createDataFrame(rows, "db_id string, question string, SQL string, source string").write.parquet(str(tmp_path / "examples"))
    tables = [(f"db_{i}", [("t", ["c"])]) for i in range(40)]
    spark.createDataFrame(tables, "db_id string, schema array<struct<name:string,columns:array<string>>>").write.parquet(str(tmp_path / "catalog"))
    got = prompt_datasets(spark.read.parquet(str(tmp_path / "catalog")), spark.read.parquet(str(tmp_path / "examples")), 10, excluded=["db_3"])
    scans = [line for line in plan_of(got).splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("question" in line for line in scans) == 1 and sum("split" in line for line in scans) == 1
    found = got.collect()
    assert len({r.db_id for r in found}) == 10 and len(found) == 100 and "db_3" not in {r.db_id for r in found}
    with pytest.raises(Exception, match="null value in a merged row"):
        broken = spark.createDataFrame([("db_1", None, "SELECT 1", "bird")], "db_id string, question string, SQL string, source string")
        prompt_datasets(spark.read.parquet(str(tmp_path / "catalog")), broken, -1).collect()


# --- metrics table -------------------------------------------------------------------


def metric(spark, n, value):
    return spark.createDataFrame([(n, "loss", value), (n, "other", -value)], "step long, metric string, value double").coalesce(1)


def test_many_batches_in_few_folders(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in range(30):
        append_batch(metric(spark, n, 1.0), path, f"b{n % 20}")
        assert len(os.listdir(f"{path}/data")) <= 2 * MOST_FOLDERS + 2 < 10
    got = read_metrics(spark, path)
    assert sorted((r.batch, r.step) for r in got.where("metric = 'loss'").collect()) == sorted((f"b{n % 20}", n) for n in range(10, 30))
    assert got.count() == 40
    assert len([f for f in os.listdir(f"{path}/commits") if f.endswith(".json")]) == 2
    with pytest.raises(ValueError, match="no metrics table"):
        read_metrics(spark, str(tmp_path / "elsewhere"))


def test_of_two_writers_both_are_kept(spark, tmp_path, monkeypatch):
    """A writer whose number was taken while it wrote tries the next one."""
    from quillon.sources import metrics_table

    path = str(tmp_path / "table")
    append_batch(metric(spark, 0, 1.0), path, "first")
    seen, versions = [], metrics_table._Folder.versions

    def late(folder):
        found = versions(folder)
        if not seen:
            seen.append(1)
            append_batch(metric(spark, 1, 2.0), path, "between")
        return found

    monkeypatch.setattr(metrics_table._Folder, "versions", late)
    append_batch(metric(spark, 2, 3.0), path, "late")
    assert {r.batch for r in read_metrics(spark, path).collect()} == {"first", "between", "late"}


def test_stream_into_the_table(spark, tmp_path):
    spark.range(12).repartition(4).select(F.col("id").alias("step"), F.lit("m").alias("metric"), F.lit(0.5).alias("value")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("step long, metric string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_metrics_merged(source, str(tmp_path / "t"), str(tmp_path / "progress")).awaitTermination()
    assert sorted(r.step for r in read_metrics(spark, str(tmp_path / "t")).collect()) == list(range(12))
