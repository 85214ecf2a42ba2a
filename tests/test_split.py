import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.operators import split


def merged(spark, n_a=10, n_b=10, rows_per_db=5):
    rows = [
        (f"{s}_db_{i}", s, f"q{j}")
        for s, n in (("spider", n_a), ("bird", n_b)) for i in range(n) for j in range(rows_per_db)
    ]
    return spark.createDataFrame(rows, "db_id string, source string, question string")


def by_hand(groups, size, train, val, seed, cap=False, everything=False):
    """The split of ``{group: source}``, with plain loops."""
    sources = sorted(set(groups.values()))
    total = len(groups) if size == -1 else size
    labels = {}
    for place, source in enumerate(sources):
        members = [g for g, s in groups.items() if s == source]
        members.sort(key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g))
        quota = total // len(sources) + (1 if place < total % len(sources) else 0)
        chosen = members if everything else members[:quota]
        n_train = max(1, int(len(chosen) * train))
        n_val = int(len(chosen) * val)
        n_val = max(1, min(n_val, len(chosen) - n_train) if cap else n_val)
        for i, g in enumerate(chosen):
            labels[g] = "train" if i < n_train else "val" if i < n_train + n_val else "test"
    return labels


@pytest.mark.parametrize(
    "n_a, n_b, size, train, val, cap, everything",
    [
        (10, 10, 10, 0.7, 0.15, False, False),
        (8, 8, 12, 0.6, 0.2, False, False),
        (5, 5, -1, 0.7, 0.15, False, False),
        (3, 3, 999, 0.7, 0.15, False, False),
        (10, 10, 20, 0.7, 0.15, False, False),
        (20, 4, -1, 0.7, 0.15, False, False),
        (20, 4, -1, 0.7, 0.15, False, True),
        (7, 5, 5, 0.6, 0.4, True, False),
        (1, 1, -1, 0.6, 0.4, True, False),
    ],
)
def test_split_equals_plain_loops(spark, n_a, n_b, size, train, val, cap, everything):
    rows = merged(spark, n_a, n_b)
    got = split.stratified_split(
        rows, size, train, val, seed=42, cap_val=cap, allocate="all" if everything else "even"
    )
    labels = {r["db_id"]: r["split"] for r in got.select("db_id", "split").distinct().collect()}
    groups = {r["db_id"]: r["source"] for r in rows.select("db_id", "source").distinct().collect()}
    assert labels == by_hand(groups, size, train, val, 42, cap, everything)
    assert got.count() == 5 * len(labels)
    assert split.split_overlap(got).isEmpty()


def test_split_properties(spark):
    rows = merged(spark)
    first = split.stratified_split(rows, 10, seed=42)
    again = split.stratified_split(rows.repartition(7), 10, seed=42)
    assert first.exceptAll(again).isEmpty()
    other = split.stratified_split(rows, 10, seed=43)
    assert not first.exceptAll(other).isEmpty()
    profile = {(r["split"], r["source"]): r for r in split.split_profile(first).collect()}
    assert {s for p, s in profile if p == "train"} == {"spider", "bird"}
    assert profile[("train", "bird")]["groups"] == 3 and profile[("train", "bird")]["rows"] == 15
    with pytest.raises(ValueError):
        split.stratified_split(rows, -2)


def test_first_source_of_a_group(spark):
    rows = spark.createDataFrame(
        [("x", "b", 2), ("x", "a", 3), ("y", "b", 1), ("x", "c", 1)], "db_id string, source string, place int"
    )
    by_place = {r[0]: r[1] for r in split.group_frame(rows, order="place").select("db_id", "source").collect()}
    assert by_place == {"x": "c", "y": "b"}
    assert {r[1] for r in split.group_frame(rows).select("db_id", "source").collect()} == {"a", "b"}


def test_hot_group_keeps_all_rows(spark):
    """One database holds a third of the rows, and they are exact copies."""
    rows = merged(spark, 6, 6, 40).unionByName(
        spark.range(0, 300, 1, 9).select(
            F.lit("spider_db_0").alias("db_id"), F.lit("spider").alias("source"), F.lit("q0").alias("question")
        )
    )
    got = split.stratified_split(rows, -1)
    assert got.count() == rows.count()
    assert got.where("db_id = 'spider_db_0'").select("split").distinct().count() == 1


def test_ranks_are_one_sequence_per_source(spark):
    groups = spark.range(3000).select(
        F.concat(F.lit("g"), "id").alias("db_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source")
    )
    ranked = split.rank_in_source(groups, 1)
    sums = ranked.groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.max("position").alias("m")
    )
    assert {(r["n"], r["d"], r["m"]) for r in sums.collect()} == {(1000,) * 3, (2000,) * 3}


def test_quick_sample(spark):
    rows = split.stratified_split(merged(spark), -1)
    got = split.quick_sample(rows, ["db_id", "question"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 10, "val": 5}
