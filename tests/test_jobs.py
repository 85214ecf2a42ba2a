import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.functions.schema_text import SCHEMA_TYPE
from quillon.operators.checks import require_valid
from quillon.plans.evaluate import evaluate
from quillon.plans.prepare import prepare
from quillon.sources.splits import read_splits
from quillon.streaming import append_metrics, append_to, metrics_stream, score_stream


@pytest.fixture()
def raw_folder(tmp_path):
    root = tmp_path / "raw"
    for i in range(6):
        folder = root / "spider/spider_data/database" / f"s{i}"
        folder.mkdir(parents=True)
        conn = sqlite3.connect(folder / f"s{i}.sqlite")
        conn.execute(f"CREATE TABLE T{i} (Id INTEGER, Name TEXT)")
        conn.commit()
        conn.close()
    a = [{"db_id": f"s{i % 7}", "question": f"Question {i}", "query": f"SELECT {i}", "sql": {}} for i in range(42)]
    (root / "spider/spider_data/dev.json").write_text(json.dumps(a))
    bird = root / "bird/dev_20240627"
    bird.mkdir(parents=True)
    lists = [
        {"db_id": d, "table_names_original": ["U"], "column_names_original": [[-1, "*"], [0, "Col"]]}
        for d in ("b0", "b1", "b2", "b3", "b4", "b5", "european_football_2")
    ]
    (bird / "dev_tables.json").write_text(json.dumps(lists))
    b = [{"db_id": lists[i % 7]["db_id"], "question": f"Q {i}?", "SQL": f"SELECT {i}", "evidence": ""} for i in range(35)]
    (bird / "dev.json").write_text(json.dumps(b))
    return root


def test_prepare(spark, raw_folder, tmp_path):
    written = prepare(
        spark, str(raw_folder), str(tmp_path / "catalog"), str(tmp_path / "splits"), sample_size=-1,
        csv_path=str(tmp_path / "csv"),
    )
    # 6 of 7 databases per source have a schema or are not excluded.
    assert written.count() == 36 + 30
    assert require_valid(written, "all") == 66
    sizes = {r[0]: r[1] for r in written.groupBy("split").agg(F.count_distinct("db_id")).collect()}
    assert sizes == {"train": 8, "val": 2, "test": 2}
    row = written.where("solution = 'SELECT 0' and source = 'spider'").first()
    assert row["prompt"][1]["content"] == "### Question\nQuestion 0?\n### Schema\n{'t0': ['id', 'name']}"
    csv = read_splits(spark, str(tmp_path / "csv"), "csv").select(*written.columns)
    assert csv.exceptAll(written).isEmpty()
    again = prepare(spark, str(raw_folder), str(tmp_path / "catalog"), str(tmp_path / "again"), -1, skip_catalog=True)
    assert again.exceptAll(written).isEmpty()


def completions(spark):
    rows = [
        (i, run, source, f"d{i % 3}", "```sql\nSELECT c FROM t\n```" if (i + len(run)) % 3 else "I cannot.")
        for i in range(60) for run in ("baseline", "tuned") for source in ("spider", "bird")
    ]
    df = spark.createDataFrame(rows, "row_id int, run string, source string, db_id string, completion string")
    return df.withColumn("schema", F.from_json(F.lit('[{"name": "t", "columns": ["c"]}]'), SCHEMA_TYPE))


def test_evaluate(spark, tmp_path):
    compared = evaluate(
        completions(spark), str(tmp_path / "results"), str(tmp_path / "metrics"), completion="completion"
    ).collect()
    assert {r["source"] for r in compared} == {"spider", "bird", "avg"}
    assert all(r["baseline_mean"] == pytest.approx((40 - 20 * 0.4) / 60, abs=1e-4) for r in compared)
    results = spark.read.parquet(str(tmp_path / "results"))
    assert results.count() == 240 and "schema" in results.columns
    assert {r["metric"] for r in spark.read.parquet(str(tmp_path / "metrics")).collect()} == {
        f"{run}_reward_{s}" for run in ("baseline", "tuned") for s in ("spider", "bird", "avg")
    }


def test_evaluate_again_replaces_its_own_runs(spark, tmp_path):
    paths = str(tmp_path / "results"), str(tmp_path / "metrics")
    rows = completions(spark)
    evaluate(rows, *paths, completion="completion")
    before = sorted(tuple(r) for r in spark.read.parquet(paths[1]).collect())
    compared = evaluate(rows.where("run = 'tuned'"), *paths, completion="completion")
    assert all(r["baseline_mean"] is None for r in compared.collect())
    assert sorted(tuple(r) for r in spark.read.parquet(paths[1]).collect()) == before


def test_streams_equal_batches(spark, tmp_path):
    from quillon.operators.reports import flatten_metrics
    from quillon.operators.scoring import score_completions

    rows = completions(spark).repartition(4)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    columns = ["row_id", "run", "source", "combined"]
    scored = score_stream(stream, completion="completion").select(*columns)
    append_to(scored, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = score_completions(rows, completion="completion").select(*columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

    log = spark.range(20).select(
        F.col("id").alias("step"), F.format_string('{"reward": %d, "up": true, "note": "x"}', "id").alias("logs")
    )
    log.write.json(str(tmp_path / "log"))
    metrics = metrics_stream(spark.readStream.schema(log.schema).json(str(tmp_path / "log")))
    append_metrics(metrics, str(tmp_path / "table"), str(tmp_path / "metric-progress")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "table")).drop("batch")
    assert table.count() == 40 and table.exceptAll(flatten_metrics(log)).isEmpty()
