"""What a task holds or reads stays bounded, and work is not done twice."""

import sqlite3

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quillon.operators import exec_check
from quillon.plans import evaluate
from quillon.sources import catalog as catalog_io
from quillon.sources import splits as split_io
from quillon.suite.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def image(*statements):
    conn = sqlite3.connect(":memory:")
    conn.executescript("PRAGMA page_size = 512; " + " ".join(statements))
    content = conn.serialize()
    conn.close()
    return content


def broken(content):
    return content[:16] + b"\xff" * 200


def test_images_come_to_python_in_small_batches(spark):
    content = image("CREATE TABLE T (A, b);")
    rows = [(f"db/x.y{i}.sqlite", broken(content) if i % 5 == 0 else content) for i in range(20)]
    scan = catalog_io.scan_images(spark.createDataFrame(rows, "path string, content binary"))
    plan = plan_of(scan.where(F.col("error").isNotNull()).select("db_id"))
    assert "InPandas" not in plan and "ArrowEvalPython" not in plan
    assert plan.count("BatchEvalPython") == 1  # the filter on what was found does not run it again
    found = {r["db_id"]: (r["schema"], r["error"]) for r in scan.collect()}
    assert set(found) == {f"x.y{i}" for i in range(20)}
    assert all((schema is None) == (i % 5 == 0) == (error is not None) for i in range(20) for schema, error in [found[f"x.y{i}"]])


def test_images_are_built_once(spark):
    for name in ("catalog_from_sqlite", "catalog_scan_errors"):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert plan.count("BatchEvalPython [image(") == 1 and plan.count("BatchEvalPython") == 2


def test_images_share_a_connection_and_nothing_else(monkeypatch):
    made, connect = [], sqlite3.connect
    # Equal numbers of statements: their schema versions are the same.
    images = [image(f"CREATE TABLE t{i} (a{i}, b);", f"CREATE TABLE u (c{i});") for i in range(20)]
    monkeypatch.setattr(catalog_io.sqlite3, "connect", lambda *a, **k: made.append(1) or connect(*a, **k))
    reader = catalog_io._ImageReader()
    for i, content in enumerate(images):
        if i == 10:
            assert reader.describe(broken(content))[0] is None
        expected = [{"name": f"t{i}", "columns": [f"a{i}", "b"]}, {"name": "u", "columns": [f"c{i}"]}]
        assert reader.describe(content) == (expected, None)
    assert len(made) == 2


RECORDS = """concat('db_', id) AS db_id, 'a' AS source, concat('SELECT ', id, chr(10), '"x"') AS solution,
    array(named_struct('role', 'user', 'content', concat('q', chr(10), id))) AS prompt,
    array(named_struct('name', 't', 'columns', array('a', 'b'))) AS schema,
    element_at(array('train', 'val', 'test'), cast(id % 3 AS int) + 1) AS split"""


def test_csv_files_are_short(spark, tmp_path):
    records = spark.sql(f"SELECT {RECORDS} FROM range(0, 300, 1, 1)")
    path = str(tmp_path / "csv")
    split_io.write_splits_csv(records, path, records_per_file=20)
    back = split_io.read_splits(spark, path, "csv")
    per_file = back.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count"), F.count("*")).first()
    assert tuple(per_file) == (20, 15)
    columns = sorted(records.columns)
    assert sorted(back.select(columns).collect()) == sorted(records.select(columns).collect())


def test_csv_files_take_little_disk(spark, tmp_path):
    content = f"concat('{'Answer with one query. ' * 40}', 'C:', chr(92), 'Users ', chr(92), 'x41 ', id)"
    records = spark.sql(f"SELECT {RECORDS.replace("concat('q', chr(10), id)", content)} FROM range(0, 3000, 1, 2)")
    path, plain = tmp_path / "csv", tmp_path / "plain"
    split_io.write_splits_csv(records, str(path))
    split_io.write_splits_csv(records, str(plain), compression="none")
    size = lambda folder: sum(f.stat().st_size for f in folder.glob("split=*/part-*"))
    assert 0 < size(path) < size(plain) / 8
    columns = sorted(records.columns)
    for folder in (path, plain):
        back = split_io.read_splits(spark, str(folder), "csv")
        assert sorted(back.select(columns).collect()) == sorted(records.select(columns).collect())


def test_writing_splits_does_not_sort_the_records(spark, tmp_path, monkeypatch):
    seen = []
    for kind in ("parquet", "csv"):
        write = getattr(DataFrameWriter, kind)
        monkeypatch.setattr(
            DataFrameWriter, kind,
            lambda self, *a, _write=write, **k: seen.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))) or _write(self, *a, **k),
        )
    records = spark.sql(f"SELECT {RECORDS} FROM range(0, 30, 1, 1)")
    split_io.write_splits(records, str(tmp_path / "parquet"))
    split_io.write_splits_csv(records, str(tmp_path / "csv"))
    split_io.write_results(records.withColumnRenamed("split", "run"), str(tmp_path / "results"))
    assert len(seen) == 3 and min(seen) >= 3
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 0
    assert split_io.read_splits(spark, str(tmp_path / "parquet")).count() == 30


CATALOG = """SELECT d AS db_id, array(named_struct('name', 't', 'columns', array('a'))) AS schema FROM VALUES ('x'), ('y') AS v(d)"""


def answers(spark, rows, kinds):
    """Answers that run or not, to a known, an unknown and no database, some without text."""
    return spark.range(0, rows, 1, 4).selectExpr(
        "id AS row_id", "element_at(array('one', 'two'), cast(id % 2 AS int) + 1) AS run", "element_at(array('s', null), cast(id % 7 % 2 AS int) + 1) AS source",
        "element_at(array('x', 'y', 'z', null), cast(id % 4 AS int) + 1) AS db_id",
        f"CASE WHEN id % 11 = 0 THEN array() ELSE array(named_struct('role', 'a', 'content', concat('SELECT ', element_at(array('a', 'b'), cast(id % 3 % 2 AS int) + 1), ' FROM t WHERE a = ', id % {kinds}, ';'))) END AS messages",
    )


def test_repeated_answers_are_scored_once(spark, monkeypatch):
    scored_rows = []
    plain = evaluate.score_with_catalog
    monkeypatch.setattr(evaluate, "score_with_catalog", lambda rows, *a, **k: scored_rows.append(rows.count()) or plain(rows, *a, **k))
    columns = ["row_id", "run", "source", "db_id", "sql", "sql_fence", "format", "exec_status", "exec", "schema_fidelity", "combined"]
    catalog = spark.sql(CATALOG)
    for kinds, most in ((3, 500), (5000, 2000)):  # the second has hardly any answer twice, and every row is scored where it is
        rows = answers(spark, 2000, kinds)
        once = evaluate.score_repeated(rows, catalog).select(columns)
        assert scored_rows.pop() <= most
        assert sorted(map(repr, once.collect())) == sorted(map(repr, plain(rows, catalog).select(columns).collect()))


def test_run_scores_score_each_answer_once(spark, monkeypatch):
    scored_rows = []
    plain = evaluate.score_with_catalog
    monkeypatch.setattr(evaluate, "score_with_catalog", lambda rows, *a, **k: scored_rows.append(rows.count()) or plain(rows, *a, **k))
    for name in ("metric_rows", "compare_runs", "write_metrics", "write_metrics_merged"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert 0 < scored_rows.pop() < 200


def test_outcomes_of_few_statements_move_no_rows(spark):
    keys = [("d", "s"), (None, "s"), ("\x00", "s"), ("a\x01b", "c"), ("a", "b\x01c"), ("d", None)]
    rows = spark.createDataFrame([(i, *keys[i % len(keys)]) for i in range(60)], "row_id int, place string, sql string")
    outcome = F.struct(F.coalesce("place", F.lit("none")).alias("status"), F.col("sql").alias("error"))
    scored = exec_check.add_exec_once(rows, outcome, ["place", "sql"])
    assert "SortMergeJoin" not in plan_of(scored) and "BroadcastHashJoin" in plan_of(scored)
    found = {(r["place"], r["sql"]): (r["exec_status"], r["exec_error"]) for r in scored.collect()}
    # Keys that only differ in null, or in where a separator stands, are statements of their own.
    assert found == {(p, s): ("no_sql", None) if s is None else ("none" if p is None else p, s) for p, s in keys}
    assert scored.count() == 60
