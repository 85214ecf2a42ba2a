import ast
import csv
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.operators import checks, examples
from quillon.operators.catalog import merge_catalogs, nested_catalog, schema_columns
from quillon.sources import catalog as catalog_io
from quillon.sources import examples as example_io
from quillon.sources import splits as split_io


def plain(catalog):
    return {
        r["db_id"]: {t["name"]: t["columns"] for t in r["schema"]} for r in catalog.collect()
    }


TABLE_LIST = [
    {
        "db_id": "shop",
        "table_names_original": ["Users", "Empty", "USERS"],
        "column_names_original": [[-1, "*"], [0, "ID"], [0, "Name"], [2, "Extra"]],
        "table_names": ["ignored"],
        "column_names": [[0, "ignored"]],
    },
    {"db_id": "plain", "table_names": ["T"], "column_names": [[-1, "*"], [0, "A b"]]},
]
SHOP = {"users": ["id", "name", "extra"], "empty": []}


def test_tables_json(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps(TABLE_LIST, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in TABLE_LIST))
    for name, lines in (("array.json", False), ("lines.json", True)):
        got = plain(catalog_io.read_tables_json(spark, str(tmp_path / name), lines))
        assert got == {"shop": SHOP, "plain": {"t": ["a b"]}}


def make_database(path, *ddl):
    path.parent.mkdir(parents=True, exist_ok=True)
    conn = sqlite3.connect(path)
    for statement in ddl:
        conn.execute(statement)
    conn.commit()
    conn.close()


@pytest.fixture()
def raw_folder(tmp_path):
    root = tmp_path / "raw data"
    make_database(root / "one" / "Alpha.SQLITE", "CREATE TABLE Big (Id INTEGER, \"we\"\"ird\" TEXT)", "CREATE TABLE b (x)")
    make_database(root / "two" / "shop.db", "CREATE TABLE scanned (x)")
    make_database(root / "__MACOSX" / "hidden.db", "CREATE TABLE t (x)")
    make_database(root / "two" / "._fork.db", "CREATE TABLE t (x)")
    make_database(root / "two" / "other.txt", "CREATE TABLE t (x)")
    (root / "two" / "text.sqlite").write_text("no database at all")
    (root / "two" / "broken.sqlite3").write_bytes(b"SQLite format 3\x00" + b"\xff" * 200)
    (root / "a").mkdir()
    (root / "a" / "dev_tables.json").write_text(json.dumps(TABLE_LIST))
    (root / "b").mkdir()
    later = [{"db_id": "plain", "table_names": ["later"], "column_names": [[0, "z"]]}]
    (root / "b" / "dev_tables.json").write_text(json.dumps(later))
    return root


ALPHA = {"big": ["id", 'we"ird'], "b": ["x"]}


@pytest.mark.parametrize("mounted", [True, False])
def test_sqlite_scan(spark, raw_folder, mounted):
    rows = catalog_io.scan_sqlite_folder(spark, str(raw_folder), mounted).collect()
    assert {r["db_id"] for r in rows} == {"Alpha", "shop", "broken"}
    assert [r["db_id"] for r in rows if r["error"]] == ["broken"]
    alpha = next(r for r in rows if r["db_id"] == "Alpha")
    assert {t["name"]: t["columns"] for t in alpha["schema"]} == ALPHA


def test_build_catalog_precedence(spark, raw_folder):
    got = plain(catalog_io.build_catalog(spark, str(raw_folder)))
    assert got == {"shop": SHOP, "plain": {"later": ["z"]}, "Alpha": ALPHA}


def test_merge_prefers_first_scan(spark):
    kind = "db_id string, schema array<struct<name:string,columns:array<string>>>, ordinal string"
    scanned = spark.createDataFrame([("x", [("late", [])], "b"), ("x", [("early", [])], "a")], kind)
    listed = spark.createDataFrame([], kind)
    assert plain(merge_catalogs(listed, scanned)) == {"x": {"early": []}}


def test_catalog_files(spark, tmp_path):
    schemas = {"b": {"t": ["x", "y"], "a": []}, "a": {"u": ["z"]}}
    (tmp_path / "array.json").write_text(json.dumps([{"db_id": d, "schema": s} for d, s in schemas.items()], indent=2))
    (tmp_path / "dict.json").write_text(json.dumps(schemas, indent=2))
    array = catalog_io.load_catalog(spark, str(tmp_path / "array.json"), "array")
    assert plain(array) == plain(catalog_io.load_catalog(spark, str(tmp_path / "dict.json"), "dict")) == schemas
    catalog_io.write_catalog(array, str(tmp_path / "written"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "written")).collect()]
    assert lines == [{"db_id": d, "schema": schemas[d]} for d in ("a", "b")]
    assert [t["name"] for t in array.where("db_id = 'b'").first()["schema"]] == ["t", "a"]
    assert plain(catalog_io.load_catalog_if_present(spark, str(tmp_path / "written"))) == schemas
    assert catalog_io.load_catalog_if_present(spark, str(tmp_path / "absent")).isEmpty()
    assert plain(nested_catalog(schema_columns(array).where("col_pos is not null"))) == {
        "b": {"t": ["x", "y"]}, "a": {"u": ["z"]}
    }
    with pytest.raises(ValueError):
        catalog_io.load_catalog(spark, str(tmp_path / "dict.json"), "yaml")


EXAMPLES_A = [
    {"db_id": "x", "question": " How many", "query": "SELECT 1", "sql": {"from": {}}, "query_toks": ["SELECT"]},
    {"db_id": "x", "question": "How many?", "query": "SELECT 1", "sql": {}, "question_toks": ["How"]},
    {"db_id": "y", "question": "Who?", "query": "SELECT 2", "sql": {}, "query_toks_no_value": []},
]
EXAMPLES_B = [{"db_id": "z", "question": "Why", "SQL": "SELECT 3", "evidence": "e", "difficulty": "hard", "question_id": 7}]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("db_id", "question", "SQL", "source").collect())


def test_example_readers(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps(EXAMPLES_A))
    b.write_text(json.dumps(EXAMPLES_B * 2))
    assert rows_of(example_io.load_examples_a(spark, str(a))) == [
        ("x", "How many?", "SELECT 1", "spider"), ("y", "Who?", "SELECT 2", "spider"),
    ]
    got = example_io.load_examples_b(spark, [str(b), str(tmp_path / "absent.json")])
    assert rows_of(got) == [("z", "Why?", "SELECT 3", "bird")]
    with pytest.raises(FileNotFoundError):
        example_io.load_examples_b(spark, [str(tmp_path / "absent.json")])


def test_noise_is_dropped_by_exact_spelling(spark):
    raw = spark.createDataFrame([("x", "q", "SELECT 1", "tree")], "db_id string, question string, SQL string, t string")
    both = raw.toDF("db_id", "question", "SQL", "sql")
    assert rows_of(examples.normalise_examples_a(both)) == [("x", "q?", "SELECT 1", "spider")]


def test_merge_guard(spark):
    catalog = spark.createDataFrame(
        [("x", [("t", ["c"])])], "db_id string, schema array<struct<name:string,columns:array<string>>>"
    )
    kind = "db_id string, question string, SQL string"
    good = spark.createDataFrame([("x", "q", "s"), ("unknown", "q", "s")], kind)
    assert examples.merge_examples_with_schemas(catalog, good).count() == 1
    bad = spark.createDataFrame([("x", "q", None)], kind)
    with pytest.raises(Exception, match="null value"):
        examples.merge_examples_with_schemas(catalog, bad).collect()
    with pytest.raises(Exception, match="null value"):
        examples.merge_examples_with_schemas(catalog, bad).count()
    assert examples.merge_examples_with_schemas(catalog, bad, guard=False).collect()[0]["SQL"] is None


def test_exclusion_keeps_nulls(spark):
    df = spark.createDataFrame([("european_football_2",), ("x",), (None,)], "db_id string")
    assert {r[0] for r in examples.exclude_groups(df).collect()} == {"x", None}
    assert {r[0] for r in examples.exclude_groups(df, df.where("db_id = 'x'")).collect()} == {
        "european_football_2", None
    }
    assert examples.exclude_groups(df, []).count() == 3


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, None)], "a int, b string")
    assert examples.dedupe_examples(df).count() == 3
    assert examples.duplicate_count(df).first()[0] == 1
    assert examples.column_counts(df).first().asDict() == {"a": 3, "b": 1}


RECORD_KIND = (
    "prompt array<struct<role:string,content:string>>, solution string, "
    "schema array<struct<name:string,columns:array<string>>>, source string, db_id string, split string"
)


def records(spark, source="spider", solution="SELECT \"a\",\n'b'"):
    prompt = [("system", "line\nbreak"), ("user", "quote \" comma , backslash \\ end")]
    return spark.createDataFrame([(prompt, solution, [("t", ["x"])], source, "1", "train")], RECORD_KIND)


def test_split_files_round_trip(spark, tmp_path):
    df = records(spark)
    split_io.write_splits(df, str(tmp_path / "p"))
    split_io.write_splits_csv(df, str(tmp_path / "c"))
    for path, kind in (("p", "parquet"), ("c", "csv")):
        back = split_io.read_splits(spark, str(tmp_path / path), kind)
        assert back.select(*df.columns).collect() == df.collect()
        assert dict(back.dtypes)["db_id"] == "string"
    pruned = split_io.read_splits(spark, str(tmp_path / "p")).where("split = 'train'")
    assert "PartitionFilters: [isnotnull(split" in pruned._jdf.queryExecution().executedPlan().toString()
    spark.range(1).write.parquet(str(tmp_path / "n"))
    with pytest.raises(ValueError):
        split_io.read_splits(spark, str(tmp_path / "n"))


LITERAL_SCHEMA = {"it's": ['say "x"', "plain"], "both ' and \"": ["back\\slash", "line\nbreak"], "nbsp\xa0": ["\\x41"], "none": []}


def write_literal_csv(path, prompt, schema):
    path.mkdir(parents=True)
    with open(path / "part.csv", "w", newline="", encoding="utf-8") as handle:
        writer = csv.writer(handle)
        writer.writerow(["prompt", "solution", "schema", "source", "db_id"])
        writer.writerow([prompt, "SELECT 'a'", schema, "spider", "1"])


def test_csv_of_python_literals(spark, tmp_path):
    prompt = [{"role": "user", "content": "it's \"so\"\n\\ end\xa0"}]
    write_literal_csv(tmp_path / "c" / "split=train", repr(prompt), repr(LITERAL_SCHEMA))
    row = split_io.read_splits(spark, str(tmp_path / "c"), "csv").first()
    assert [m.asDict() for m in row["prompt"]] == prompt
    assert {t["name"]: t["columns"] for t in row["schema"]} == LITERAL_SCHEMA
    for i, text in enumerate(("{'t': ['a'", "['a'", r"{'\U000e0001': []}")):
        write_literal_csv(tmp_path / f"bad{i}" / "split=train", repr(prompt), text)
        with pytest.raises(Exception, match="MALFORMED_RECORD|cannot decode"):
            split_io.read_splits(spark, str(tmp_path / f"bad{i}"), "csv").collect()


def test_csv_with_named_tables_is_python_literals(spark, tmp_path):
    schema = [(name, columns) for name, columns in LITERAL_SCHEMA.items()]
    df = records(spark).withColumn("schema", F.lit(None).cast("array<struct<name:string,columns:array<string>>>"))
    df = spark.createDataFrame([(*r[:2], schema, *r[3:]) for r in df.collect()], RECORD_KIND)
    split_io.write_splits_csv(df, str(tmp_path / "c"), named_tables=True)
    assert split_io.read_splits(spark, str(tmp_path / "c"), "csv").select(*df.columns).collect() == df.collect()
    with open(next((tmp_path / "c" / "split=train").glob("*.csv")), newline="", encoding="utf-8") as handle:
        row = next(csv.DictReader(handle))
    assert ast.literal_eval(row["schema"]) == LITERAL_SCHEMA
    assert [m["role"] for m in ast.literal_eval(row["prompt"])] == ["system", "user"]


def test_validation(spark):
    assert checks.require_valid(records(spark), "train") == 1
    with pytest.raises(ValueError, match="unknown source: 1"):
        checks.require_valid(records(spark, source="elsewhere"), "train")
    with pytest.raises(ValueError, match="solution"):
        checks.require_valid(records(spark, solution=None), "train")
    with pytest.raises(ValueError, match="missing columns"):
        checks.validate_split(records(spark).drop("prompt"), "train")
    assert checks.unknown_sources(records(spark, source="elsewhere")).collect() == [("elsewhere", 1)]


def test_metrics_table_grows(spark, tmp_path):
    rows = spark.range(2).select(F.col("id").alias("step"), F.lit("loss").alias("metric"), F.lit(0.5).alias("value"))
    for batch in (None, None, "x", "x"):
        split_io.write_metrics(rows, str(tmp_path / "m"), batch)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 6


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    for run, n in (("baseline", 2), ("tuned", 3), ("tuned", 1)):
        split_io.write_results(spark.range(n).withColumn("run", F.lit(run)), str(tmp_path / "r"))
    counts = spark.read.parquet(str(tmp_path / "r")).groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in counts} == {"baseline": 2, "tuned": 1}


def test_a_later_record_of_a_file_wins(spark, tmp_path):
    record = lambda table: {"db_id": "d", "table_names_original": [table], "column_names_original": [[-1, "*"], [0, "c"]]}
    names = [f"t{k}" for k in range(40)]
    (tmp_path / "dev_tables.json").write_text(json.dumps([record(n) for n in names]))
    listed = catalog_io.read_listed_catalogs(spark, str(tmp_path))
    none = listed.limit(0).withColumn("ordinal", F.lit("x"))
    assert [t["name"] for t in merge_catalogs(listed, none).first()["schema"]] == ["t39"]
