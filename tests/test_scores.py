import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.fixed_values import BUILT_IN_WEIGHTS
from quillon.functions.schema_text import SCHEMA_TYPE
from quillon.operators import exec_check, scoring
from quillon.plans.evaluate import score_with_catalog
from quillon.suite import golden, views

SF = "/root/testdata/sf0.001"


def answers(spark, *texts, schema=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, answer string")
    if schema is not None:
        df = df.withColumn("schema", F.from_json(F.lit(schema), SCHEMA_TYPE))
    return df


def scores(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def test_golden_vectors(spark):
    rows = score_with_catalog(views.completions(spark, SF), views.table_catalog(spark, SF))
    got = rows.select(
        "k", "sql_fence", "format", "exec", F.round("schema_fidelity", 4), "combined"
    ).distinct().collect()
    assert {r[0]: tuple(r[1:]) for r in got} == dict(enumerate(golden.EXPECTED))
    assert len(got) == 16


REFERENCES = {
    "SELECT p.title, SUM(s.seats) AS sold FROM play p JOIN sale s ON p.play_no = s.play_no GROUP BY p.play_no, p.title "
    "HAVING SUM(s.seats) > 200 ORDER BY sold;": ({"play", "sale"}, {"title", "seats", "play_no", "sold"}),
    "SELECT x FROM a, b AS c, d e WHERE f(x, y) = 1": ({"a", "b", "d"}, {"x", "y"}),
    "SELECT q FROM (SELECT a FROM t) s WHERE id IN (c1, c2)": ({"t"}, {"q", "a", "id", "c1", "c2"}),
    "SELECT a FROM t WHERE x IN (SELECT y FROM u, v) AND b = 1, w": ({"t", "u", "v"}, {"a", "x", "y", "b", "w"}),
    "WITH c AS (SELECT a FROM t) SELECT * FROM c": ({"t", "c"}, {"a"}),
    'SELECT "My Col", `other` FROM "My Table" -- FROM x\n': ({"my table"}, {"my col", "other"}),
    "SELECT t.* FROM main.t": ({"t"}, {"*"}),
    "SELECT CASE WHEN a = 'from b' THEN 1 ELSE 2 END z FROM t /* , u": ({"t"}, {"a"}),
    "UPDATE t SET a = 1, b = c": ({"t"}, {"a", "b", "c"}),
    "SELECT 'x' label, 1 one FROM t": ({"t"}, set()),
    "SELECT CAST(a AS INTEGER) FROM T": ({"t"}, {"a"}),
    "SELECT 'open FROM t": (set(), set()),
    "SELECT a FROM t ORDER BY b LIMIT 1": ({"t"}, {"a", "b"}),
    "SELECT a FROM (t JOIN u ON t.k = u.k) WHERE b > 1": ({"t", "u"}, {"a", "k", "b"}),
    "SELECT a FROM ((t JOIN u USING (k)), v) x, w": ({"t", "u", "v", "w"}, {"a", "k"}),
    "SELECT a FROM t ORDER BY a COLLATE NOCASE, b": ({"t"}, {"a", "b"}),
    "SELECT a FROM t WHERE a IS DISTINCT FROM b AND c IS NOT DISTINCT FROM d": ({"t"}, {"a", "b", "c", "d"}),
    "SELECT sum(a) OVER w, rank() OVER (w ORDER BY b) FROM t WINDOW w AS (PARTITION BY c), v AS (w ORDER BY d "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES)": ({"t"}, {"a", "b", "c", "d"}),
    "SELECT EXTRACT(year FROM d), extract(month FROM t.e), extract FROM t": ({"t"}, {"d", "e", "extract"}),
    "SELECT substring(s FROM 2 FOR 3), trim(BOTH 'x' FROM r), trim(leading), position(p IN q) FROM t, u":
        ({"t", "u"}, {"s", "r", "leading", "p", "q"}),
    "WITH r(n, m) AS (SELECT a, b FROM t), q AS MATERIALIZED (SELECT n FROM r) SELECT m FROM r, q":
        ({"t", "r", "q"}, {"a", "b", "n", "m"}),
    "INSERT INTO t (a, b) SELECT c, d FROM u": ({"t", "u"}, {"c", "d"}),
    "SELECT x.a FROM (VALUES (1, 2)) AS x(a, b) JOIN f(c) y ON x.a = y.d, db.s.z": ({"z"}, {"a", "c", "d"}),
    "SELECT count(*) FILTER (WHERE a > 1), string_agg(b, ',' ORDER BY c), date '2020-01-01', interval '1' day, date FROM t":
        ({"t"}, {"a", "b", "c", "date"}),
    "SELECT a, (SELECT max(b) FROM u WHERE u.k = t.k) m FROM t WHERE EXISTS (SELECT 1 FROM v) AND (c, d) IN (SELECT e, f FROM (w))":
        ({"t", "u", "v", "w"}, {"a", "b", "k", "c", "d", "e", "f"}),
    "DELETE FROM t WHERE a = (b + (c * (d)))": ({"t"}, {"a", "b", "c", "d"}),
    "SELECT a FROM t1 x(p, q) LEFT JOIN lt ON lower(x.p) = lower(b)": ({"t1", "lt"}, {"a", "p", "b"}),
    "SELECT DISTINCT a FROM t; SELECT b FROM u": ({"t", "u"}, {"a", "b"}),
    "SELECT ) a, b FROM t) , u": ({"t"}, {"b", "u"}),
    "": (set(), set()),
}


def test_references(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(REFERENCES)], "i int, sql string")
    rows = scoring.add_refs(scoring.add_format(df)).orderBy("i").collect()
    got = {r["sql"]: (set(r["ref_tables"]), set(r["ref_columns"])) for r in rows}
    assert got == REFERENCES


@pytest.mark.parametrize("n", [3, 3000])
def test_references_of_long_and_deep_statements(spark, n):
    names = [f"c{k}" for k in range(n)]
    wide = "SELECT " + ", ".join(f"f({c}, ({c}))" for c in names) + " FROM " + ", ".join(f"(t{k})" for k in range(n))
    deep = "SELECT " + "(" * n + "a" + ")" * n + " FROM " + "(" * n + "t" + ")" * n + " JOIN u"
    df = spark.createDataFrame([(0, wide), (1, deep)], "i int, sql string")
    one, two = scoring.add_refs(scoring.add_format(df)).orderBy("i").collect()
    assert one.ref_columns == names and one.ref_tables == [f"t{k}" for k in range(n)]
    assert (two.ref_columns, two.ref_tables) == (["a"], ["t", "u"])


def test_fence_and_format(spark):
    df = answers(spark, "```sql\nSELECT depth FROM lake;\n```", "No table fits this question.", "SELECT 7 * 6;")
    scored = scoring.add_format(scoring.add_fence(scoring.add_sql(df)))
    assert scores(scored, "format") == [1.0, 0.0, 1.0]
    assert scores(scored, "sql_fence") == [1.0, 0.0, 0.0]


USERS = '[{"name": "Users", "columns": ["ID", "name"]}]'


def fidelity_of(df, penalty=0.0):
    refs = scoring.add_refs(scoring.add_format(scoring.add_sql(df)))
    return scores(scoring.add_fidelity(refs, penalty), "schema_fidelity")


def test_fidelity(spark):
    good, half, none = "```sql\nSELECT id, name FROM users;\n```", "SELECT id, ghost FROM users, spirits;", "no sql here"
    assert fidelity_of(answers(spark, good, half, none, "SELECT 1", schema=USERS)) == [1.0, 0.5, 0.0, 0.5]
    assert fidelity_of(answers(spark, half, schema=USERS), -0.3) == [0.5 + -0.3 * 0.5]
    assert fidelity_of(answers(spark, good, none)) == [0.5, 0.0]
    assert fidelity_of(answers(spark, good, schema="[]")) == [0.5]


@pytest.fixture()
def database_root(tmp_path):
    for source_path, db_id in (("spider/spider_data/database", "demo"), ("bird/dev_databases", "other db")):
        folder = tmp_path / source_path / db_id
        folder.mkdir(parents=True)
        conn = sqlite3.connect(folder / f"{db_id}.sqlite")
        conn.execute("CREATE TABLE t (val VARCHAR, weight REAL)")
        conn.execute("INSERT INTO t SELECT 'pebble', 0.25")
        conn.commit()
        conn.close()
    return tmp_path


FILE_CASES = [
    ("SELECT * FROM t", "spider", "demo", "ok"),
    ("SELECT * FROM t", "bird", "other db", "ok"),
    ("INSERT INTO t (val) SELECT val || '!' FROM t", "spider", "demo", "error"),
    ("SELECT t.colour FROM t", "spider", "demo", "error"),
    ("PRAGMA query_only = OFF", "spider", "demo", "ok"),
    ("DELETE FROM t", "spider", "demo", "error"),
    ("ATTACH '/tmp/never.sqlite' AS x", "spider", "demo", "error"),
    ("SELECT 1; SELECT 2", "spider", "demo", "error"),
    ("SELECT ?", "spider", "demo", "error"),
    ("-- only a remark", "spider", "demo", "ok"),
    ("SELECT * FROM t", "spider", "missing", "no_database"),
    ("SELECT * FROM t", "elsewhere", "demo", "no_database"),
    ("SELECT * FROM t", "spider", None, "no_database"),
    (None, "spider", "demo", "no_sql"),
    ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT sum(n) FROM r", "spider", "demo", "timeout"),
]


def test_exec_on_files(spark, database_root):
    df = spark.createDataFrame(
        [(i, *c[:3]) for i, c in enumerate(FILE_CASES)], "i int, sql string, source string, db_id string"
    ).coalesce(1)
    outcome = exec_check.exec_outcome_files(
        F.col("sql"), F.col("source"), F.col("db_id"), str(database_root), budget=2_000_000
    )
    rows = exec_check.add_exec(df, outcome, -1.0).orderBy("i").collect()
    assert [r["exec_status"] for r in rows] == [c[3] for c in FILE_CASES]
    assert [r["exec"] for r in rows] == [
        {"ok": 1.0, "no_sql": -1.0}.get(c[3], 0.0) for c in FILE_CASES
    ]
    conn = sqlite3.connect(database_root / "spider/spider_data/database/demo/demo.sqlite")
    assert conn.execute("SELECT * FROM t").fetchall() == [("pebble", 0.25)]


def test_exec_once_equals_exec(spark, database_root):
    df = spark.createDataFrame(
        [(i % 7 + i // 100, *c[:3]) for i, c in enumerate(FILE_CASES[:-1] * 40)],
        "i int, sql string, source string, db_id string",
    ).repartition(6)
    outcome = exec_check.exec_outcome_files(F.col("sql"), F.col("source"), F.col("db_id"), str(database_root))
    keys = ["i", "sql", "source", "db_id", "exec_status", "exec"]
    direct = exec_check.add_exec(df, outcome).select(*keys)
    once = exec_check.add_exec_once(df, outcome, ["source", "db_id", "sql"]).select(*keys)
    assert direct.exceptAll(once).isEmpty() and once.exceptAll(direct).isEmpty()


def test_exec_catalog_backend_changes_nothing_between_statements(spark):
    statements = ["CREATE TEMP TABLE z (a)", "SELECT a FROM z", "BEGIN", "SELECT id FROM users", "SELECT 1 FROM ghosts"]
    df = answers(spark, *[f"```sql\n{s}\n```" for s in statements], schema=USERS).coalesce(1)
    rows = scoring.score_completions(df, completion="answer").orderBy("i").collect()
    assert rows[1]["exec_status"] == "error" and rows[3]["exec_status"] == "ok" and rows[4]["exec"] == 0.0


def test_score_completions_on_files(spark, database_root):
    df = spark.createDataFrame([(0, "```sql\nSELECT val FROM t\n```", "spider", "demo")],
                               "i int, completion string, source string, db_id string")
    row = scoring.score_completions(
        df, backend="files", database_root=str(database_root), completion="completion"
    ).first()
    assert (row["exec"], row["schema_fidelity"], row["combined"]) == (1.0, 0.5, 0.85)


def test_weights(spark):
    only_format = {"format": 1.0, "exec": 0.0, "schema_fidelity": 0.0, "sql_fence": 0.0}
    df = answers(spark, "```sql\nSELECT 1;\n```", "no sql")
    assert scores(scoring.score_answers(df, only_format), "combined") == [1.0, 0.0]
    built_in = scores(scoring.score_answers(df, BUILT_IN_WEIGHTS), "combined")
    assert built_in == [0.15 + 0.125 + 0.1, -1.0]
    without_fence = {"format": 0.5, "exec": 0.25, "schema_fidelity": 0.25}
    assert scores(scoring.score_answers(df, without_fence), "combined") == [0.625, -0.5]
    assert scores(scoring.score_answers(df, {}), "combined") == [0.45, -0.4]
    with pytest.raises(ValueError):
        scoring.resolve_weights({"format": 1.0})


def test_unknown_choices_are_refused(spark):
    df = answers(spark, "x", schema=USERS)
    for options in ({"dialect": "postgres"}, {"backend": "files"}, {"backend": "elsewhere"}):
        with pytest.raises(ValueError):
            scoring.score_completions(df, completion="answer", **options)


def test_custom_scorers(spark):
    @F.pandas_udf("double")
    def shouting(texts: pd.Series) -> pd.Series:
        return texts.str.isupper().astype("float64")

    registry = scoring.ScorerRegistry().add("loud", lambda df: shouting(F.col("answer")), 0.75)
    registry.add("has_sql", lambda df: F.col("sql").isNotNull(), 0.25)
    scored = registry.score(scoring.add_sql(answers(spark, "SELECT A;", "select a;", "hello")))
    assert scores(scored, "combined") == [1.0, 0.25, 0.0]


def test_scores_do_not_depend_on_partitions(spark):
    rows = views.completions(spark, SF)
    catalog = views.table_catalog(spark, SF)
    columns = ["row_id", "combined"]
    one = score_with_catalog(rows.repartition(1), catalog).select(*columns)
    many = score_with_catalog(rows.repartition(13), catalog).select(*columns)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_filter_on_a_score_runs_the_sql_once(spark):
    rows = scoring.score_completions(
        views.completions(spark, SF).withColumn("schema", F.from_json(F.lit(USERS), SCHEMA_TYPE))
    ).where("combined < 0.5 and row_id > 10")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "GreaterThan(o_orderkey,10)" in plan


def test_weights_from_config():
    config = {"format_reward": 0.2, "exec_reward": 0.4, "schema_fidelity_reward": 0.3, "sql_fence_reward": 0.1}
    assert scoring.weights_from_config(config, -1.0) == {
        "format": 0.2, "exec": 0.4, "schema_fidelity": 0.3, "sql_fence": 0.1, "no_sql_penalty": -1.0,
        "unknown_schema_item_penalty": 0.0,
    }
    assert scoring.weights_from_config({}) == BUILT_IN_WEIGHTS


def test_recorded_outcomes(spark):
    df = answers(spark, "```sql\nSELECT 1\n```", "```sql\nSELECT 2\n```", "none", "```sql\nSELECT 1\n```", "```sql\nSELECT 1\n```").withColumn(
        "db_id", F.when(F.col("i") == 3, "other").when(F.col("i") < 4, "d")
    )
    outcomes = spark.createDataFrame(
        [("d", "SELECT 1", "ok"), ("d", "SELECT 1", "error"), ("other", "SELECT 1", "error"), (None, "SELECT 1", "ok"), ("d", None, "ok")],
        "db_id string, sql string, exec_status string",
    )
    scored = scoring.score_completions(df, completion="answer", outcomes=outcomes)
    assert scores(scored, "exec_status") == ["ok", "not_run", "no_sql", "error", "not_run"]
    assert scores(scored, "exec") == [1.0, 0.0, -1.0, 0.0, 0.0]
    none = scoring.score_completions(df, completion="answer", outcomes=outcomes.limit(0))
    assert scores(none, "exec_status") == ["not_run", "not_run", "no_sql", "not_run", "not_run"]
