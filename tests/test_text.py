import ast
import re

import pytest
from pyspark.sql import functions as F

from quillon.fixed_values import REPAIR_WORDS, SHORT_SYSTEM_PROMPT, SYSTEM_PROMPT
from quillon.functions import schema_text, sql_text, text

SCHEMA = f"schema {schema_text.SCHEMA_TYPE}"


def apply(spark, values, function):
    """One column function over a list of texts, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["r"] for r in df.select("i", function(F.col("t")).alias("r")).orderBy("i").collect()]


EXTRACTIONS = {
    "```sql\nSELECT 1;\n```": "SELECT 1;",
    "```\nSELECT id FROM users;\n```": "SELECT id FROM users;",
    "The answer is SELECT id FROM t;": "SELECT id FROM t",
    "Hello, no SQL here.": None,
    "```sql\n```": None,
    "```sqlite\nSELECT 1\n```": "ite\nSELECT 1",
    "```SQL SELECT 1``` then ```sql SELECT 2```": "SELECT 1",
    "```sql\nSELECT 1": "SELECT 1",
    "select a\nfrom b\n\nThat is all; bye": "select a\nfrom b",
    "SELECTED x;": None,
    "SELECT": None,
    "SELECT * FROM t WHERE n = 'O'Brien' AND a = 1": "SELECT * FROM t WHERE n = 'O''Brien' AND a = 1",
    "SELECT * FROM t WHERE n = 'O\\'Brien'": "SELECT * FROM t WHERE n = 'O''Brien'",
    "SELECT * FROM t WHERE n LIKE'abc'": "SELECT * FROM t WHERE n LIKE''abc'",
    "SELECT 1 WHERE a='x' OR b='' AND c=1": "SELECT 1 WHERE a='x' OR b=' AND c=1",
    "SELECT 1 WHERE a = 'Women''s' AND b": "SELECT 1 WHERE a = 'Women''s' AND b",
    "SELECT f('it'') , 2": "SELECT f('it') , 2",
    "```sql\n  SELECT 1　\n```": "SELECT 1",
    "": None,
    "x ```python\nprint(1)\n``` y": "python\nprint(1)",
    "SELECT a'b'c FROM t": "SELECT a''b''c FROM t",
}


def test_extract_sql(spark):
    got = apply(spark, list(EXTRACTIONS), sql_text.extract_sql)
    assert dict(zip(EXTRACTIONS, got)) == EXTRACTIONS


def test_extract_sql_equals_plain_regular_expressions(spark):
    """The column form against the contract written with Python's engine."""

    def plain(answer):
        fence = re.search(r"```(?:sql)?\s*(.*?)```", answer, re.S | re.I)
        found = fence or re.search(r"(SELECT\b.+?)(?:;|\n\n|\Z)", answer, re.S | re.I)
        sql = found.group(1).strip() if found else ""
        if not sql:
            return None
        sql = re.sub(r"(?<=[A-Za-z])'(?=[A-Za-z])", "''", sql.replace("\\'", "''"))
        tail = "|".join(REPAIR_WORDS)
        return re.sub(rf"'([^'\n\r]*)''(?=\s*(?:{tail}|;|,|\)))", r"'\1'", sql, flags=re.I)

    pieces = ["```", "```sql\n", "SELECT ", "a'b", "\\'", "''", "'", " AND ", ";", "\n\n", " x ", " ", ")", "from"]
    answers = []
    state = 7
    for _ in range(400):
        parts = []
        for _ in range(9):
            state = (state * 1103515245 + 12345) % 2**31
            parts.append(pieces[(state >> 16) % len(pieces)])
        answers.append("".join(parts))
    assert apply(spark, answers, sql_text.extract_sql) == [plain(a) for a in answers]


def test_extract_sql_simple(spark):
    cases = {
        "```sql\nSELECT 1;\n```": "SELECT 1;",
        "text SELECT a FROM t; more": "SELECT a FROM t;",
        "SELECT a FROM t": None,
        "```sql\n```": "",
        "SELECT 9; ```sql SELECT 2```": "SELECT 2",
        "nothing": None,
    }
    assert dict(zip(cases, apply(spark, list(cases), sql_text.extract_sql_simple))) == cases


def test_extract_sql_spaced(spark):
    cases = {
        "```sql\nSELECT 1 WHERE n = 'O' Gallagher'\n```": "SELECT 1 WHERE n = 'O'' Gallagher'",
        "```sql\nSELECT 1 WHERE n = 'x' AND m = 2\n```": "SELECT 1 WHERE n = 'x' AND m = 2",
        "```sql\nSELECT 1 WHERE n = 'x''\n```": "SELECT 1 WHERE n = 'x'",
        "SELECT a": None,
    }
    assert dict(zip(cases, apply(spark, list(cases), sql_text.extract_sql_spaced))) == cases


def test_fence_strict(spark):
    texts = ["```sql\nx```", "```\nx```", "```sqlite x```", "none"]
    assert apply(spark, texts, lambda c: sql_text.has_fence(c)) == [True, True, True, False]
    assert apply(spark, texts, lambda c: sql_text.has_fence(c, strict=True)) == [True, False, False, False]


def test_tokenizes(spark):
    cases = {
        "SELECT 1": True,
        "SELECT 'a": False,
        'SELECT "a': False,
        "SELECT 'it''s' -- it's\n": True,
        "SELECT 1 /* it's": True,
        "SELECT '--' , \"/*\" ": True,
        "SELECT `it's`": False,
    }
    assert dict(zip(cases, apply(spark, list(cases), sql_text.tokenizes))) == cases


def test_canonical_sql(spark):
    texts = [
        "select  a,b from T -- x\n where c='a  b' ;;",
        "SELECT a , b FROM T /* y */ WHERE c = 'a  b'",
        "select count(*) from t",
    ]
    got = apply(spark, texts, sql_text.canonical_sql)
    assert got[0] == got[1] == "SELECT a , b FROM T WHERE c = 'a  b'"
    assert got[2] == "SELECT count ( * ) FROM t"


def test_question_and_preview(spark):
    assert apply(spark, ["How many rows are there", "How many rows?", "", " a "], text.ensure_question) == [
        "How many rows are there?", "How many rows?", "?", "a?",
    ]
    assert apply(spark, ["a", "a?", "", " a "], text.ensure_question_unstripped) == ["a?", "a?", "", " a ?"]
    long = "word " * 100
    plain = " ".join(long.split())
    assert apply(spark, [" a \n\t b ", None, long, "x" * 240], text.preview_text) == [
        "a b", "", plain[:240] + "...", "x" * 240,
    ]


def test_build_prompt(spark):
    row = spark.range(1).select(
        text.build_prompt(F.lit("How many?"), F.lit("employees(id, name)")).alias("full"),
        text.build_prompt(F.lit("How many?")).alias("bare"),
        text.build_prompt(F.lit("How many?"), F.lit(None).cast("string"), SHORT_SYSTEM_PROMPT).alias("null"),
    ).first()
    assert [m["role"] for m in row["full"]] == ["system", "user"]
    assert row["full"][0]["content"] == SYSTEM_PROMPT
    assert row["full"][1]["content"] == "### Question\nHow many?\n### Schema\nemployees(id, name)"
    assert row["bare"][1]["content"] == row["null"][1]["content"] == "### Question\nHow many?"
    assert row["null"][0]["content"] == SHORT_SYSTEM_PROMPT


def test_last_message(spark):
    df = spark.createDataFrame(
        [(1, [("user", "a"), ("assistant", "b")]), (2, []), (3, None)],
        "i int, m array<struct<role:string,content:string>>",
    )
    got = df.select("i", text.last_message_text(F.col("m")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == ["b", "", ""]


SCHEMAS = [
    [("users", ["id", "name", "email"]), ("orders", ["id", "total"])],
    [],
    [("t", ["a", "b"])],
    [("it's", ['say "x"', "both'\"", "back\\slash"]), ("empty", [])],
]


def _schemas(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SCHEMAS)], f"i int, {SCHEMA}").orderBy("i")


def test_schema_literal_is_what_python_prints(spark):
    got = [r["r"] for r in _schemas(spark).select(schema_text.schema_literal(F.col("schema")).alias("r")).collect()]
    assert got == [str({n: c for n, c in s}) for s in SCHEMAS]
    assert [ast.literal_eval(g) for g in got] == [{n: c for n, c in s} for s in SCHEMAS]


def test_schema_round_trip(spark):
    plain = _schemas(spark).where("i < 3")
    compact = plain.select("i", "schema", schema_text.serialize_schema(F.col("schema")).alias("t"))
    rows = compact.select("t", "schema", schema_text.parse_schema(F.col("t")).alias("p")).collect()
    assert rows[0]["t"] == "users(id, name, email) | orders(id, total)"
    assert all(r["p"] == r["schema"] for r in rows)


def test_parse_schema_oddities(spark):
    cases = ["a(x, , y) | junk | b()", "a(x) | b(y) | a(z)", "(no) | c(d)e", ""]
    got = apply(spark, cases, schema_text.parse_schema)
    plain = [[(t["name"], t["columns"]) for t in g] for g in got]
    assert plain == [
        [("a", ["x", "y"]), ("b", [])], [("a", ["z"]), ("b", ["y"])], [("c", ["d"])], [],
    ]


@pytest.mark.parametrize("size", [200_000])
def test_long_texts_need_no_deep_stack(spark, size):
    body = "SELECT 'a' || " + " || ".join(["'x'"] * (size // 8)) + " FROM t /* " + "c" * size
    got = apply(spark, [f"```sql\n{body}\n```"], lambda c: sql_text.tokenizes(sql_text.extract_sql(c)))
    assert got == [True]
