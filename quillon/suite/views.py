"""Inputs of the registered queries, derived from the test tables."""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.schema_text import SCHEMA_TYPE, empty_tables_ddl
from quillon.operators.catalog import nested_catalog
from quillon.operators.reports import flatten_metrics
from quillon.session import spread_input
from quillon.suite.golden import ANSWERS, DATABASES, KNOWN_COLUMNS, KNOWN_TABLES, QUOTED_ANSWERS, STATEMENTS, TABLE_COLUMNS

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of the test tables themselves: two databases."""
    rows = [
        {"db_id": db_id, "schema": [{"name": n, "columns": TABLE_COLUMNS[n].split()} for n in names]}
        for db_id, names in DATABASES.items()
    ]
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<db_id:string,schema:{SCHEMA_TYPE}>>")
    return spark.range(1).select(F.inline(parsed))


def _messages(k: Column) -> Column:
    answers = F.array(*[F.lit(a).cast("string") for a in ANSWERS])
    text = F.get(answers, k)
    one = F.array(F.struct(F.lit("assistant").alias("role"), text.alias("content")))
    return F.when(text.isNull(), F.array().cast(MESSAGES_TYPE)).otherwise(one)


def _orders_with_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_segment(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def _with_segment(orders: DataFrame, customer: DataFrame) -> DataFrame:
    segments = customer.select("c_custkey", "c_mktsegment")
    keys = spread_input(orders.select("o_orderkey", "o_custkey"))
    return keys.join(segments, F.col("o_custkey") == F.col("c_custkey"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per order: ``row_id, k, source, db_id, messages``.

    A few of the answers without SQL are about another database.
    """
    return completions_of(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def completions_of(orders: DataFrame, customer: DataFrame) -> DataFrame:
    rows = _with_segment(orders, customer).select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderkey") % 16).cast("int").alias("k"),
        F.col("c_mktsegment").alias("source"),
        F.when(F.col("o_orderkey") % 64 == 3, "web").otherwise("tpch").alias("db_id"),
    )
    return rows.withColumn("messages", _messages(F.col("k")))


def varied_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`completions`, but no two answers hold the same SQL; a third have a bad name."""
    column = F.when(F.col("o_orderkey") % 3 == 0, F.lit("o_ghost")).otherwise(F.lit("o_totalprice"))
    sql = F.concat(
        F.lit("```sql\nSELECT "), column, F.lit(" FROM orders WHERE o_orderkey = "),
        F.col("o_orderkey").cast("string"), F.lit("\n```"),
    )
    return _orders_with_segment(spark, sf_dir).select(
        F.col("o_orderkey").alias("row_id"), F.col("c_mktsegment").alias("source"), F.lit("tpch").alias("db_id"),
        sql.alias("answer"),
    )


def quoted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per document with quotes to repair around a word of the text: ``doc_id, answer``."""
    stem = F.lower(F.regexp_extract("text", "[A-Za-z]+", 0))
    shape = F.get(F.array(*[F.lit(a) for a in QUOTED_ANSWERS]), (F.col("doc_id") % len(QUOTED_ANSWERS)).cast("int"))
    docs = spread_input(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.replace(shape, F.lit("{w}"), stem).alias("answer"))


def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log values, and the events' own numbers scaled to many orders of magnitude: ``metric, value``."""
    scale = F.element_at(F.array(*[F.lit(x) for x in (1.0, 1e6, -1e3, 1e-3)]), (F.col("event_id") % 4).cast("int") + 1)
    raw = table(spark, sf_dir, "events").select(F.concat(F.lit("raw_"), "event_type").alias("metric"), (F.col("value") * scale).alias("value"))
    return flatten_metrics(metric_log(spark, sf_dir)).select("metric", "value").unionByName(raw)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per document, its names made of a word of the text: ``doc_id, sql, schema``."""
    stem = F.lower(F.regexp_extract("text", "[A-Za-z]+", 0))
    shape = F.get(F.array(*[F.lit(s) for s, _, _ in STATEMENTS]), (F.col("doc_id") % len(STATEMENTS)).cast("int"))
    named = F.regexp_replace(shape, r"\{(\w+)\}", F.concat(F.lit("$1_"), F.col("stem")))
    known = lambda names: F.array(*[F.concat(F.lit(f"{n}_"), F.col("stem")) for n in names])
    columns = F.transform(known(KNOWN_TABLES), lambda t: F.struct(t.alias("name"), known(KNOWN_COLUMNS).alias("columns")))
    docs = spread_input(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", stem.alias("stem"))
    return docs.select("doc_id", named.alias("sql"), columns.alias("schema"))


def statement_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that hold the statements: fenced, fenced without a tag, or a refusal: ``doc_id, db_id, schema, answer``."""
    way = F.col("doc_id") % 5
    answer = F.when(way == 0, "I cannot tell").when(way < 3, F.concat(F.lit("Like so:\n```\n"), "sql", F.lit("\n```"))).otherwise(
        F.concat(F.lit("```sql\n"), "sql", F.lit("\n```\nDone."))
    )
    return statements(spark, sf_dir).select("doc_id", _database(), "schema", answer.alias("answer"))


def statement_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the statements fared: two thirds ran, a sixth failed, the others were not run: ``db_id, sql, exec_status``."""
    status = F.when(F.col("doc_id") % 6 < 4, "ok").otherwise("error")
    return statements(spark, sf_dir).where("doc_id % 6 < 5").select(_database(), "sql", status.alias("exec_status"))


def _database() -> Column:
    return F.concat(F.lit("db_"), (F.col("doc_id") % 1000).cast("string"), F.lit("_"), F.col("doc_id").cast("string")).alias("db_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completions of two runs; the tuned one differs on every fifth row."""
    base = completions(spark, sf_dir)
    moved = F.when(F.col("row_id") % 5 == 0, (F.col("k") + 1) % 16).otherwise(F.col("k"))
    tuned = base.withColumn("k", moved).withColumn("messages", _messages(F.col("k")))
    return base.withColumn("run", F.lit("baseline")).unionByName(tuned.withColumn("run", F.lit("tuned")))


def raw_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer pairs with many copies: ``db_id, question, SQL, source, o_orderkey``."""
    key = F.col("o_orderkey")
    db_id = F.element_at(F.array(F.lit("tpch"), F.lit("web"), F.lit("missing")), (key % 3).cast("int") + 1)
    return table(spark, sf_dir, "orders").select(
        db_id.alias("db_id"),
        F.concat(
            F.lit("  How many orders have priority "), F.col("o_orderpriority"),
            F.when(key % 2 == 0, "?").otherwise(" "),
        ).alias("question"),
        F.concat(
            F.lit("SELECT COUNT(*) FROM orders WHERE o_orderpriority = '"), F.col("o_orderpriority"), F.lit("'")
        ).alias("SQL"),
        F.when(key % 4 < 2, "a").otherwise("b").alias("source"),
        key,
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to split: customers are the databases, market segments the sources."""
    return _orders_with_segment(spark, sf_dir).select(
        F.concat(F.lit("db_"), F.col("c_custkey").cast("string")).alias("db_id"),
        F.col("c_mktsegment").alias("source"),
        "o_orderkey",
    )


def database_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per column of one small database per customer, names with quotes among them."""
    m = F.col("o_orderkey") % 7
    priority = F.left("o_orderpriority", F.lit(1))
    head = F.when(m == 3, "it's_").when(m == 4, 'say"x"_').when(m == 5, "both'\"_").otherwise("Col_")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("db_"), F.col("o_custkey").cast("string")).alias("db_id"),
        (priority.cast("int") - 1).alias("table_pos"),
        F.concat(F.lit("Orders_"), priority).alias("table_name"),
        (m.cast("int") * 3 + _status_rank()).alias("col_pos"),
        F.concat(head, F.col("o_orderstatus"), F.lit("_"), m.cast("string")).alias("column_name"),
    )


def _status_rank() -> Column:
    return F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)


def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of one small database per customer that has orders."""
    return nested_catalog(database_columns(spark, sf_dir))


def table_list_lines(catalog: DataFrame) -> DataFrame:
    """Table-list records of a catalog as JSON text, index and name mixed in one array."""

    def quoted(name: Column) -> Column:
        listed = F.to_json(F.array(name))
        return F.substring(listed, F.lit(2), F.char_length(listed) - 2)

    pairs = F.flatten(
        F.transform(
            "schema",
            lambda t, i: F.transform(
                t["columns"], lambda c: F.concat(F.lit("["), i.cast("string"), F.lit(","), quoted(c), F.lit("]"))
            ),
        )
    )
    text = F.concat(
        F.lit('{"db_id":'), quoted(F.col("db_id")),
        F.lit(',"table_names_original":'), F.to_json(F.transform("schema", lambda t: t["name"])),
        F.lit(',"column_names_original":[[-1,"*"],'), F.array_join(pairs, ","), F.lit("]}"),
    )
    return catalog.select(text.alias("value"))


def database_images(catalog: DataFrame) -> DataFrame:
    """SQLite images of the databases; every tenth has a shadow name, every tenth is broken."""

    opened = []

    # A row function without Arrow: a hundred images at a time, and not ten thousand. The connection serves one after the other.
    @F.udf("binary", useArrow=False)
    def image(ddl, broken):
        if not opened:
            conn = sqlite3.connect(":memory:", isolation_level=None)
            conn.executescript("PRAGMA page_size = 512; CREATE TABLE t (c); DROP TABLE t;")
            opened.extend((conn, conn.serialize()))
        conn, empty = opened
        conn.deserialize(empty)
        conn.executescript(f"BEGIN; {ddl} COMMIT;")
        content = conn.serialize()
        return content[:16] + b"\xff" * 200 if broken else content

    number = F.substring("db_id", 4, 20).cast("long")
    prefix = F.when(number % 10 == 3, "databases/._").otherwise("databases/")
    # Building an image is slow Python; the few rows per partition a grouping leaves are dealt out.
    cores = catalog.sparkSession.sparkContext.defaultParallelism
    # Behind the one-row unfold a filter on the content stays above; pushed down, it would build each image once more, in the grouping's few tasks.
    return catalog.repartition(cores).select(
        F.concat(prefix, "db_id", F.lit(".sqlite")).alias("path"),
        F.inline(F.array(F.struct(image(empty_tables_ddl(F.col("schema")), number % 10 == 7).alias("content")))),
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of rollouts: order keys are the prompts, every seventh prompt is flat."""
    mixed = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 101) % 10001
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"),
        F.concat(F.lit("db_"), (F.col("l_suppkey") % 31).cast("string")).alias("db_id"),
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(5000)).otherwise(mixed).cast("long").alias("reward_units"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts per document; every eleventh has an empty completion."""
    return table(spark, sf_dir, "documents").select(
        "source",
        F.floor(F.col("n_chars") / 4).cast("long").alias("prompt_tokens"),
        (F.col("doc_id") % 200).alias("completion_tokens"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise("SELECT 1").alias("completion"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records as JSON text: two numbers, a boolean, a text and a number written as text."""
    return metric_log_of(spread_input(table(spark, sf_dir, "events")))


def metric_log_of(events: DataFrame) -> DataFrame:
    flag = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    text = F.concat(
        F.lit('{"'), F.col("event_type"), F.lit('": '), F.floor(F.col("value") * 100).cast("long").cast("string"),
        F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit(', "flag": '), flag,
        F.lit(', "note": "text", "written": "12", "none": null}'),
    )
    return events.select(F.col("event_id").alias("step"), text.alias("logs"))
