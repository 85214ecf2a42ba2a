"""Reading and writing prompt records, results and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.fixed_values import PROMPT_RECORD_COLUMNS
from quillon.functions.schema_text import SCHEMA_TYPE
from quillon.session import open_writers

PROMPT_TYPE = "array<struct<role:string,content:string>>"
_CSV = {"header": True, "quote": '"', "escape": '"'}
OPEN_FILES = 4  # of a task that writes: one for each split, or for the first runs or batches it meets
CSV_RECORDS = 10_000  # of a file, which one task reads; a record is a prompt and has to fit a model's context


def write_splits(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Prompt records with a ``split`` column as Parquet, one folder per split."""
    with open_writers(records.sparkSession, OPEN_FILES):
        records.write.mode(mode).partitionBy("split").parquet(path)


def write_splits_csv(
    records: DataFrame, path: str, mode: str = "errorifexists", named_tables: bool = False,
    records_per_file: int = CSV_RECORDS, compression: str | None = None,
) -> None:
    """The same as CSV, nested columns as JSON text, one folder per split.

    A file cannot be split between the tasks that read it, so none has more than ``records_per_file`` records.
    Each record repeats the system prompt and its database's schema, so files are gzipped unless ``compression`` says otherwise.

    With ``named_tables`` a schema is written as one object of table name to column list. Such
    text, and that of a prompt, is a Python literal as well as JSON. These files are for other readers, so they are plain by default.
    """
    schema = F.col("schema")
    if named_tables:
        schema = F.map_from_entries(F.transform(schema, lambda t: F.struct(t["name"], t["columns"])))
    text = records.withColumn("prompt", F.to_json("prompt")).withColumn("schema", F.to_json(schema))
    packed = compression or ("none" if named_tables else "gzip")
    writer = text.write.mode(mode).options(**_CSV, compression=packed).option("maxRecordsPerFile", records_per_file)
    with open_writers(records.sparkSession, OPEN_FILES):
        writer.partitionBy("split").csv(path)


def _decoded(text: Column, kind: str) -> Column:
    """JSON or Python literal text as a value; text that is neither fails the job, null stays null.

    Python escapes that JSON does not have are ``\\xNN``, rewritten here, and ``\\U``, refused. Few texts hold either, and
    a plain search leaves the others out: the patterns take several times as long as parsing the text.
    """
    odd = r"(?<!\\)((?:\\\\)*)\\"
    rewritten = F.regexp_replace(text, odd + "x([0-9a-fA-F]{2})", r"$1\\u00$2")
    as_json = F.when(text.contains(r"\x"), rewritten).otherwise(text)
    options = {"mode": "FAILFAST", "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    refused = F.raise_error(F.concat(F.lit("cannot decode "), F.left(text, F.lit(200)))).cast(kind)
    return F.when(text.contains(r"\U") & text.rlike(odd + "U"), refused).otherwise(F.from_json(as_json, kind, options))


def _decoded_schema(text: Column) -> Column:
    """A schema from a list of tables, or from one object of table name to column list."""
    named = F.map_entries(_decoded(text, "map<string,array<string>>"))
    tables = F.transform(named, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("columns")))
    return F.when(F.ltrim(text).startswith("{"), tables).otherwise(_decoded(text, SCHEMA_TYPE))


def read_splits(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Prompt records; a filter on ``split`` reads only that folder."""
    if format == "parquet":
        df = spark.read.parquet(path)
    elif format == "csv":
        # Lines of a record may hold line breaks, so a CSV file is read by one task; those written here are short.
        df = spark.read.options(**_CSV, multiLine=True).csv(path)
    else:
        raise ValueError(f"unknown format {format!r}")
    missing = sorted(set(PROMPT_RECORD_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"{path} is missing columns {missing}")
    if format == "csv":
        df = df.withColumn("prompt", _decoded(F.col("prompt"), PROMPT_TYPE)).withColumn(
            "schema", _decoded_schema(F.col("schema"))
        )
    return df.withColumn("db_id", F.col("db_id").cast("string")).withColumn(
        "source", F.col("source").cast("string")
    )


def write_results(results: DataFrame, path: str) -> None:
    """Per-row results, one folder per run; a run written again replaces itself only."""
    _replace_partitions(results, path, "run")


def write_metrics(metrics: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds metric rows to the metrics table.

    ``batch`` names what is added; the same name again replaces it, which makes a retry safe.
    """
    label = batch or f"job-{uuid.uuid4().hex}"
    _replace_partitions(metrics.withColumn("batch", F.lit(label)), path, "batch")


def write_run_metrics(metrics: DataFrame, path: str) -> None:
    """Adds metric rows with one batch per run: a run written again replaces its own metrics only."""
    _replace_partitions(metrics.withColumn("batch", F.concat(F.lit("run-"), F.col("run"))), path, "batch")


def _replace_partitions(df: DataFrame, path: str, column: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    with open_writers(df.sparkSession, OPEN_FILES):
        writer.partitionBy(column).parquet(path)
