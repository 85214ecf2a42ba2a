"""Reading question/SQL examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.examples import normalise_examples_a, normalise_examples_b, union_examples
from quillon.sources.catalog import path_exists

# The parse tree `sql` and the token lists of source A are not in the schema: they are never
# parsed, which is column pruning for JSON. Field names are matched by exact spelling.
EXAMPLE_A_TYPE = "db_id string, question string, query string"
EXAMPLE_B_TYPE = "db_id string, question string, SQL string, query string"


def _read(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def load_examples_a(spark: SparkSession, path: str, source: str = "spider", lines: bool = False) -> DataFrame:
    """Examples whose answer is called ``query``. One array per file, or one record per line."""
    return normalise_examples_a(_read(spark, path, EXAMPLE_A_TYPE, lines), source)


def load_examples_b(
    spark: SparkSession, paths: Sequence[str], source: str = "bird", lines: bool = False
) -> DataFrame:
    """Examples of several files, each optional; an error if none is there."""
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    parts = [_read(spark, p, EXAMPLE_B_TYPE, lines) for p in present]
    whole = union_examples(*parts)
    return normalise_examples_b(_one_answer(whole), source)


def _one_answer(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    answer = F.coalesce("SQL", "query").alias("SQL")
    return df.select("db_id", "question", answer)
