"""Schema catalogs: one row per database, ``db_id`` and ``schema``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import schema_text


def catalog_from_records(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Catalog from table-list records.

    A record has ``db_id``, ``table_names_original`` and ``column_names_original`` (pairs of
    table index and name), or the same without ``_original``. Names are lower-cased, index -1
    (the ``*`` column) is skipped, tables without columns stay, order is kept, and tables whose
    names differ only in case share one column list. Built within the row, without a shuffle.
    ``keep`` names further columns to carry.
    """

    def pick(field: str):
        names = [c for c in (f"{field}_original", field) if c in records.columns]
        if not names:
            raise ValueError(f"records have no {field}")
        return F.coalesce(*[F.col(c) for c in names])

    base = records.select(
        "db_id",
        *keep,
        F.transform(pick("table_names"), F.lower).alias("_tables"),
        F.filter(
            F.transform(
                pick("column_names"),
                lambda pair: F.struct(
                    F.get(pair, F.lit(0)).cast("int").alias("table"),
                    F.lower(F.get(pair, F.lit(1))).alias("name"),
                ),
            ),
            lambda c: c["table"] >= 0,
        ).alias("_columns"),
    )
    placed = base.select(
        "db_id",
        *keep,
        "_tables",
        F.transform(
            "_columns",
            lambda c: F.struct(F.get(F.col("_tables"), c["table"]).alias("table"), c["name"].alias("name")),
        ).alias("_columns"),
    )
    return placed.select(
        "db_id",
        F.transform(
            F.array_distinct("_tables"),
            lambda t: F.struct(
                t.alias("name"),
                F.transform(
                    F.filter(F.col("_columns"), lambda c: c["table"] == t), lambda c: c["name"]
                ).alias("columns"),
            ),
        ).alias("schema"),
        *keep,
    )


def nested_catalog(columns: DataFrame) -> DataFrame:
    """Catalog from one row per column: ``db_id, table_pos, table_name, col_pos, column_name``.

    What is gathered into one row is one database's schema, which has to fit a prompt anyway.
    """
    tables = columns.groupBy("db_id", "table_pos", "table_name").agg(
        F.transform(
            F.array_sort(F.collect_set(F.struct("col_pos", "column_name"))), lambda c: c["column_name"]
        ).alias("columns")
    )
    return tables.groupBy("db_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("table_pos", "table_name", "columns"))),
            lambda t: F.struct(t["table_name"].alias("name"), t["columns"].alias("columns")),
        ).alias("schema")
    )


def schema_columns(catalog: DataFrame) -> DataFrame:
    """One row per column; a table without columns gives one row with nulls."""
    tables = catalog.select("db_id", F.posexplode_outer("schema").alias("table_pos", "_table"))
    return tables.select(
        "db_id",
        "table_pos",
        F.col("_table.name").alias("table_name"),
        F.posexplode_outer("_table.columns").alias("col_pos", "column_name"),
    )


def merge_catalogs(listed: DataFrame, scanned: DataFrame) -> DataFrame:
    """One catalog from listed and scanned ones, a database at a time.

    A listed database wins over a scanned one, a later listing over an earlier one, and the
    first scan over later scans, by the ``ordinal`` column both inputs carry. One aggregate;
    copies of a database are reduced before the shuffle.
    """
    both = listed.select("db_id", "schema", F.col("ordinal").alias("_listed"), F.lit(None).alias("_scanned"))
    both = both.unionByName(
        scanned.select("db_id", "schema", F.lit(None).alias("_listed"), F.col("ordinal").alias("_scanned"))
    )
    best = F.coalesce(F.max_by("schema", "_listed"), F.min_by("schema", "_scanned"))
    return both.groupBy("db_id").agg(best.alias("schema"))


def with_schema_names(catalog: DataFrame) -> DataFrame:
    """Catalog plus what scoring needs of it, worked out once per database: lower-cased
    table and column names, and the statements for an empty copy."""
    return catalog.select(
        "*",
        schema_text.table_names(F.col("schema")).alias("schema_tables"),
        schema_text.column_names(F.col("schema")).alias("schema_columns"),
        schema_text.empty_tables_ddl(F.col("schema")).alias("schema_ddl"),
    )
