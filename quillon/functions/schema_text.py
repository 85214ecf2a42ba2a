"""Text forms of a database schema held as ``array<struct<name, columns>>``.

An array and not a map, because the order of tables is printed and a map has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import strip

SCHEMA_TYPE = "array<struct<name:string,columns:array<string>>>"


def _quoted(name: Column) -> Column:
    # Single quotes, unless the name holds a single quote and no double quote.
    escaped = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(char), F.lit(code))
    has_single, has_double = F.contains(name, F.lit("'")), F.contains(name, F.lit('"'))
    return (
        F.when(has_single & ~has_double, F.concat(F.lit('"'), escaped, F.lit('"')))
        .when(has_single, F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))
    )


def schema_literal(schema: Column) -> Column:
    """The schema as dictionary literal text: ``{'t': ['a', 'b'], 'u': []}``."""
    tables = F.transform(
        schema,
        lambda t: F.concat(
            _quoted(t["name"]), F.lit(": ["), F.array_join(F.transform(t["columns"], _quoted), ", "), F.lit("]")
        ),
    )
    return F.concat(F.lit("{"), F.array_join(tables, ", "), F.lit("}"))


def serialize_schema(schema: Column) -> Column:
    """Compact text: ``t(a, b) | u(c)``."""
    return F.array_join(
        F.transform(
            schema, lambda t: F.concat(t["name"], F.lit("("), F.array_join(t["columns"], ", "), F.lit(")"))
        ),
        " | ",
    )


def parse_schema(text: Column) -> Column:
    """Inverse of :func:`serialize_schema`.

    Parts that do not look like ``name(...)`` are skipped. When a name repeats, it keeps its
    first place and takes the columns of its last occurrence.
    """
    pattern = r"\A([\p{L}\p{N}_]+)\(([^)]*)\)"
    parts = F.filter(F.transform(F.split(text, r"\|"), strip), lambda p: p.rlike(pattern))
    parsed = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, pattern, 1).alias("name"),
            F.filter(
                F.transform(F.split(F.regexp_extract(p, pattern, 2), ","), strip), lambda c: c != ""
            ).alias("columns"),
        ),
    )
    names = F.transform(parsed, lambda t: t["name"])
    distinct = F.array_distinct(names)
    last_wins = F.transform(
        distinct, lambda n: F.element_at(F.filter(parsed, lambda t: t["name"] == n), -1)
    )
    return F.when(F.size(distinct) == F.size(parsed), parsed).otherwise(last_wins)


def table_names(schema: Column) -> Column:
    """Lower-cased table names."""
    return F.transform(schema, lambda t: F.lower(t["name"]))


def column_names(schema: Column) -> Column:
    """Lower-cased distinct column names of all tables."""
    return F.array_distinct(
        F.flatten(F.transform(schema, lambda t: F.transform(t["columns"], lambda c: F.lower(c))))
    )


def empty_tables_ddl(schema: Column) -> Column:
    """CREATE TABLE statements for an empty copy of the database."""

    def name(text: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    with_columns = F.filter(schema, lambda t: F.size(t["columns"]) > 0)
    return F.array_join(
        F.transform(
            with_columns,
            lambda t: F.concat(
                F.lit("CREATE TABLE IF NOT EXISTS "), name(t["name"]), F.lit(" ("),
                F.array_join(
                    F.transform(
                        F.array_distinct(F.transform(t["columns"], lambda c: F.lower(c))), name
                    ),
                    ", ",
                ),
                F.lit(");"),
            ),
        ),
        "\n",
    )
