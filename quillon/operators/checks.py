"""Preflight checks of a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.fixed_values import PROMPT_RECORD_COLUMNS, SOURCES


def validate_split(
    rows: DataFrame, label: str = "", allowed: Sequence[str] = SOURCES,
    required: Sequence[str] = PROMPT_RECORD_COLUMNS,
) -> DataFrame:
    """One report row: rows, nulls per required column, rows of unknown source, ``valid``.

    A missing column is an error at once, since it shows without reading any data.
    """
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"[{label}] missing columns: {missing}")
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in required]
    unknown = F.count_if(~F.col("source").isin(*allowed)).alias("unknown_source_rows")
    report = rows.agg(F.count(F.lit(1)).alias("rows"), *nulls, unknown)
    problems = F.col("unknown_source_rows")
    for c in required:
        problems = problems + F.col(f"{c}_nulls")
    return report.select(F.lit(label).alias("label"), "*", (problems == 0).alias("valid"))


def require_valid(
    rows: DataFrame, label: str = "", allowed: Sequence[str] = SOURCES,
    required: Sequence[str] = PROMPT_RECORD_COLUMNS,
) -> int:
    """Runs the check, raises if it fails, and returns the number of rows."""
    report = validate_split(rows, label, allowed, required).first()
    if not report["valid"]:
        nulls = sorted(c for c in required if report[f"{c}_nulls"])
        raise ValueError(
            f"[{label}] columns with nulls: {nulls}; rows of unknown source: {report['unknown_source_rows']}"
        )
    return report["rows"]


def unknown_sources(rows: DataFrame, allowed: Sequence[str] = SOURCES) -> DataFrame:
    """Source labels that are not allowed, with their rows."""
    return rows.where(~F.col("source").isin(*allowed)).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
