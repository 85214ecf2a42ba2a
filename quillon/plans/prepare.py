"""Raw files to prompt records in train, val and test."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.fixed_values import (
    EXAMPLES_A_FILES, EXAMPLES_B_FILES, EXCLUDED_DATABASES, SOURCES, SYSTEM_PROMPT,
)
from quillon.functions.schema_text import schema_literal
from quillon.functions.text import prompt_record
from quillon.operators.examples import exclude_groups, merge_examples_with_schemas, union_examples, without_nulls
from quillon.operators.joins import lookup_join
from quillon.operators.split import group_frame, split_map
from quillon.session import stored
from quillon.sources.catalog import build_catalog, load_catalog, write_catalog
from quillon.sources.examples import load_examples_a, load_examples_b
from quillon.sources.splits import write_splits, write_splits_csv


def prompt_records(merged: DataFrame, system_prompt: str = SYSTEM_PROMPT, keep: Iterable[str] = ()) -> DataFrame:
    """Merged samples as prompt records; ``keep`` names further columns to carry."""
    columns = prompt_record(
        F.col("question"), F.col("schema"), schema_literal(F.col("schema")), F.col("SQL"), F.col("source"),
        F.col("db_id"), system_prompt,
    )
    return merged.select(*columns, *keep)


def prompt_datasets(
    catalog: DataFrame, examples: DataFrame, sample_size: int, train_ratio: float = 0.7,
    val_ratio: float = 0.15, seed: int = 42, excluded: Iterable[str] = EXCLUDED_DATABASES,
    system_prompt: str = SYSTEM_PROMPT, allocate: str = "even", source_order: Sequence[str] = SOURCES,
) -> DataFrame:
    """Excluded, merged, split and rendered, with a ``split`` column.

    A database with examples of several sources counts for the first of them in
    ``source_order``.

    Exclusion comes before the merge, and only databases with a schema are split, since one without must not
    use up a place. Which databases those are, and their labels, is settled on ids and sources alone (this pass also
    fails on a null in any column of an example that has a schema). The labels join the catalog, one row per database, and
    the examples are merged with that, once: rows of databases that were not sampled meet no schema and are not shuffled.
    """
    kept = exclude_groups(examples, excluded)
    known = stored(catalog.select("db_id", F.col("schema").isNull().alias("_no_schema")), "known")
    usable = without_nulls(lookup_join(kept, known.withColumn("_no_schema", F.nullif("_no_schema", F.lit(True))), "db_id"))
    order = F.array_position(F.array(*[F.lit(x) for x in source_order]), F.col("source"))
    groups = stored(group_frame(usable, order=order), "groups")
    labels = stored(split_map(groups, sample_size, train_ratio, val_ratio, seed, allocate=allocate), "labels")
    labelled = stored(lookup_join(catalog, labels.select("db_id", "split"), "db_id", selective=True), "labelled")
    merged = merge_examples_with_schemas(labelled, kept, weights=groups.select("db_id", "rows_of_key"), selective=True)
    return prompt_records(merged, system_prompt, keep=("split",))


def prepare(
    spark: SparkSession, raw_root: str, catalog_path: str, splits_path: str, sample_size: int,
    train_ratio: float = 0.7, val_ratio: float = 0.15, seed: int = 42, skip_catalog: bool = False,
    csv_path: str | None = None,
) -> DataFrame:
    """From a raw data folder to written splits; returns the prompt records."""
    if not skip_catalog:
        write_catalog(build_catalog(spark, raw_root), catalog_path, mode="overwrite")
    catalog = load_catalog(spark, catalog_path)
    examples = union_examples(
        load_examples_a(spark, f"{raw_root}/{EXAMPLES_A_FILES[0]}"),
        load_examples_b(spark, [f"{raw_root}/{f}" for f in EXAMPLES_B_FILES]),
    )
    records = prompt_datasets(catalog, examples, sample_size, train_ratio, val_ratio, seed)
    write_splits(records, splits_path, mode="overwrite")
    written = spark.read.parquet(splits_path)
    if csv_path:
        write_splits_csv(written, csv_path, mode="overwrite", compression="none")
    return written
