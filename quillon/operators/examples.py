"""Question/SQL examples: cleaning, union, exclusion, merge with the catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillon.fixed_values import EXCLUDED_DATABASES, NOISE_COLUMNS_A, NOISE_COLUMNS_B
from quillon.functions.text import ensure_question
from quillon.operators.joins import lookup_join
from quillon.operators.prefilter import with_membership
from quillon.session import stored


def normalise_examples(raw: DataFrame, source: str | None, noise: Iterable[str]) -> DataFrame:
    """Tagged, without noise columns, ``query`` as ``SQL``, question ending in ``?``, no copies."""
    tagged = raw if source is None else raw.withColumn("source", F.lit(source))
    slim = drop_noise(tagged, noise)
    if "query" in slim.columns and "SQL" not in slim.columns:
        slim = slim.withColumnRenamed("query", "SQL")
    return dedupe_examples(slim.withColumn("question", ensure_question(F.col("question"))))


def drop_noise(df: DataFrame, noise: Iterable[str]) -> DataFrame:
    """Without the noise columns, compared with their exact spelling.

    ``sql`` (a parse tree) is noise where ``SQL`` (the answer) is data, so the session's
    case-insensitive column lookup must not be used here.
    """
    unwanted = set(noise)
    kept = [c for c in df.columns if c not in unwanted]
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) == len(lowered):
        return df.select(*kept)
    renamed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_{df.columns.index(c)}").alias(c) for c in kept])


def normalise_examples_a(raw: DataFrame, source: str = "spider") -> DataFrame:
    return normalise_examples(raw, source, NOISE_COLUMNS_A)


def normalise_examples_b(raw: DataFrame, source: str = "bird") -> DataFrame:
    return normalise_examples(raw, source, NOISE_COLUMNS_B)


def dedupe_examples(examples: DataFrame) -> DataFrame:
    """One of each set of equal rows, nulls equal.

    Only two hashes of a row are shuffled to find what repeats. Rows whose hashes are all their own are passed through
    where they are; those that share them meet, copies first within their task, and are compared in full. So a
    text crosses the network only if it (or, rarely, another with its bit) is there twice. The frame is read three times and has to give the same rows each time, as a scan does.
    """
    rows = _by_place(examples)
    repeated = _repeated_digests(rows)
    if repeated is None:
        return examples
    marked = with_membership(rows.withColumns(_digests(rows)), repeated, list(_DIGESTS))
    alone = marked.where(~F.col("_maybe")).select(*rows.columns)
    return alone.union(marked.where(F.col("_maybe")).select(*rows.columns).dropDuplicates()).toDF(*examples.columns)


def duplicate_count(examples: DataFrame) -> DataFrame:
    """How many rows a dedupe drops, with the same economy as :func:`dedupe_examples`."""
    rows = _by_place(examples)
    repeated = _repeated_digests(rows)
    if repeated is None:
        return rows.limit(0).agg(F.count(F.lit(1)).alias("duplicates"))
    marked = with_membership(rows.withColumns(_digests(rows)), repeated, list(_DIGESTS)).where("_maybe")
    groups = marked.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


_DIGESTS = ("_digest_a", "_digest_b")


def _by_place(df: DataFrame) -> DataFrame:
    """The frame with its columns named by their place, since names may differ in case only or hold dots."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def _digests(df: DataFrame) -> dict[str, Column]:
    """Two hashes of a whole row. They skip nulls, which costs nothing but a comparison."""
    return {name: F.xxhash64(F.lit(k), *df.columns) for k, name in enumerate(_DIGESTS)}


def _repeated_digests(df: DataFrame) -> DataFrame | None:
    """The digests that several rows share, stored; nothing if there are none."""
    counts = df.select(*[column.alias(name) for name, column in _digests(df).items()]).groupBy(*_DIGESTS).agg(F.count(F.lit(1)).alias("_n"))
    repeated = stored(counts.where("_n > 1").select(*_DIGESTS), "repeated")
    return None if repeated.isEmpty() else repeated


def column_counts(df: DataFrame) -> DataFrame:
    """Non-null values per column, one wide row."""
    return df.agg(*[F.count(c).alias(c) for c in df.columns])


def union_examples(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, by column name; a column a part lacks is null there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def exclude_groups(
    df: DataFrame, values: Iterable[str] | DataFrame = EXCLUDED_DATABASES, column: str = "db_id"
) -> DataFrame:
    """Rows whose ``column`` is not among ``values``; null stays.

    A list becomes a scan filter. A frame becomes an anti join, broadcast if its measured
    size allows, else with hot groups spread.
    """
    if not isinstance(values, DataFrame):
        chosen = list(values)
        return df.where(F.coalesce(~F.col(column).isin(*chosen), F.lit(True))) if chosen else df
    return lookup_join(df, stored(values.select(column).distinct(), "excluded"), column, "left_anti")


def exclude_groups_counted(
    df: DataFrame, values: Iterable[str] | DataFrame = EXCLUDED_DATABASES, column: str = "db_id"
) -> tuple[DataFrame, Observation]:
    """As :func:`exclude_groups`, and an observation of how many rows came in (``rows``) and were dropped (``dropped``).

    Both are counted by the pass that filters: the observation is filled by the first action on the frame, and waits for it. That should be
    one that reads the frame to its end, such as a write; where tasks below a later shuffle are run again, their rows may count again.
    """
    if isinstance(values, DataFrame):
        unwanted = stored(values.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_dropped", F.lit(True)), "excluded")
        marked = lookup_join(df, unwanted, column, "left").withColumn("_dropped", F.coalesce("_dropped", F.lit(False)))
        marked = marked.select(*df.columns, "_dropped")
    else:
        chosen = list(values)
        listed = F.coalesce(F.col(column).isin(*chosen), F.lit(False)) if chosen else F.lit(False)
        marked = df.withColumn("_dropped", listed)
    seen = Observation()
    counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_dropped")).alias("dropped"))
    return counted.where(~F.col("_dropped")).drop("_dropped"), seen


def exclusion_report(df: DataFrame, seen: Observation, path: str) -> DataFrame:
    """Writes the kept rows to ``path`` and returns one row: ``rows, dropped, kept``. The counts come out of that write."""
    df.write.parquet(path)
    found = seen.get
    counts = (found["rows"], found["dropped"], found["rows"] - found["dropped"])
    return df.sparkSession.createDataFrame([counts], "rows long, dropped long, kept long")


def merge_examples_with_schemas(
    catalog: DataFrame, examples: DataFrame, guard: bool = True, weights: DataFrame | None = None, selective: bool = False,
) -> DataFrame:
    """Inner join on ``db_id``: examples of unknown databases are dropped.

    ``guard`` makes the job fail on a row with a null in any column. The check is a filter, which stays
    whatever columns are read, and needs no second pass. ``weights`` and ``selective`` as in ``lookup_join``.
    """
    merged = lookup_join(examples, catalog, "db_id", weights=weights, selective=selective)
    return without_nulls(merged) if guard else merged


def without_nulls(merged: DataFrame) -> DataFrame:
    """The frame, whose job fails if a row has a null in any column."""
    missing = F.lit(False)
    for name in merged.columns:
        missing = missing | F.col(name).isNull()
    failure = F.raise_error(F.lit("null value in a merged row")).cast("boolean")
    return merged.where(F.when(missing, failure).otherwise(F.lit(True)))
