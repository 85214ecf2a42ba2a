"""A table of completions to scored rows, metrics and a comparison of runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.catalog import with_schema_names
from quillon.operators.joins import lookup_join, row_digest
from quillon.operators.reports import compare_runs, metric_rows, reward_report
from quillon.operators.scoring import add_answer, score_completions
from quillon.session import spread_input, stored
from quillon.sources.splits import write_results, write_run_metrics


def score_with_catalog(
    completions: DataFrame, catalog: DataFrame, weights: Mapping[str, float] | None = None, **options
) -> DataFrame:
    """Scores of completions that name a database but do not carry its schema.

    What scoring needs of a schema is worked out per database before the join. A database the
    catalog does not know leaves the schema null: neutral fidelity, and SQL counts as failed.
    """
    prepared = with_schema_names(catalog).drop("schema")
    return score_completions(lookup_join(completions, prepared, "db_id", "left"), weights, **options)


REPEATS = 4


def score_repeated(
    completions: DataFrame, catalog: DataFrame, weights: Mapping[str, float] | None = None, messages: str = "messages",
    **options,
) -> DataFrame:
    """As :func:`score_with_catalog`, for answers that come many times, such as those of several runs to the same prompts.

    Whether they do is measured first, by a bounded sketch over hashes. If rows are ``REPEATS`` times as many as distinct answers to a
    database, or more, each of those is scored once, and its scores are joined to the rows by a digest; else every row is scored where it is.
    """
    keys = [c for c in ("source", "db_id") if c in completions.columns] + ["answer"]
    answered = add_answer(completions, messages)
    seen = answered.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64(*keys)).alias("answers")).first()
    if seen["answers"] * REPEATS > seen["rows"]:
        return score_with_catalog(completions, catalog, weights, messages=messages, **options)
    keyed = answered.withColumn("_answer", row_digest(*keys))
    distinct = spread_input(stored(keyed.select("_answer", *keys).distinct(), "answers"))
    scores = stored(score_with_catalog(distinct, catalog, weights, completion="answer", **options).drop(*keys), "scores")
    return lookup_join(keyed, scores, "_answer").drop("_answer")


def evaluate(
    completions: DataFrame, results_path: str, metrics_path: str, weights: Mapping[str, float] | None = None,
    base: str = "baseline", other: str = "tuned", **options,
) -> DataFrame:
    """Scores completions tagged by ``run``, writes results and metrics, compares the runs.

    Reports are made from the written results, so nothing is scored twice, and only from the runs
    that ``completions`` has. Metrics are kept by run: a run evaluated again replaces its own.
    """
    runs = stored(completions.select("run").distinct(), "runs")
    scored = score_completions(completions, weights, **options).withColumnRenamed("combined", "reward")
    kept = [c for c in completions.columns if c not in ("schema_tables", "schema_columns", "schema_ddl")]
    write_results(scored.select(*kept, "reward"), results_path)
    results = completions.sparkSession.read.parquet(results_path)
    results = lookup_join(results, runs, "run", "left_semi")
    write_run_metrics(metric_rows(reward_report(results)), metrics_path)
    return compare_runs(results.select("run", "source", "reward"), base, other)


def evaluation_metrics(scored: DataFrame) -> dict[str, float]:
    """The metric map of a scored frame: a few numbers per run and source."""
    rows = metric_rows(reward_report(scored)).select("metric", F.col("value"))
    return {r["metric"]: r["value"] for r in rows.toLocalIterator()}
