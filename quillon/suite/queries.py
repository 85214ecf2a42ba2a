"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.fixed_values import BUILT_IN_WEIGHTS, DEFAULT_WEIGHTS
from quillon.functions import schema_text, sql_text, text
from quillon.functions.numbers import round4
from quillon.operators import checks, examples, groups, quantiles, reports, scoring, split
from quillon.operators import exec_check as exec_ops
from quillon.operators.catalog import merge_catalogs as merge_by_rank
from quillon.operators.catalog import schema_columns, with_schema_names
from quillon.operators.conversations import conversation_lists
from quillon.operators.joins import lookup_join
from quillon.plans.evaluate import score_repeated, score_with_catalog
from quillon.plans.prepare import prompt_datasets, prompt_records
from quillon.session import scratch_path, stored
from quillon.sources import catalog as catalog_io
from quillon.sources import examples as example_io
from quillon.sources import metrics_table
from quillon.sources import splits as split_io
from quillon.streaming import append_metrics, append_metrics_merged, append_to, metrics_stream, score_stream
from quillon.suite import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPLIT_SIZE = 40
CONVERSATION_BYTES = 2000  # shorter than most conversations of the tables, so that they are cut
SOURCES = ("a", "b")


def query(function: Query) -> Query:
    QUERIES[function.__name__.removesuffix("_query")] = function
    return function


# --- sources and sinks ---------------------------------------------------------------


@query
def catalog_from_tables_json(spark, sf_dir):
    path = scratch_path(spark, "table-lists")
    views.table_list_lines(views.databases(spark, sf_dir)).write.text(path)
    return schema_columns(catalog_io.read_tables_json(spark, path, lines=True))


@query
def catalog_from_sqlite(spark, sf_dir):
    scan = catalog_io.scan_images(views.database_images(views.databases(spark, sf_dir)))
    return schema_columns(scan.where(F.col("error").isNull()))


@query
def catalog_scan_errors(spark, sf_dir):
    scan = catalog_io.scan_images(views.database_images(views.databases(spark, sf_dir)))
    return scan.where(F.col("error").isNotNull()).select("db_id")


@query
def load_catalog(spark, sf_dir):
    path = scratch_path(spark, "catalog")
    catalog_io.write_catalog(views.databases(spark, sf_dir), path)
    return schema_columns(catalog_io.load_catalog(spark, path))


@query
def write_catalog(spark, sf_dir):
    path = scratch_path(spark, "catalog")
    catalog_io.write_catalog_parquet(views.databases(spark, sf_dir), path)
    return spark.read.parquet(path).select(
        "db_id",
        F.size("schema").cast("long").alias("tables"),
        F.size(F.flatten(F.transform("schema", lambda t: t["columns"]))).cast("long").alias("columns"),
    )


def _written_examples(spark, sf_dir, source: str, answer: str, path: str) -> None:
    rows = views.raw_examples(spark, sf_dir).where(F.col("source") == source)
    noise = F.split(F.col("SQL"), " ")
    rows.select(
        "db_id", "question", F.col("SQL").alias(answer), noise.alias("query_toks"),
        F.col("o_orderkey").alias("question_id"),
    ).write.json(path)


@query
def load_examples_a(spark, sf_dir):
    path = scratch_path(spark, "examples-a")
    _written_examples(spark, sf_dir, "a", "query", path)
    return example_io.load_examples_a(spark, path, source="a", lines=True)


@query
def load_examples_b(spark, sf_dir):
    first, second = scratch_path(spark, "examples-b"), scratch_path(spark, "examples-b")
    _written_examples(spark, sf_dir, "b", "SQL", first)
    _written_examples(spark, sf_dir, "a", "query", second)
    missing = scratch_path(spark, "examples-none")
    return example_io.load_examples_b(spark, [first, missing, second], source="b", lines=True)


def _merged(spark, sf_dir) -> DataFrame:
    found = examples.normalise_examples(
        views.raw_examples(spark, sf_dir).drop("o_orderkey"), None, ()
    )
    return examples.merge_examples_with_schemas(views.table_catalog(spark, sf_dir), found)


def _records(spark, sf_dir) -> DataFrame:
    """Prompt records over the whole orders table, split by customer."""
    rows = views.groups(spark, sf_dir)
    labelled = split.stratified_split(rows, -1, allocate="all")
    sql = F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), F.col("o_orderkey").cast("string"))
    question = text.ensure_question(F.concat(F.lit("Which order is "), F.col("o_orderkey").cast("string")))
    filled = labelled.withColumn("question", question).withColumn("SQL", sql)
    catalog = stored(views.databases(spark, sf_dir), "catalog")
    return prompt_records(lookup_join(filled, catalog, "db_id"), keep=("split",))


def _record_digest(records: DataFrame) -> DataFrame:
    return records.select(
        "split", "db_id", "source", "solution", F.col("prompt")[1]["content"].alias("user_text"),
        F.size("schema").cast("long").alias("tables"),
    )


@query
def read_splits(spark, sf_dir):
    path = scratch_path(spark, "splits-csv")
    split_io.write_splits_csv(_records(spark, sf_dir), path)
    return _record_digest(split_io.read_splits(spark, path, "csv"))


@query
def write_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    split_io.write_splits(_records(spark, sf_dir), path)
    return split_io.read_splits(spark, path).groupBy("split", "source").agg(F.count("*").alias("rows"))


def _run_scores(spark, sf_dir) -> DataFrame:
    scored = score_repeated(views.runs(spark, sf_dir), views.table_catalog(spark, sf_dir))
    return scored.select("run", "row_id", "source", F.col("combined").alias("reward"))


@query
def write_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    split_io.write_results(_run_scores(spark, sf_dir), path)
    return spark.read.parquet(path)


@query
def write_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    rows = reports.metric_rows(reports.reward_report(_run_scores(spark, sf_dir)))
    split_io.write_metrics(rows.where("run = 'baseline'"), path)
    split_io.write_metrics(rows.where("run = 'tuned'"), path)
    return spark.read.parquet(path).drop("batch")


@query
def write_metrics_merged(spark, sf_dir):
    path = scratch_path(spark, "metrics-table")
    rows = stored(reports.metric_rows(reports.reward_report(_run_scores(spark, sf_dir))), "metric-rows")
    for name in ("baseline", "tuned", "baseline", "tuned", "baseline"):
        metrics_table.append_batch(rows.where(F.col("run") == name), path, name)
    return metrics_table.read_metrics(spark, path).drop("batch")


# --- examples ------------------------------------------------------------------------


@query
def exclude_groups(spark, sf_dir):
    return examples.exclude_groups(views.raw_examples(spark, sf_dir), ["web"]).select("o_orderkey", "db_id")


@query
def exclude_listed_groups(spark, sf_dir):
    unwanted = views.groups(spark, sf_dir).where(F.col("source") == "BUILDING")
    return examples.exclude_groups(views.groups(spark, sf_dir), unwanted)


@query
def exclude_report(spark, sf_dir):
    kept, seen = examples.exclude_groups_counted(views.raw_examples(spark, sf_dir), ["web"])
    return examples.exclusion_report(kept, seen, scratch_path(spark, "kept"))


@query
def exclude_listed_report(spark, sf_dir):
    unwanted = views.groups(spark, sf_dir).where(F.col("source") == "BUILDING")
    kept, seen = examples.exclude_groups_counted(views.groups(spark, sf_dir), unwanted)
    return examples.exclusion_report(kept, seen, scratch_path(spark, "kept"))


@query
def merge_examples_with_schemas(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    return merged.select(
        "db_id", "question", "SQL", "source", F.size("schema").cast("long").alias("tables")
    )


@query
def dedupe_examples(spark, sf_dir):
    return examples.dedupe_examples(views.table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query
def duplicate_count(spark, sf_dir):
    return examples.duplicate_count(views.table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query
def column_counts(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    emptied = docs.withColumn("lang", F.when(F.col("lang") != "en", F.col("lang")))
    return examples.column_counts(emptied)


@query
def union_examples(spark, sf_dir):
    rows = views.raw_examples(spark, sf_dir)
    first = rows.where(F.col("source") == "a").drop("SQL")
    return examples.union_examples(first, rows.where(F.col("source") == "b"))


@query
def merge_catalogs(spark, sf_dir):
    found = views.databases(spark, sf_dir)
    number = F.substring("db_id", 4, 20).cast("long")
    first_table = F.slice("schema", 1, 1)
    listed = found.where(number % 2 == 0)
    listings = listed.withColumn("ordinal", F.lit(0)).unionByName(
        listed.where(number % 4 == 0).withColumn("schema", first_table).withColumn("ordinal", F.lit(1))
    )
    scans = found.withColumn("schema", F.reverse("schema")).withColumn("ordinal", F.lit("b")).unionByName(
        found.where(number % 3 == 0).withColumn("schema", first_table).withColumn("ordinal", F.lit("a"))
    )
    listings = listings.withColumn("ordinal", F.col("ordinal").cast("string"))
    merged = merge_by_rank(listings, scans)
    return merged.select("db_id", F.array_join(F.transform("schema", lambda t: t["name"]), ",").alias("tables"))


# --- splits --------------------------------------------------------------------------


@query
def first_source_per_group(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("db_"), F.col("o_custkey").cast("string")).alias("db_id"),
        F.col("o_orderstatus").alias("source"),
    )
    order = F.array_position(F.array(F.lit("P"), F.lit("O"), F.lit("F")), F.col("source"))
    return split.group_frame(rows, order=order).select("db_id", "source", F.col("rows_of_key").alias("rows"))


def _split_map(spark, sf_dir, **options) -> DataFrame:
    labelled = split.stratified_split(views.groups(spark, sf_dir), **options)
    return labelled.select("o_orderkey", "db_id", "source", "split")


@query
def stratified_split(spark, sf_dir):
    return _split_map(spark, sf_dir, sample_size=-1)


@query
def stratified_split_sampled(spark, sf_dir):
    return _split_map(spark, sf_dir, sample_size=SPLIT_SIZE + 3, train_ratio=0.6, val_ratio=0.2, seed=7)


@query
def stratified_split_capped(spark, sf_dir):
    return _split_map(spark, sf_dir, sample_size=6, train_ratio=0.6, val_ratio=0.4, cap_val=True)


@query
def stratified_split_all(spark, sf_dir):
    return _split_map(spark, sf_dir, sample_size=-1, allocate="all")


@query
def split_profile(spark, sf_dir):
    return split.split_profile(split.stratified_split(views.groups(spark, sf_dir), -1))


@query
def split_overlap(spark, sf_dir):
    return split.split_overlap(split.stratified_split(views.groups(spark, sf_dir), -1))


@query
def missing_from_train(spark, sf_dir):
    few = split.stratified_split(views.groups(spark, sf_dir), 3)
    unused = views.groups(spark, sf_dir).withColumn("split", F.lit("unused"))
    return split.missing_from_train(few.unionByName(unused))


@query
def quick_sample(spark, sf_dir):
    labelled = split.stratified_split(views.groups(spark, sf_dir), -1)
    return split.quick_sample(labelled.select("o_orderkey", "db_id", "source", "split"), ["o_orderkey"])


@query
def validate_split(spark, sf_dir):
    return checks.validate_split(_records(spark, sf_dir), "all", ("BUILDING", "AUTOMOBILE", "MACHINERY"))


@query
def prompt_datasets_query(spark, sf_dir):
    rows = views.groups(spark, sf_dir)
    sql = F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), F.col("o_orderkey").cast("string"))
    question = text.ensure_question(F.concat(F.lit("Which order is "), F.col("o_orderkey").cast("string")))
    asked = rows.select("db_id", question.alias("question"), sql.alias("SQL"), "source")
    return _record_digest(prompt_datasets(views.databases(spark, sf_dir), asked, SPLIT_SIZE, excluded=()))


# --- text ----------------------------------------------------------------------------


def _answers(spark, sf_dir) -> DataFrame:
    return scoring.add_answer(views.completions(spark, sf_dir))


@query
def extract_sql(spark, sf_dir):
    return _answers(spark, sf_dir).select("row_id", sql_text.extract_sql(F.col("answer")).alias("sql"))


@query
def extract_sql_simple(spark, sf_dir):
    return _answers(spark, sf_dir).select("row_id", sql_text.extract_sql_simple(F.col("answer")).alias("sql"))


@query
def extract_sql_spaced(spark, sf_dir):
    return _answers(spark, sf_dir).select("row_id", sql_text.extract_sql_spaced(F.col("answer")).alias("sql"))


@query
def extract_sql_quotes(spark, sf_dir):
    answer = F.col("answer")
    return views.quoted_answers(spark, sf_dir).select(
        "doc_id", sql_text.extract_sql(answer).alias("sql"), sql_text.extract_sql_spaced(answer).alias("spaced")
    )


@query
def ensure_question(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.ensure_question(F.col("text")).alias("question"))


@query
def preview_text(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.preview_text(F.col("text")).alias("preview"))


@query
def build_prompts(spark, sf_dir):
    rows = views.raw_examples(spark, sf_dir)
    schema = F.when(F.col("o_orderkey") % 5 != 0, F.lit("orders(o_orderkey)"))
    prompt = text.build_prompt(F.col("question"), schema)
    return rows.select(
        "o_orderkey",
        prompt[0]["role"].alias("first_role"), prompt[0]["content"].alias("system_text"),
        prompt[1]["role"].alias("second_role"), prompt[1]["content"].alias("user_text"),
    )


@query
def prompt_records_query(spark, sf_dir):
    return _record_digest(_records(spark, sf_dir))


@query
def schema_literal(spark, sf_dir):
    return views.databases(spark, sf_dir).select(
        "db_id", schema_text.schema_literal(F.col("schema")).alias("literal")
    )


@query
def serialize_schema(spark, sf_dir):
    return views.databases(spark, sf_dir).select(
        "db_id", schema_text.serialize_schema(F.col("schema")).alias("text")
    )


@query
def parse_schema(spark, sf_dir):
    compact = views.databases(spark, sf_dir).select(
        "db_id", schema_text.serialize_schema(F.col("schema")).alias("text")
    )
    return schema_columns(compact.select("db_id", schema_text.parse_schema(F.col("text")).alias("schema")))


@query
def last_message(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max_by("text", "turn"), F.lit("")).alias("last_text")
    )


@query
def chat_messages(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    wrapped = turns.select("conv_id", "turn", text.chat_messages(F.col("text"), F.col("role")).alias("messages"))
    return wrapped.select(
        "conv_id", "turn", F.size("messages").cast("long").alias("n"),
        F.col("messages")[0]["role"].alias("role"), text.last_message_text(F.col("messages")).alias("content"),
    )


@query
def chat_conversations(spark, sf_dir):
    lists = conversation_lists(views.table(spark, sf_dir, "conversations"), CONVERSATION_BYTES)
    messages = F.col("messages")
    return lists.select(
        "conv_id", "chunk", F.size(messages).cast("long").alias("n"),
        F.array_join(F.transform(messages, lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform(messages, lambda m: m["content"]), "\x1f").cast("binary")).alias("content_md5"),
    )


@query
def canonical_sql(spark, sf_dir):
    rows = scoring.add_sql(_answers(spark, sf_dir)).where(F.col("sql").isNotNull())
    return rows.select("row_id", sql_text.canonical_sql(F.col("sql")).alias("canonical"))


@query
def distinct_completions(spark, sf_dir):
    rows = scoring.add_sql(_answers(spark, sf_dir)).where(F.col("sql").isNotNull())
    canonical = rows.select("source", sql_text.canonical_sql(F.col("sql")).alias("canonical"))
    return canonical.groupBy("source", "canonical").agg(F.count("*").alias("rows"))


# --- scores --------------------------------------------------------------------------


def _with_sql(spark, sf_dir) -> DataFrame:
    return scoring.add_sql(_answers(spark, sf_dir))


@query
def score_fence(spark, sf_dir):
    return scoring.add_fence(_with_sql(spark, sf_dir)).select("row_id", "sql_fence")


@query
def score_fence_strict(spark, sf_dir):
    return scoring.add_fence(_with_sql(spark, sf_dir), strict=True).select("row_id", "sql_fence")


@query
def score_format(spark, sf_dir):
    return scoring.add_format(_with_sql(spark, sf_dir)).select("row_id", "format")


def _with_catalog(spark, sf_dir, rows: DataFrame) -> DataFrame:
    prepared = with_schema_names(views.table_catalog(spark, sf_dir)).drop("schema")
    return lookup_join(rows, prepared, "db_id", "left")


@query
def score_exec(spark, sf_dir):
    rows = _with_catalog(spark, sf_dir, _with_sql(spark, sf_dir))
    outcome = exec_ops.exec_outcome_catalog(F.col("sql"), F.col("schema_ddl"))
    return exec_ops.add_exec(rows, outcome).select("row_id", "exec_status", "exec")


@query
def score_exec_once(spark, sf_dir):
    rows = _with_catalog(spark, sf_dir, _with_sql(spark, sf_dir))
    outcome = exec_ops.exec_outcome_catalog(F.col("sql"), F.col("schema_ddl"))
    scored = exec_ops.add_exec_once(rows, outcome, ["schema_ddl", "sql"])
    return scored.select("row_id", "exec_status", "exec")


@query
def score_exec_varied(spark, sf_dir):
    rows = _with_catalog(spark, sf_dir, scoring.add_sql(views.varied_completions(spark, sf_dir)))
    outcome = exec_ops.exec_outcome_catalog(F.col("sql"), F.col("schema_ddl"))
    return exec_ops.add_exec(rows, outcome).select("row_id", "exec_status", "exec")


@query
def schema_refs(spark, sf_dir):
    refs = scoring.add_refs(scoring.add_format(_with_sql(spark, sf_dir)))
    return refs.select(
        "row_id",
        F.array_join(F.array_sort("ref_tables"), ",").alias("ref_tables"),
        F.array_join(F.array_sort("ref_columns"), ",").alias("ref_columns"),
    )


@query
def schema_refs_by_scope(spark, sf_dir):
    rows = scoring.add_refs(scoring.add_format(views.statements(spark, sf_dir)))
    scored = scoring.add_fidelity(rows, DEFAULT_WEIGHTS["unknown_schema_item_penalty"])
    return scored.select(
        "doc_id",
        F.array_join(F.array_sort("ref_tables"), ",").alias("ref_tables"),
        F.array_join(F.array_sort("ref_columns"), ",").alias("ref_columns"),
        round4(F.col("schema_fidelity")).alias("schema_fidelity"),
    )


@query
def score_fidelity(spark, sf_dir):
    rows = scoring.add_refs(scoring.add_format(_with_sql(spark, sf_dir)))
    scored = scoring.add_fidelity(
        _with_catalog(spark, sf_dir, rows), DEFAULT_WEIGHTS["unknown_schema_item_penalty"]
    )
    return scored.select("row_id", "schema_fidelity")


def _scores(spark, sf_dir, weights) -> DataFrame:
    return score_with_catalog(views.completions(spark, sf_dir), views.table_catalog(spark, sf_dir), weights)


@query
def score_combined(spark, sf_dir):
    return _scores(spark, sf_dir, DEFAULT_WEIGHTS).select("row_id", "combined")


@query
def score_combined_built_in_weights(spark, sf_dir):
    return _scores(spark, sf_dir, BUILT_IN_WEIGHTS).select("row_id", "combined")


SCORE_COLUMNS = ("row_id", "source", "db_id", "sql_fence", "format", "exec", "schema_fidelity", "combined")


@query
def score_completions(spark, sf_dir):
    return _scores(spark, sf_dir, None).select(*SCORE_COLUMNS)


@query
def score_statements(spark, sf_dir):
    answers, outcomes = views.statement_answers(spark, sf_dir), views.statement_outcomes(spark, sf_dir)
    scored = scoring.score_completions(answers, completion="answer", outcomes=outcomes)
    return scored.select("doc_id", "exec_status", "sql_fence", "format", "exec", round4(F.col("schema_fidelity")).alias("schema_fidelity"), "combined")


@query
def score_completions_static(spark, sf_dir):
    scored = score_with_catalog(
        views.completions(spark, sf_dir), views.table_catalog(spark, sf_dir), backend="none"
    )
    return scored.select("row_id", "sql_fence", "format", "schema_fidelity", "combined")


@query
def score_spaced_extract(spark, sf_dir):
    scored = score_with_catalog(
        views.completions(spark, sf_dir), views.table_catalog(spark, sf_dir), backend="none",
        extract=sql_text.extract_sql_spaced,
    )
    return scored.select("row_id", "sql", "format")


@query
def custom_scorer(spark, sf_dir):
    rows = scoring.add_format(_with_sql(spark, sf_dir))
    registry = (
        scoring.ScorerRegistry()
        .add("format", lambda df: F.when(F.col("tokenizes"), 1.0).otherwise(0.0), 0.5)
        .add("brevity", lambda df: F.when(F.char_length("answer") <= 60, 1.0).otherwise(0.25), 0.3)
        .add("no_semicolon", lambda df: (~F.contains("answer", F.lit(";"))).cast("double"), 0.2)
    )
    return registry.score(rows).select("row_id", "format", "brevity", "no_semicolon", "combined")


# --- reports -------------------------------------------------------------------------


@query
def reward_report(spark, sf_dir):
    return reports.reward_report(_run_scores(spark, sf_dir))


@query
def metric_rows(spark, sf_dir):
    return reports.metric_rows(reports.reward_report(_run_scores(spark, sf_dir)))


@query
def reward_summary(spark, sf_dir):
    scored = _scores(spark, sf_dir, None).select(F.col("combined").alias("reward"))
    return reports.reward_summary(scored)


@query
def metric_summary(spark, sf_dir):
    return quantiles.metric_summary(views.metric_values(spark, sf_dir))


@query
def rollout_summary(spark, sf_dir):
    scored = views.rollouts(spark, sf_dir).select((F.col("reward_units") / F.lit(1e4)).alias("reward"))
    return reports.reward_summary(scored)


@query
def compare_runs(spark, sf_dir):
    return reports.compare_runs(_run_scores(spark, sf_dir), reference_run="baseline")


@query
def token_usage(spark, sf_dir):
    return reports.token_usage(views.tokens(spark, sf_dir))


@query
def token_cost(spark, sf_dir):
    prices = (("hosted", 1.25, 10.0), ("small", 0.15, 0.6))
    return reports.token_cost(views.tokens(spark, sf_dir), prices)


@query
def flatten_metrics(spark, sf_dir):
    return reports.flatten_metrics(views.metric_log(spark, sf_dir))


@query
def reward_crossings(spark, sf_dir):
    flat = reports.flatten_metrics(views.metric_log(spark, sf_dir))
    return reports.reward_crossings(flat, (10.0, 50.0, 98.0, 1000.0), metric="k")


@query
def group_advantage(spark, sf_dir):
    return groups.group_advantage(views.rollouts(spark, sf_dir)).select(
        "prompt_id", "db_id", "reward_units", "advantage"
    )


@query
def zero_variance_groups(spark, sf_dir):
    return groups.zero_variance_groups(views.rollouts(spark, sf_dir))


# --- streams -------------------------------------------------------------------------


def _stream(spark, sf_dir, name: str) -> DataFrame:
    file = f"{name}.parquet"
    schema = views.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(sf_dir)


@query
def flatten_metrics_stream(spark, sf_dir):
    log = views.metric_log_of(_stream(spark, sf_dir, "events"))
    path = scratch_path(spark, "metric-stream")
    append_metrics(metrics_stream(log), path, scratch_path(spark, "metric-progress")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


@query
def flatten_metrics_merged_stream(spark, sf_dir):
    log = views.metric_log_of(_stream(spark, sf_dir, "events"))
    path = scratch_path(spark, "metric-stream")
    append_metrics_merged(metrics_stream(log), path, scratch_path(spark, "metric-progress")).awaitTermination()
    return metrics_table.read_metrics(spark, path).drop("batch")


@query
def score_stream_query(spark, sf_dir):
    answers = views.completions_of(_stream(spark, sf_dir, "orders"), views.table(spark, sf_dir, "customer"))
    with_schema = lookup_join(answers, views.table_catalog(spark, sf_dir), "db_id")
    path = scratch_path(spark, "score-stream")
    scored = score_stream(with_schema).select(*SCORE_COLUMNS)
    append_to(scored, path, scratch_path(spark, "score-progress")).awaitTermination()
    return spark.read.parquet(path)

