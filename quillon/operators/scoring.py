"""Scores of answers. Each ``add_*`` adds its columns and moves no rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.fixed_values import BUILT_IN_WEIGHTS, DEFAULT_WEIGHTS
from quillon.functions import schema_text, sql_text
from quillon.functions.numbers import round4
from quillon.functions.text import last_message_text
from quillon.operators import exec_check
from quillon.operators.joins import lookup_join, settled
from quillon.session import stored

Scorer = Callable[[DataFrame], Column]


def add_answer(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Adds ``answer``: the text of the last message."""
    return df.withColumn("answer", last_message_text(F.col(messages)))


def add_sql(
    df: DataFrame, answer: str = "answer", extract: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Adds ``fence_block`` and ``sql``; every score reads these two and extracts no more.

    ``extract`` may be another of the extraction functions; the default shares one scan for
    both columns.
    """
    with_block = df.withColumn("fence_block", sql_text.fence_block(F.col(answer)))
    if extract is None:
        bare = with_block.withColumn("_bare", sql_text.unrepaired_sql(F.col(answer), F.col("fence_block")))
        return bare.withColumn("sql", sql_text.repaired_sql(F.col("_bare"))).drop("_bare")
    return with_block.withColumn("sql", extract(F.col(answer)))


def add_fence(df: DataFrame, strict: bool = False, answer: str = "answer") -> DataFrame:
    """Adds ``sql_fence``: 1 if there is a fenced block. ``strict`` wants an ``sql`` tag."""
    found = sql_text.has_fence(F.col(answer), strict=True) if strict else F.col("fence_block") != ""
    return df.withColumn("sql_fence", F.when(found, 1.0).otherwise(0.0))


def add_format(df: DataFrame) -> DataFrame:
    """Adds ``tokenizes`` and ``format``: 1 if there is SQL and all its quotes are closed."""
    return df.withColumn("tokenizes", sql_text.tokenizes(F.col("sql"))).withColumn(
        "format", F.when(F.col("tokenizes"), 1.0).otherwise(0.0)
    )


def add_refs(df: DataFrame) -> DataFrame:
    """Adds ``ref_tables`` and ``ref_columns``, both empty if the SQL does not tokenize.

    Reads ``sql`` and ``tokenizes``.
    """
    tokens = F.when(F.col("tokenizes"), sql_text.sql_tokens(F.col("sql"))).otherwise(
        F.array().cast("array<string>")
    )
    marked = (
        df.withColumn("_tokens", tokens)
        .withColumn("_line", sql_text.token_line("_tokens"))
        .withColumn("_line_c", F.split("_line", ""))
        .withColumn("_marks", sql_text.name_roles(sql_text.scoped_line("_line")))
    )
    found = F.struct(
        sql_text.names_with_mark("_tokens", "_marks", "t").alias("tables"),
        sql_text.names_with_mark("_tokens", "_marks", "c").alias("columns"),
    )
    return (
        settled(marked.withColumn("_names", found), "_names", "_found")
        .withColumn("ref_tables", F.col("_found.tables"))
        .withColumn("ref_columns", F.col("_found.columns"))
        .drop("_tokens", "_line", "_line_c", "_marks", "_found")
    )


def fidelity(
    sql: Column, ref_tables: Column, ref_columns: Column, schema_tables: Column, schema_columns: Column,
    penalty: float = 0.0,
) -> Column:
    """Share of referenced names the schema knows; unknown ones may count negative.

    Without SQL 0; without a schema or without references 0.5. Tables and columns form one
    set of names.
    """
    every = F.size(F.array_union(ref_tables, ref_columns))
    valid = F.size(
        F.array_union(
            F.array_intersect(ref_tables, schema_tables), F.array_intersect(ref_columns, schema_columns)
        )
    )
    share = valid.cast("double") / F.nullif(every, F.lit(0)).cast("double")
    has_schema = F.coalesce(F.size(schema_tables) > 0, F.lit(False))
    return (
        F.when(sql.isNull(), F.lit(0.0))
        .when(~has_schema | (every == 0), F.lit(0.5))
        .otherwise(share + F.lit(float(penalty)) * (F.lit(1.0) - share))
    )


def add_fidelity(df: DataFrame, penalty: float = 0.0) -> DataFrame:
    """Adds ``schema_fidelity``.

    Uses ``schema_tables`` and ``schema_columns`` if the frame has them (see
    ``with_schema_names``), else works them out from ``schema``; without either, 0.5.
    """
    if "schema_tables" not in df.columns:
        if "schema" in df.columns:
            df = df.withColumn("schema_tables", schema_text.table_names(F.col("schema"))).withColumn(
                "schema_columns", schema_text.column_names(F.col("schema"))
            )
        else:
            nothing = F.array().cast("array<string>")
            df = df.withColumn("schema_tables", nothing).withColumn("schema_columns", nothing)
    score = fidelity(
        F.col("sql"), F.col("ref_tables"), F.col("ref_columns"), F.col("schema_tables"),
        F.col("schema_columns"), penalty,
    )
    return df.withColumn("schema_fidelity", score)


def resolve_weights(weights: Mapping[str, float] | None) -> dict[str, float]:
    """The weights with their defaults; format, exec and schema_fidelity are required."""
    chosen = dict(weights or DEFAULT_WEIGHTS)
    missing = [k for k in ("format", "exec", "schema_fidelity") if k not in chosen]
    if missing:
        raise ValueError(f"weights lack {missing}")
    chosen.setdefault("sql_fence", 0.0)
    chosen.setdefault("no_sql_penalty", BUILT_IN_WEIGHTS["no_sql_penalty"])
    chosen.setdefault("unknown_schema_item_penalty", 0.0)
    return chosen


def weights_from_config(config: Mapping[str, float], no_sql_penalty: float = -2.0) -> dict[str, float]:
    """Weights from a configuration that calls each score ``{name}_reward``.

    Scores it does not name have their built-in weight. What a missing ``no_sql_penalty``
    means has differed between training (-2) and evaluation (-1), so it is a parameter.
    """
    weights = {
        name: float(config.get(f"{name}_reward", BUILT_IN_WEIGHTS[name]))
        for name in ("format", "exec", "schema_fidelity", "sql_fence")
    }
    weights["no_sql_penalty"] = float(config.get("no_sql_penalty", no_sql_penalty))
    weights["unknown_schema_item_penalty"] = float(config.get("unknown_schema_item_penalty", 0.0))
    return weights


def weighted_sum(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of weight times score in the order of ``parts``, to four decimals."""
    total = None
    for name, column in parts.items():
        term = F.lit(float(weights[name])) * column
        total = term if total is None else total + term
    return round4(total)


def combined(weights: Mapping[str, float]) -> Column:
    """Combined score of the four score columns."""
    names = ("format", "exec", "schema_fidelity", "sql_fence")
    return weighted_sum({n: F.col(n) for n in names}, weights)


def add_recorded_exec(scored: DataFrame, outcomes: DataFrame, no_sql_penalty: float = -1.0) -> DataFrame:
    """Adds ``exec_status`` and ``exec`` from a table of outcomes: ``db_id, sql, exec_status`` (the largest of several counts).

    Statements were run elsewhere, by whatever engine they are for. One the table does not have is ``not_run`` and scores
    as one that failed. Only a hash of the statement is matched first, so that long texts are no join keys; equal hashes are told apart by the
    text itself. A statement that a third of the answers hold is joined in parts.
    """
    known = outcomes.groupBy("db_id", "sql").agg(F.max("exec_status").alias("exec_status"))
    by_hash = known.groupBy("db_id", F.xxhash64("sql").alias("_sql")).agg(F.collect_list(F.struct("sql", "exec_status")).alias("_known"))
    rows = lookup_join(scored.withColumn("_sql", F.xxhash64("sql")), stored(by_hash, "outcomes"), ["db_id", "_sql"], "left")
    same = F.filter("_known", lambda o: o["sql"] == F.col("sql"))
    status = F.when(F.col("sql").isNull(), "no_sql").otherwise(F.coalesce(F.get(same, F.lit(0))["exec_status"], F.lit("not_run")))
    rows = rows.withColumn("exec_status", status).drop("_sql", "_known")
    return rows.withColumn("exec", exec_check.exec_score(F.col("sql"), F.col("exec_status"), no_sql_penalty))


def score_answers(
    df: DataFrame, weights: Mapping[str, float] | None = None, exec_outcome: Column | None = None,
    strict_fence: bool = False, extract: Callable[[Column], Column] | None = None, outcomes: DataFrame | None = None,
) -> DataFrame:
    """All scores of a frame with an ``answer`` column, in one pass without a shuffle.

    With ``outcomes``, see :func:`add_recorded_exec`, nothing is run.

    ``exec_outcome`` is one of the outcome columns of ``exec_check``, written over ``sql``;
    without it, SQL is not run and counts as not runnable.
    """
    w = resolve_weights(weights)
    scored = add_format(add_fence(add_sql(df, extract=extract), strict_fence))
    if outcomes is not None:
        scored = add_recorded_exec(scored, outcomes, w["no_sql_penalty"])
    elif exec_outcome is None:
        scored = scored.withColumn(
            "exec", exec_check.exec_score(F.col("sql"), F.lit("not_run"), w["no_sql_penalty"])
        )
    else:
        scored = exec_check.add_exec(scored, exec_outcome, w["no_sql_penalty"])
    scored = add_fidelity(add_refs(scored), w["unknown_schema_item_penalty"])
    return scored.withColumn("combined", combined(w))


def score_completions(
    df: DataFrame, weights: Mapping[str, float] | None = None, backend: str = "catalog",
    database_root: str | None = None, messages: str = "messages", completion: str | None = None,
    strict_fence: bool = False, dialect: str = "sqlite",
    extract: Callable[[Column], Column] | None = None, outcomes: DataFrame | None = None,
) -> DataFrame:
    """Scores of a table of completions.

    With a table of ``outcomes`` (``db_id, sql, exec_status``) the scores of execution are taken from there, and ``backend`` is not used.

    The answer is the last of ``messages``, or the text column ``completion``. ``backend``:
    ``catalog`` runs SQL on empty copies made from the row's schema, ``files`` on database
    files under ``database_root``, ``none`` not at all. SQL is never translated, so the only
    dialect is SQLite.
    """
    if dialect != "sqlite":
        raise ValueError(f"unsupported dialect {dialect!r}")
    if completion:
        answered = df.withColumn("answer", F.coalesce(F.col(completion), F.lit("")))
    else:
        answered = add_answer(df, messages)
    if outcomes is not None:
        return score_answers(answered, weights, None, strict_fence, extract, outcomes)
    if backend == "catalog":
        if "schema_ddl" not in answered.columns:
            answered = answered.withColumn("schema_ddl", schema_text.empty_tables_ddl(F.col("schema")))
        outcome = exec_check.exec_outcome_catalog(F.col("sql"), F.col("schema_ddl"))
    elif backend == "files":
        if not database_root:
            raise ValueError("backend 'files' needs database_root")
        outcome = exec_check.exec_outcome_files(F.col("sql"), F.col("source"), F.col("db_id"), database_root)
    elif backend == "none":
        outcome = None
    else:
        raise ValueError(f"unknown backend {backend!r}")
    return score_answers(answered, weights, outcome, strict_fence, extract)


class ScorerRegistry:
    """Named scores a user can add to; their weighted sum is the combined score.

    A scorer takes the frame (with ``answer``, ``fence_block`` and ``sql``) and returns a
    column. A Python scorer is a ``pandas_udf`` applied to columns of that frame.
    """

    def __init__(self) -> None:
        self._scorers: dict[str, tuple[Scorer, float]] = {}

    def add(self, name: str, scorer: Scorer, weight: float) -> "ScorerRegistry":
        self._scorers[name] = (scorer, float(weight))
        return self

    def score(self, df: DataFrame, total: str = "combined") -> DataFrame:
        if not self._scorers:
            raise ValueError("no scorers added")
        for name, (scorer, _) in self._scorers.items():
            df = df.withColumn(name, scorer(df).cast("double"))
        weights = {n: w for n, (_, w) in self._scorers.items()}
        return df.withColumn(total, weighted_sum({n: F.col(n) for n in weights}, weights))
