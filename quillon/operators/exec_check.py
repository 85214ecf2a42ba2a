"""Does the SQL run? The one step that leaves the JVM, as an Arrow-batched function.

Only source, database, SQL and (for the catalog backend) the statements for an empty copy
travel to Python. Each worker keeps a bounded set of open databases and of outcomes, so
repeated SQL is run once per task, and rows stay where they are: no shuffle, and no task per
database. Nothing of the SQL is trusted: read-only, no attached files, a step budget.
"""

from __future__ import annotations

import hashlib
import sqlite3
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.fixed_values import DATABASE_PATHS
from quillon.operators.joins import lookup_join, row_digest, settled
from quillon.session import stored

OPEN_DATABASES = 64
KEPT_OUTCOMES = 20_000
_STEPS_PER_CALL = 10_000

OUTCOME = T.StructType(
    [T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]
)

_DENIED = {sqlite3.SQLITE_ATTACH, sqlite3.SQLITE_DETACH}


class _Recent(OrderedDict):
    """A mapping that forgets its least recently used entries."""

    def __init__(self, size: int, drop: Callable | None = None):
        super().__init__()
        self.size, self.drop = size, drop

    def fetch(self, key, make: Callable):
        if key in self:
            self.move_to_end(key)
            return self[key]
        value = self[key] = make()
        if len(self) > self.size:
            _, old = self.popitem(last=False)
            if self.drop:
                self.drop(old)
        return value


def _guard(conn: sqlite3.Connection) -> sqlite3.Connection:
    conn.execute("PRAGMA query_only = ON")
    conn.set_authorizer(
        lambda action, *_: sqlite3.SQLITE_DENY if action in _DENIED else sqlite3.SQLITE_OK
    )
    return conn


def open_empty_copy(ddl: str) -> sqlite3.Connection:
    conn = sqlite3.connect(":memory:", isolation_level=None)
    conn.executescript(ddl)
    return _guard(conn)


def open_file(path: str) -> sqlite3.Connection:
    return _guard(sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, isolation_level=None))


def run_sql(conn: sqlite3.Connection, sql: str, budget: int | None) -> tuple[str, str | None]:
    """Outcome of one statement; no rows are fetched. With a ``budget`` of steps, one that takes more is a timeout."""
    left = [budget or 0]

    def tick() -> int:
        left[0] -= _STEPS_PER_CALL
        return left[0] < 0

    conn.set_progress_handler(tick if budget else None, _STEPS_PER_CALL)
    try:
        conn.execute(sql).close()
        return "ok", None
    except Exception as exc:  # whatever the SQL provokes is its outcome
        return ("timeout" if left[0] < 0 else "error"), str(exc)


def _is_query(sql: str) -> bool:
    return sql.lstrip()[:6].lower().startswith(("select", "values", "with"))


def _digest(place: str, sql: str) -> bytes:
    # What is remembered must stay small however long schemas and statements are.
    text = f"{len(place)}:{place}{sql}".encode("utf-8", "surrogatepass")
    return hashlib.blake2b(text, digest_size=16).digest()


def _checker(opener: Callable[[str], sqlite3.Connection], budget: int | None):
    databases = _Recent(OPEN_DATABASES, sqlite3.Connection.close)

    def check(place: str, sql: str) -> tuple[str, str | None]:
        try:
            conn = databases.fetch(place, lambda: opener(place))
        except Exception as exc:
            return "no_database", str(exc)
        outcome = run_sql(conn, sql, budget)
        if not _is_query(sql):
            # It may have changed the connection; the next statement gets a new one.
            databases.pop(place).close()
        return outcome

    return check


def _outcome_function(opener: Callable[[str], sqlite3.Connection], budget: int | None):
    @F.pandas_udf(OUTCOME)
    def outcomes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        check = _checker(opener, budget)
        known = _Recent(KEPT_OUTCOMES)
        for places, statements in batches:
            rows = []
            for place, sql in zip(places, statements):
                if not isinstance(sql, str):
                    rows.append(("no_sql", None))
                elif not isinstance(place, str):
                    rows.append(("no_database", "no database for this row"))
                else:
                    rows.append(known.fetch(_digest(place, sql), lambda: check(place, sql)))
            yield pd.DataFrame(rows, columns=["status", "error"])

    return outcomes


def database_path(source: Column, db_id: Column, root: str, templates: Mapping[str, str] = DATABASE_PATHS) -> Column:
    """Path of a database file; null for an unknown source or a missing database name."""
    path = F.lit(None).cast("string")
    for name, template in templates.items():
        before, *between = template.replace("{root}", root.rstrip("/")).split("{db_id}")
        pieces: list[Column] = [F.lit(before)]
        for text in between:
            pieces += [db_id, F.lit(text)]
        path = F.when(source == name, F.concat(*pieces)).otherwise(path)
    return F.when(db_id != "", path)


def exec_outcome_files(
    sql: Column, source: Column, db_id: Column, root: str, templates: Mapping[str, str] = DATABASE_PATHS,
    budget: int | None = None,
) -> Column:
    """``struct<status, error>`` of running each SQL on its database file.

    Steps are limited only where a ``budget`` of them is asked for.

    The root must be a folder all workers have mounted.
    """
    return _outcome_function(open_file, budget)(database_path(source, db_id, root, templates), sql)


def exec_outcome_catalog(sql: Column, ddl: Column, budget: int | None = None) -> Column:
    """``struct<status, error>`` of running each SQL on an empty copy of its database.

    Finds bad syntax, unknown names and writes, without any database file.
    """
    return _outcome_function(open_empty_copy, budget)(ddl, sql)


def exec_score(sql: Column, status: Column, no_sql_penalty: float) -> Column:
    """Penalty without SQL, 1 if it ran, else 0."""
    return (
        F.when(sql.isNull(), F.lit(float(no_sql_penalty)))
        .when(status == "ok", F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def add_exec(
    df: DataFrame, outcome: Column, no_sql_penalty: float = -1.0, sql: str = "sql"
) -> DataFrame:
    """Adds ``exec_status``, ``exec_error`` and ``exec``."""
    return (
        settled(df.withColumn("_ran", outcome), "_ran", "_outcome")
        .withColumn("exec_status", F.col("_outcome.status"))
        .withColumn("exec_error", F.col("_outcome.error"))
        .withColumn("exec", exec_score(F.col(sql), F.col("exec_status"), no_sql_penalty))
        .drop("_outcome")
    )


def add_exec_once(
    df: DataFrame, outcome: Column, keys: list[str], no_sql_penalty: float = -1.0, sql: str = "sql"
) -> DataFrame:
    """As :func:`add_exec`, but each distinct ``keys`` runs once over the whole table.

    For databases so slow that running a statement once per task is too much. ``keys`` name every
    column the outcome reads. Distinct statements are grouped by those columns, with copies reduced in a hash table
    before the shuffle, and stored, so a lost executor does not run them again. Their outcomes are joined back by a
    digest: broadcast while they are few, else shuffled with hot statements spread.
    """
    # Settled first: digest and filter read the keys several times, and finding the SQL of an answer is costly.
    held = settled(df.withColumn("_held", F.struct(*dict.fromkeys([*keys, sql]))), "_held", "_keys")
    keyed = held.withColumn("_statement", row_digest(*[f"_keys.{k}" for k in keys]))
    distinct = keyed.where(F.col(f"_keys.{sql}").isNotNull()).select("_statement", "_keys.*").distinct()
    known = stored(distinct.select("_statement", outcome.alias("_outcome")), "outcomes")
    joined = lookup_join(keyed.drop("_keys"), known, "_statement", "left").drop("_statement")
    return (
        joined.withColumn("exec_status", F.coalesce(F.col("_outcome.status"), F.lit("no_sql")))
        .withColumn("exec_error", F.col("_outcome.error"))
        .withColumn("exec", exec_score(F.col(sql), F.col("exec_status"), no_sql_penalty))
        .drop("_outcome")
    )
