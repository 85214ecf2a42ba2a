"""Reading and writing schema catalogs."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.fixed_values import SQLITE_MAGIC, SQLITE_SUFFIXES, TABLES_JSON_NAME
from quillon.functions.schema_text import SCHEMA_TYPE
from quillon.operators.catalog import catalog_from_records, merge_catalogs

RECORD_TYPE = (
    "db_id string, table_names_original array<string>, column_names_original array<array<string>>, "
    "table_names array<string>, column_names array<array<string>>"
)


def read_tables_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Catalog from table-list files, one JSON array per file, or one record per line.

    A file holding one array is read by one task; lines are split between tasks.
    """
    reader = spark.read.schema(RECORD_TYPE).option("multiLine", not lines)
    return catalog_from_records(reader.json(path))


def read_listed_catalogs(spark: SparkSession, root: str, name: str = TABLES_JSON_NAME) -> DataFrame:
    """Every table-list file under a folder; ``ordinal`` is the path and the place in the file, so later paths and later records win.

    A file is one JSON text, so one task reads it and its rows are numbered in order.
    """
    records = (
        spark.read.schema(RECORD_TYPE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(root)
    )
    return catalog_from_records(records.withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"))), keep=["ordinal"])


# --- SQLite files --------------------------------------------------------------------


def _tables_of(conn: sqlite3.Connection) -> list[dict]:
    names = [row[0] for row in conn.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
    described = {}
    for name in names:
        quoted = name.replace('"', '""')
        described[name.lower()] = [row[1].lower() for row in conn.execute(f'PRAGMA table_info("{quoted}")')]
    return [{"name": n, "columns": c} for n, c in described.items()]


def _describe(open_database) -> tuple[list[dict] | None, str | None]:
    try:
        conn = open_database()
        try:
            return _tables_of(conn), None
        finally:
            conn.close()
    except Exception as exc:  # an unreadable file is a row with an error, not a failed job
        return None, str(exc)


class _ImageReader:
    """Describes images one after the other over one connection, as opening one costs as much as describing a small image.

    No statement is kept from one image to the next, and after an error the connection is a new one.
    """

    def __init__(self):
        self.conn = None

    def describe(self, content: bytes) -> tuple[list[dict] | None, str | None]:
        try:
            if self.conn is None:
                self.conn = sqlite3.connect(":memory:", cached_statements=0)
            self.conn.deserialize(content)
            return _tables_of(self.conn), None
        except Exception as exc:  # an unreadable image is a row with an error, not a failed job
            if self.conn is not None:
                self.conn.close()
            self.conn = None
            return None, str(exc)


SCAN_TYPE = f"path string, db_id string, schema {SCHEMA_TYPE}, error string"


def _database_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def is_database_path(path):
    """Known suffix in any case, not a resource fork, not under an archive's shadow folder."""
    name = F.substring_index(path, "/", -1)
    suffix = F.lower(F.substring_index(name, ".", -1))
    return (
        suffix.isin(*SQLITE_SUFFIXES)
        & F.contains(name, F.lit("."))
        & ~name.startswith("._")
        & ~path.rlike("(^|/)__MACOSX(/|$)")
    )


def scan_images(images: DataFrame) -> DataFrame:
    """Catalog rows from database images: ``path`` and ``content``.

    Images without the SQLite header are left out; unreadable ones give an ``error``. Each
    image is described by itself, one at a time, wherever it lies. A row function without Arrow gets a hundred rows at a time,
    so a worker never holds thousands of images.
    """
    header = F.substring("content", 1, len(SQLITE_MAGIC))
    wanted = images.where(is_database_path(F.col("path")) & (header == F.lit(SQLITE_MAGIC.encode())))

    reader = _ImageReader()

    @F.udf(f"struct<schema:{SCHEMA_TYPE},error:string>", useArrow=False)
    def described(content):
        return reader.describe(bytes(content))

    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*\z", "")
    # Unfolding a list of one keeps filters on what was found above the function, which runs once.
    return wanted.select("path", name.alias("db_id"), F.inline(F.array(described("content"))))


def scan_sqlite_folder(spark: SparkSession, root: str, mounted: bool = True) -> DataFrame:
    """Catalog rows of every SQLite file below a folder: ``path, db_id, schema, error``.

    ``mounted``: all workers see the folder as local files, so a database is opened in place
    and only its schema pages are read. A file that a worker cannot open fails the job: the
    folder is not mounted there. Otherwise whole files are read as images.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    )
    if not mounted:
        return scan_images(listing)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote, urlparse

        for batch in batches:
            rows = []
            for path in batch["path"]:
                local = unquote(urlparse(path).path)
                with open(local, "rb") as handle:
                    magic = handle.read(16)
                if not magic.startswith(SQLITE_MAGIC.encode()):
                    continue
                tables, error = _describe(lambda p=local: _open_read_only(p))
                rows.append((path, _database_name(local), tables, error))
            yield pd.DataFrame(rows, columns=["path", "db_id", "schema", "error"])

    return listing.where(is_database_path(F.col("path"))).select("path").mapInPandas(describe, SCAN_TYPE)


def _open_read_only(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def scanned_catalogs(scan: DataFrame) -> DataFrame:
    """Readable scanned databases as input of a merge; the first path of a name wins."""
    readable = scan.where(F.col("error").isNull())
    return readable.select("db_id", "schema", F.col("path").alias("ordinal"))


def build_catalog(spark: SparkSession, root: str, mounted: bool = True) -> DataFrame:
    """The catalog of a raw data folder: table lists first, then files not listed."""
    return merge_catalogs(
        read_listed_catalogs(spark, root), scanned_catalogs(scan_sqlite_folder(spark, root, mounted))
    )


# --- catalog files -------------------------------------------------------------------

_NAMED = "map<string,array<string>>"


def _from_named(named):
    entries = F.map_entries(named)
    return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("columns")))


def load_catalog(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Catalog from JSON.

    ``lines``: one ``{"db_id", "schema"}`` object per line (what ``write_catalog`` writes, split
    between tasks). ``array``: one list of such objects per file. ``dict``: one object of
    ``db_id: schema`` per file. Schemas are objects of table name to column list.
    """
    if layout in ("lines", "array"):
        reader = spark.read.schema(f"db_id string, schema {_NAMED}").option("multiLine", layout == "array")
        return reader.json(path).select("db_id", _from_named(F.col("schema")).alias("schema"))
    if layout == "dict":
        text = spark.read.text(path, wholetext=True)
        named = F.from_json("value", f"map<string,{_NAMED}>")
        return text.select(F.explode(named).alias("db_id", "named")).select(
            "db_id", _from_named(F.col("named")).alias("schema")
        )
    raise ValueError(f"unknown layout {layout!r}")


def load_catalog_if_present(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """As :func:`load_catalog`, but a missing path gives an empty catalog."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"db_id string, schema {SCHEMA_TYPE}")
    return load_catalog(spark, path, layout)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, on whatever file system, is there."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise


def write_catalog(catalog: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Catalog as JSON lines, sorted by database over all files."""
    named = F.map_from_entries(
        F.transform("schema", lambda t: F.struct(t["name"].alias("key"), t["columns"].alias("value")))
    )
    catalog.select("db_id", named.alias("schema")).orderBy("db_id").write.mode(mode).json(path)


def write_catalog_parquet(catalog: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Catalog with its nested schema, sorted by database."""
    catalog.select("db_id", "schema").orderBy("db_id").write.mode(mode).parquet(path)
