"""A Merkle manifest of a table: one digest for all rows, and a proof for each row that it is among them.

Every row is a leaf. The leaves of a key (a language) stand in order, and every run of ``RUN`` neighbours gives
a parent, level by level, until one node is left; the keys' last nodes are joined to one root the same way. The
proof of a row is what its own runs hold besides its path: with the row's leaf it gives the root again.

A level is not a table of its own. All leaves stay rows, and a node lives in the row of its first leaf. The
first leaves of neighbouring nodes of a level are a fixed number of rows apart, so lag and lead columns of that offset,
masked by the node's slot in its run and by where the run ends, are its siblings; the rows of first children hash the parents.
Windows cover ``RUN ** LEVELS`` neighbouring leaves, never a whole key: they build that many levels over one sort, and the
nodes left go through the same step again, a thousandth as many each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import lookup_join
from quillon.session import stored

RUN = 2
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MODULUS = 7


def digest(*parts: Column) -> Column:
    """SHA-256 of texts put together, as lower-case hexadecimal text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its bytes in UTF-8, ``:`` and its value, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along the siblings of a path."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``_at``, their place from 0 within their key, and ``_n``, the key's rows.

    Rows are sorted into ranges and numbered inside each; ranges are counted per key, and the counts
    before a range are where it starts. No key meets in one task. Rows equal in all of ``order`` take any turn.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    counts = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(key)
    starts = counts.select(
        key, "_part", (F.sum("_c").over(whole.orderBy("_part")) - F.col("_c")).alias("_start"), F.sum("_c").over(whole).alias("_n")
    )  # a row per range and one more per further key in it
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    found = lookup_join(ranged, stored(starts, "starts"), [key, "_part"])
    return found.withColumn("_at", F.col("_start") + F.row_number().over(inside) - 1).drop("_part", "_start")


def _climbed(nodes: DataFrame, key: str, run: int, levels: int) -> DataFrame:
    """``nodes`` with ``_path``, the siblings over ``levels`` levels, and ``_top``, the node that is left in the row of its first leaf."""
    reach = run**levels
    rows = nodes.withColumns({"_chunk": F.floor(F.col("_at") / reach), "_top": F.col("_h")})
    window = Window.partitionBy(key, "_chunk").orderBy("_at")
    for level in range(levels):
        span = run**level
        slot = F.floor(F.col("_at") / span) % run
        beside = lambda function, j, mask: F.coalesce(F.when(mask, function("_top", j * span).over(window)), F.lit(""))
        rows = rows.withColumns({
            "_before": F.concat(*[beside(F.lag, j, slot >= j) for j in range(run - 1, 0, -1)]),
            "_after": F.concat(*[beside(F.lead, j, slot + j < run) for j in range(1, run)]),
        })
        open_level = F.col("_n") > span  # the key has several nodes here
        parent = F.when(open_level, digest(F.col("_top"), F.col("_after"))).otherwise(F.col("_top"))
        rows = rows.withColumns({
            f"_s{level}": F.when(open_level & F.col("_top").isNotNull(), F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"))),
            "_top": F.when(F.col("_at") % (span * run) == 0, parent),
        })
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.array(*[F.last(f"_s{level}", ignorenulls=True).over(upto) for level in range(levels)])
    rows = rows.withColumn("_path", F.filter(own, lambda s: s.isNotNull()))
    return rows.drop("_before", "_after", "_chunk", *[f"_s{level}" for level in range(levels)])


def with_paths(nodes: DataFrame, key: str, run: int = RUN, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes`` (``key, _at, _n`` of :func:`numbered`, and digests ``_h``): the nodes with ``_path``, and ``key, _root``."""
    reach, tiers = run**levels, []
    while True:
        tiers.append(stored(_climbed(nodes, key, run, levels), "tier"))
        nodes = tiers[-1].where(F.col("_at") % reach == 0).select(
            key, (F.col("_at") / reach).cast("long").alias("_at"), F.ceil(F.col("_n") / reach).alias("_n"), F.col("_top").alias("_h")
        )
        if nodes.where("_n > 1").isEmpty():
            break
    rows = tiers.pop().drop("_top")
    while tiers:
        above = stored(rows.select(key, F.col("_at").alias("_up"), F.col("_path").alias("_above")), "above")
        lower = tiers.pop().drop("_top").withColumn("_up", F.floor(F.col("_at") / reach))
        rows = lookup_join(lower, above, [key, "_up"])
        rows = rows.withColumn("_path", F.concat("_path", "_above")).drop("_up", "_above")
    return rows, nodes.select(key, F.col("_h").alias("_root"))


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, path`` of every row of ``docs``, and the small columns of ``carry``.

    ``docs`` has ``doc_id, source, lang, n_chars, text``; other columns are no part of a leaf. Leaves of a language ascend by ``doc_id``
    (null first), then by digest; languages ascend by their bytes, null first. ``path`` holds the siblings ``before`` and ``after`` the
    row's own node of each level, up to the root. Repeated rows are leaves of their own, any field may be null or empty, and an
    empty table gives an empty result.
    """
    carried = list(carry or ())
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("n")).alias("_key"), leaf(*[F.col(c) for c in FIELDS]).alias("_h"),
        *[column.alias(name) for name, column in (carry or {}).items()],
    )
    rows, subroots = with_paths(numbered(rows, "_key", "doc_id", "_h"), "_key", run, levels)
    tops = subroots.select("_key", F.col("_root").alias("_h"), F.lit(0).alias("_all"))
    tops, root = with_paths(numbered(tops, "_all", "_key"), "_all", run, levels)
    tops = tops.join(F.broadcast(root), "_all")  # one row
    tops = tops.select("_key", F.col("_h").alias("_subroot"), "_root", F.col("_path").alias("_above"))
    rows = lookup_join(rows, stored(tops, "subroots"), "_key")
    return rows.select(
        "doc_id", F.col("_h").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
        F.concat("_path", "_above").alias("path"), *carried,
    )


def checked_manifest(docs: DataFrame) -> DataFrame:
    """The manifest with a tampered copy of the table held against it.

    In the copy, rows whose ``doc_id`` has a CRC-32 that ``TAMPER_MODULUS`` divides have 1 added to ``n_chars`` (null stays null, and so does
    the largest number). ``folded_root`` is what a row's leaf in the copy and the original siblings give.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MODULUS == 0
    grown = F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))
    tampered = leaf(*[grown if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = manifest(docs, {"tampered": F.when(hit & F.col("n_chars").isNotNull(), tampered)})
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
