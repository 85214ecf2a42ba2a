"""Helpers shared by the operators: reading tables, fixed patterns, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import stored

#: A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``a, b`` (longs): ``id, component`` with the smallest id.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by
    doubling (so a chain of any length takes logarithmically many steps), and goes on with the
    edges that still lead from one end to another. All states are written tables: a lost
    executor costs a re-read, and nothing but emptiness tests reaches the driver. Loops and
    repeated edges are allowed; ids without an edge to another id are not returned.
    """
    edges = stored(_tidy(edges), "edges")
    mapping = None
    while not edges.isEmpty():
        parent = stored(_hooked(edges), "parent")
        mapping = parent if mapping is None else stored(_followed(mapping, parent, keep_new=True), "mapping")
        at = parent.select(F.col("id").alias("a"), F.col("component").alias("x"))
        to = parent.select(F.col("id").alias("b"), F.col("component").alias("y"))
        moved = edges.join(at, "a").join(to, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = stored(_tidy(moved), "edges")
    if mapping is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return mapping


def _tidy(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.where(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct()


def _hooked(edges: DataFrame) -> DataFrame:
    """Every node of the edges with the end of its chain of smallest neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = stored(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
        .select("id", F.least("id", "m").alias("component")), "hooks",
    )
    while True:
        after = stored(_followed(parent, parent), "hooks")
        moved = after.where("moved").isEmpty()
        parent = after.drop("moved")
        if moved:
            return parent


def _followed(mapping: DataFrame, parent: DataFrame, keep_new: bool = False) -> DataFrame:
    """``mapping`` with each component replaced by that component's own one in ``parent``."""
    step = parent.select(F.col("id").alias("component"), F.col("component").alias("further"))
    out = mapping.join(step, "component", "left")
    further = F.coalesce("further", "component")
    if not keep_new:
        return out.select("id", further.alias("component"), (further != F.col("component")).alias("moved"))
    return out.select("id", further.alias("component"))
