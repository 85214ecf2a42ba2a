"""Near-duplicate classes of documents by the Jaccard similarity of their word shingles.

A grouped prefix join. Shingles are ordered globally, rarest first. If two sets are similar
enough they share a shingle among the first few of each in that order (its prefix), and
documents whose prefixes and sizes are the same stand or fall together as candidates: they form
one group. Pairs of groups that share a prefix shingle are filtered by size and position; what
passes is expanded to members, whose sets are then compared exactly.

How the work is kept in proportion to the input:

* Equal sets are one class from the start, whatever the number of copies.
* Counting every shingle of every text would shuffle the whole corpus several times over, to find
  that most shingles occur once. A first filter, exact as well, looks at the first third of each
  set in hash order only: similar sets share at least a twelfth of their sizes there. Only the
  documents that have that many repeated shingles in it go on to be counted and ordered in full.
* Shingles that occur once fill a prefix but can match nothing, so they are never indexed; a
  document whose prefix is all of that kind has no partner and leaves.
* A family of thousands of near copies would make all its pairs candidates, most of which only
  confirm what is known. So members are first compared with one pivot each, in a few rounds, of which the
  first takes the set in the middle of a family as its pivot; then all remaining pairs of groups are compared whose components still differ. Every pair of sets
  that could join two components is looked at, so no link that matters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import components
from quillon.llm.shingles import mix, places, segment_sums, set_blocks
from quillon.operators.joins import lookup_join
from quillon.session import stored

WORDS = 5
PERCENT = 75
PIVOT_ROUNDS = 2
_NONE = np.zeros(0, np.int64)


def _needed(n, percent: int):
    """Least overlap of a set of ``n`` with any set that is similar enough."""
    return (n * percent + 99) // 100


def _hash_prefix(n, percent: int):
    """Length of the prefix in hash order in which similar sets share :func:`_shared_there`."""
    return n - _needed(n, percent) + _shared_there(n)


def _shared_there(n):
    return np.maximum(1, n // 12)


def _sums(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit sum of each set that depends on all its members; the sets lie one after the other."""
    return segment_sums(mix(h + np.uint64(0x51ED)), sizes).view(np.int64)


def _other_sums(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    return segment_sums(mix(h ^ np.uint64(0xA3C59AC2B7F4D1E6)), sizes).view(np.int64)


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, by_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``; with ``by_text`` also ``text_hash, class_id``.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored. Two documents are
    linked if ``100 * shared >= percent * united`` of their sets of ``words``-word shingles
    (A-Z lower-cased; a text with fewer words is one shingle). ``component_id`` is the smallest
    id that links lead to.

    Null and wordless texts have an empty set and are linked with nothing, so their component is
    their own id. Rows without an id get their size, a null component, and take no part. Repeated
    rows come out as often as they went in; rows that share an id but not the text are compared
    as documents of their own: ``class_id``, unlike ``component_id``, tells their components apart, and ``text_hash`` (``xxhash64``) the texts. An empty
    input gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if by_text:
        docs = docs.withColumn("text_hash", F.xxhash64("text"))
    sizes = stored(_sizes(docs, words), "sizes")
    classes = stored(
        sizes.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n_shingles")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).coalesce(64)
        .withColumn("cid", F.monotonically_increasing_id()), "classes",
    )
    links = components(_links(docs, classes, words, percent))
    linked = classes.join(links.withColumnRenamed("id", "cid"), "cid", "left")
    linked = linked.withColumn("component", F.coalesce("component", "cid"))
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = stored(linked.join(smallest, "component").select("s1", "s2", "n_shingles", "component_id", "component"), "found")
    named = sizes.join(found, ["s1", "s2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    more = ["text_hash", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("class_id")] if by_text else []
    return named.select("doc_id", "n_shingles", own.alias("component_id"), *more)


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    """Size and two independent 64-bit sums of each set: equal sets have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(sizes, _sums(sizes, h), _other_sums(sizes, h)) for sizes, h in set_blocks(batch.column(1), words)]
            n, s1, s2 = (pa.array(np.concatenate([_NONE, *x])) for x in (list(zip(*found)) or [()] * 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n, s1, s2, *batch.columns[2:]],
                names=["doc_id", "n_shingles", "s1", "s2", *batch.schema.names[2:]],
            )

    more = "".join(f", {name} long" for name in docs.columns[2:])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long" + more)


def _first_shingles(docs: DataFrame, words: int, percent: int, keyed: bool) -> DataFrame:
    """The first shingles ``t`` of each set in hash order, if ``keyed`` with the sum ``s1`` of the set."""

    def batch_of(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*parts)]
        return pa.RecordBatch.from_arrays(columns, names=["t", "s1"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for sizes, h in set_blocks(batch.column(1), words):
                first = places(sizes) < np.repeat(_hash_prefix(sizes, percent), sizes)
                parts.append((h[first], np.repeat(_sums(sizes, h), sizes)[first]) if keyed else (h[first],))
                size += len(parts[-1][0])
                if size > 500_000:
                    yield batch_of(parts)
                    parts, size = [], 0
            if size:
                yield batch_of(parts)

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "t long, s1 long" if keyed else "t long")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """The whole sets: ``cid, n, h``. Texts whose set is not the wanted class's are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, size, row = [], 0, 0

            def out():
                rows, lens, flat = (np.concatenate(x) for x in zip(*sets))
                ends = np.cumsum(np.append(0, lens)).astype(np.int32)
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(lens), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                    names=["cid", "n", "h"],
                )

            asked = batch.column(2).to_numpy()
            for sizes, h in set_blocks(batch.column(1), words):
                right = _sums(sizes, h) == asked[row : row + len(sizes)]
                sets.append((row + np.flatnonzero(right), sizes[right], h[np.repeat(right, sizes)]))
                row += len(sizes)
                size += len(sets[-1][2])
                if size > 500_000:
                    yield out()
                    sets, size = [], 0
            if size:
                yield out()

    return docs.select("cid", "text", "s1").mapInArrow(run, "cid long, n long, h array<long>")


def _survivors(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Classes with enough repeated shingles at the front of their sets in hash order."""
    repeated = (
        _first_shingles(docs, words, percent, keyed=False).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
        .where("c > 1").select("t")
    )
    repeated = stored(repeated, "repeated")
    hits = (
        _first_shingles(docs, words, percent, keyed=True).join(repeated, "t")
        .groupBy("s1").agg(F.count(F.lit(1)).alias("hits"))
    )
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n_shingles") * percent / 100) / 12))
    return classes.join(hits, "s1").where(F.col("hits") >= least * F.col("copies"))


def _links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges ``a, b`` between classes that connect all that are linked."""
    wanted = stored(
        _survivors(docs, classes, words, percent)
        .select(F.col("first_id").alias("doc_id"), "cid", "s1"), "wanted",
    )
    sets = stored(_full_sets(_texts_of(docs, wanted), words), "sets")
    if sets.count() != wanted.count():  # rows that repeat both id and text
        sets = stored(sets.dropDuplicates(["cid"]), "sets")
    ordered = stored(_ordered(sets, percent), "ordered")
    groups = stored(_groups(ordered), "groups")
    index = stored(groups.where("cid = gid").select("gid", "n", "u", "central", F.posexplode("prefix").alias("pos", "t")), "index")
    edges = groups.where("cid != gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
    edges = stored(_verified(edges.unionByName(_pivots(index, None, 0)), ordered, percent), "links")
    for turn in range(1, PIVOT_ROUNDS + 1):
        units = stored(_units(groups, components(edges)), "units")
        if turn == PIVOT_ROUNDS:
            pairs = _remaining(index, units, percent)
        else:
            pairs = _pivots(index, units, turn)
        more = stored(_verified(pairs, ordered, percent), "links")
        edges = edges.unionByName(more)
    return edges


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted classes' first documents, and of any row that shares their ids."""
    return lookup_join(docs, wanted, "doc_id")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """Repeated shingles of each set, rarest first: ``cid, n, u, k, central, shared``.

    ``u`` shingles occur in no other set and come first; ``k`` of the shared ones belong to the
    prefix. ``central`` is the mean logarithm of how many sets hold each shingle: within a family of near copies it is highest for
    the set the others come from, which lacks none of the common ones. Sets without any are left out, they have no partner.
    """
    tokens = sets.select("cid", "n", F.explode("h").alias("t"))
    counts = stored(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    lists = tokens.join(counts, "t").groupBy("cid", "n").agg(
        F.sort_array(F.collect_list(F.struct("c", "t"))).alias("l")
    )
    n = F.col("n")
    prefix = n - F.floor((n * percent + 99) / 100) + 1
    u = n - F.size("l")
    return lists.select(
        "cid", "n", u.alias("u"), (prefix - u).cast("int").alias("k"),
        (F.aggregate("l", F.lit(0.0), lambda total, x: total + F.log(x["c"].cast("double"))) / n).alias("central"), F.transform("l", lambda x: x["t"]).alias("shared")
    ).where("k > 0")


def _groups(ordered: DataFrame) -> DataFrame:
    """``cid`` with its group ``gid``: the smallest class of the same size and prefix."""
    rows = ordered.select("cid", "n", "u", "central", F.slice("shared", F.lit(1), F.col("k")).alias("prefix"))
    heads = stored(rows.groupBy("n", "prefix").agg(F.min("cid").alias("gid")), "heads")
    return rows.join(heads, ["n", "prefix"]).select("cid", "gid", "n", "u", "central", "prefix")


def _units(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """``cid, gid, comp`` of every class that is a candidate."""
    rows = groups.select("cid", "gid").join(comps.withColumnRenamed("id", "cid"), "cid", "left")
    return rows.select("cid", "gid", F.coalesce("component", "cid").alias("comp"))


def _pivots(index: DataFrame, units: DataFrame | None, turn: int) -> DataFrame:
    """Each group with one pivot: the one that most of its prefix shingles have in common.

    The pivot of a shingle is the most central set that holds it: a set at the edge of a family is linked with few of
    the others, and all pairs of the rest would be left to compare. Later rounds take any other.
    """
    rows = index.select("t", "gid", "n", "central")
    comp = F.col("gid") if units is None else F.col("comp")
    if units is not None:
        heads = units.where("cid = gid").select("gid", "comp")
        rows = rows.join(heads, "gid")
    rows = rows.select("t", "gid", "n", "central", comp.alias("comp"))
    order = -F.col("central") if turn == 0 else F.xxhash64(F.col("gid"), F.lit(turn))
    first = F.min(F.struct(order.alias("o"), "gid", "comp", "n"))
    pivots = stored(
        rows.groupBy("t").agg(first.alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where("lo != hi").select("t", "p.gid", "p.comp", "p.n").toDF("t", "pivot", "pivot_comp", "pivot_n"), "pivots",
    )
    seen = rows.join(pivots, "t").where("comp != pivot_comp").groupBy("gid", "pivot").agg(F.count(F.lit(1)).alias("c"))
    best = seen.groupBy("gid").agg(F.max(F.struct("c", "pivot")).alias("x"))
    return best.select(F.col("x.pivot").alias("a"), F.col("gid").alias("b"))


def _remaining(index: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes in different components whose groups pass the filters.

    A shared shingle bounds what two sets have in common by what follows it in either, itself included, if it
    is the first they share. The filters of size and of that bound are conditions of the joins, first between
    components (by their most favourable members), then between groups.
    """
    heads = units.select("gid", "comp").distinct()
    rows = index.join(heads, "gid").select("t", "gid", "comp", "n", (F.col("n") - F.col("u") - F.col("pos")).alias("rest"))
    rows = stored(rows, "entries")
    comps = stored(
        rows.groupBy("t", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest")), "sides"
    )
    a, b = comps.alias("a"), comps.alias("b")
    pairs = a.join(b, F.expr(f"a.t = b.t AND a.comp < b.comp AND {_may_meet('a', 'b', percent)}")).select(
        F.col("a.t").alias("t"), F.col("a.comp").alias("comp_a"), F.col("b.comp").alias("comp_b"),
        F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), F.col("b.rest").alias("rest"),
    )
    pairs = stored(pairs, "crossing").alias("b")
    one = rows.select("t", "gid", "comp", F.col("n").alias("lo"), F.col("n").alias("hi"), "rest")
    met = one.alias("a").join(pairs, F.expr(f"a.t = b.t AND a.comp = b.comp_a AND {_may_meet('a', 'b', percent)}")).select(
        F.col("a.t").alias("t"), F.col("a.gid").alias("gid_a"), "comp_a", "comp_b", F.col("a.lo").alias("lo"),
        F.col("a.hi").alias("hi"), F.col("a.rest").alias("rest"),
    )
    met = met.alias("a").join(one.alias("b"), F.expr(f"a.t = b.t AND a.comp_b = b.comp AND {_may_meet('a', 'b', percent)}"))
    pairs = met.select("gid_a", "comp_a", F.col("b.gid").alias("gid_b"), "comp_b").distinct()
    left = units.select(F.col("cid").alias("a"), F.col("gid").alias("gid_a"), F.col("comp").alias("comp_a"))
    right = units.select(F.col("cid").alias("b"), F.col("gid").alias("gid_b"), F.col("comp").alias("comp_b"))
    return pairs.join(left, ["gid_a", "comp_a"]).join(right, ["gid_b", "comp_b"]).select("a", "b")


def _may_meet(a: str, b: str, percent: int) -> str:
    """Whether sizes from ``lo`` to ``hi`` of two sides allow the similarity, and what follows the shared shingle does."""
    sized = f"{a}.hi * 100 >= {b}.lo * {percent} AND {b}.hi * 100 >= {a}.lo * {percent}"
    return f"{sized} AND least({a}.rest, {b}.rest) * {100 + percent} >= ({a}.lo + {b}.lo) * {percent}"


def _verified(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough."""
    own = ordered.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("h_a"))
    other = ordered.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("h_b"))
    met = pairs.join(own, "a").join(other, "b")
    both = F.size(F.array_intersect("h_a", "h_b"))
    return met.withColumn("o", both).where(_similar(F.col("o"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _similar(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return shared * 100 >= (n_a + n_b - shared) * percent
