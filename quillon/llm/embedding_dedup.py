"""Near duplicates among embedding vectors by randomly rotated binary codes.

Each vector is scaled to length one, padded, rotated at random and kept as the signs of its
coordinates: a corner of the cube, its code. The product ``<o, q>`` of two unit vectors is
estimated without bias as ``<code(o), q> / <code(o), o>``; the divisor, the factor of ``o``, is
stored with the code. But for a probability that falls with ``exp(-EPSILON ** 2 / 2)`` the error is within
``EPSILON`` times ``sqrt((1 - f * f) / (f * f * (D - 1)))`` times the sine of the angle. A pair whose upper bound
is below the threshold is dismissed; all others are recomputed exactly, in double precision, so that nothing below
the threshold is ever linked.

Pairs are looked for inside bands of the code: vectors that are nearly parallel agree in most
signs, and meet in at least one of ``BANDS`` bands of ``BAND_BITS`` signs. The bits of a band come
from rotations of their own, so bands are independent. At an angle of 11.5 degrees a sign differs with
probability 0.064, so a pair at the threshold misses all bands with probability 0.00005.

A bucket of a band may be large (a tight cluster is one whole bucket in most bands). It is dealt
into blocks, and pairs of blocks are the units of work, so no task holds a bucket. A unit reports the
links of each vector as a count, and joins as a spanning forest, never as pairs; a pair is counted only in the
first band its codes agree in. Equal vectors are one from the start, with their number as weight.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import components
from quillon.session import stored

THRESHOLD = 0.98
BANDS = 32
BAND_BITS = 20
EPSILON = 5.0
BLOCK = 512
PACK = 4000
SEED = 20240229


@functools.lru_cache(maxsize=8)
def rotations(dim: int, bands: int, bits: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrices one below the other, at least ``bands * bits`` rows of ``dim``."""
    rng = np.random.default_rng([seed, dim])
    rows = []
    while sum(map(len, rows)) < bands * bits:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        rows.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(rows)


def _unit(column: pd.Series, dim: int) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64).reshape(len(column), dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes_and_factors(x: np.ndarray, bands: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of all rotated coordinates (rows of 0 and 1) and the correction factor of each vector."""
    turned = x @ rotations(x.shape[1], bands, bits).T
    blocks = turned.shape[1] / x.shape[1]
    factor = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]) / np.sqrt(blocks)
    return (turned >= 0).astype(np.uint8), factor


def estimates(
    codes: np.ndarray, factors: np.ndarray, x: np.ndarray, threshold: float, bands: int = BANDS, bits: int = BAND_BITS,
) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the products of coded vectors (rows) with unit vectors ``x`` (columns), and the
    distance below the threshold that a product of at least ``threshold`` is not estimated beyond.

    The rotations lie one below the other, so a vector and its code are points of a space with as
    many dimensions as the code has bits, in which vectors keep their angles. The part of a code that is
    not along its vector points anywhere, so it adds an error of mean zero that shrinks with the sine of the angle.
    """
    n_bits, dim = codes.shape[1], x.shape[1]
    turned = (x @ rotations(dim, bands, bits).T / np.sqrt(n_bits / dim)).astype(np.float32)
    signs = (codes.astype(np.float32) * 2 - 1) / np.sqrt(np.float32(n_bits))
    f = np.minimum(factors, 1.0)[:, None]
    spread = np.sqrt((1 - f * f) / (f * f) / (n_bits / dim * max(dim - 1, 1)))
    return signs @ turned.T / f, EPSILON * spread * np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-5


def _valid(column: str) -> str:
    usable = f"size({column}) > 0 AND NOT exists({column}, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))"
    return f"{column} IS NOT NULL AND {usable} AND exists({column}, v -> v != 0)"


def vector_classes(
    vectors: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, bits: int = BAND_BITS, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    ``vectors`` has ``vec_id`` (long), ``embedding`` (array of float or double) and ``label``; other columns are
    ignored. Vectors of equal label and length are linked if their cosine is at least
    ``threshold``. ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest id that links
    lead to, ``kept`` marks the vector with that id.

    Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without
    label, are linked with nothing: no links, their own component, kept. Rows without an id count
    as links of others but have no component of their own (null, and ``kept`` is null) unless they
    are linked to rows that have one. Repeated rows are linked with each other. An empty table gives an empty result.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"), "label"
    ).withColumn("ok", F.expr(f"label IS NOT NULL AND {_valid('e')}"))
    good = rows.where("ok")
    distinct = stored(
        good.groupBy("label", "e").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first_id"))
        .withColumn("cid", F.monotonically_increasing_id()), "vectors",
    )
    met = stored(_met(distinct, threshold, bands, bits, block), "met")
    links = met.where("other IS NULL").groupBy("cid").agg(F.sum("n").alias("n"))
    edges = met.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    named = distinct.join(components(edges).withColumnRenamed("id", "cid"), "cid", "left").join(links, "cid", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "cid")), "named")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = named.join(smallest, "component").select(
        "label", "e", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"
    )
    linked = good.select("vec_id", "label", "e").join(stored(found, "found"), ["label", "e"]).select(
        "vec_id", "n_links", "component_id"
    )
    alone = rows.where("ok IS NOT TRUE").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _met(distinct: DataFrame, threshold: float, bands: int, bits: int, block: int) -> DataFrame:
    """Links found: rows ``cid, n`` count a vector's, rows ``cid, other`` are edges that join what is linked."""
    coded = stored(_coded(distinct, bands, bits), "codes")
    key = ["label", "dim", "band", "bucket"]
    rows = coded.select("label", "dim", "cid", F.posexplode("buckets").alias("band", "bucket"))
    sizes = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    placed = rows.join(sizes, key).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Every block of a bucket meets every other one, and itself.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    placed = placed.select("cid", "band", "mine", lo.alias("lo"), hi.alias("hi"), F.xxhash64(*key, lo, hi).alias("unit"))
    placed = stored(placed, "placed")
    packs = max(1, placed.count() // PACK)
    vectors = coded.select("cid", "dim", "buckets", "code", "factor", "m", "e")
    units = placed.join(vectors, "cid").withColumn("pack", F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(packs)))

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        found = [
            _compared(part, lo, hi, band, threshold, bands, bits)
            for (_, dim, band, lo, hi), part in frame.groupby(["unit", "dim", "band", "lo", "hi"])
        ]
        return pd.concat([f for f in found if len(f)] or [_NOTHING])

    return units.groupBy("pack").applyInPandas(compared, "cid long, n long, other long")


_NOTHING = pd.DataFrame({"cid": pd.array([], "int64"), "n": pd.array([], "Int64"), "other": pd.array([], "Int64")})


def _coded(distinct: DataFrame, bands: int, bits: int) -> DataFrame:
    """Each vector with its code, its correction factor and its bucket in each band."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for frame in frames:
            for dim, part in frame.groupby(frame["e"].map(len)):
                codes, factors = codes_and_factors(_unit(part["e"], int(dim)), bands, bits)
                buckets = codes[:, : bands * bits].reshape(len(part), bands, bits) @ weights
                yield part.assign(
                    dim=int(dim), buckets=list(buckets), factor=factors,
                    code=[row.tobytes() for row in np.packbits(codes, axis=1)],
                )[["label", "e", "cid", "m", "dim", "buckets", "code", "factor"]]

    kind = dict(distinct.dtypes)
    schema = (
        f"label {kind['label']}, e {kind['e']}, cid long, m long, dim int, buckets array<long>, code binary, factor double"
    )
    return distinct.select("label", "e", "cid", "m").mapInPandas(run, schema)


def _compared(
    rows: pd.DataFrame, lo: int, hi: int, band: int, threshold: float, bands: int, bits: int,
) -> pd.DataFrame:
    """Two blocks of a bucket, or one with itself."""
    rows = rows.sort_values("cid")
    left, right = rows[rows["mine"] == lo], rows[rows["mine"] == hi]
    same = lo == hi
    if left.empty or right.empty or same and len(left) < 2:
        return _NOTHING
    dim = int(rows["dim"].iat[0])
    n_bits = len(rotations(dim, bands, bits))
    codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
    x, y = _unit(left["e"], dim), _unit(right["e"], dim)
    estimate, bound = estimates(
        np.unpackbits(codes, axis=1)[:, :n_bits], left["factor"].to_numpy(), y, threshold, bands, bits
    )
    unsettled = estimate + bound >= threshold
    if same:
        unsettled &= np.triu(np.ones(unsettled.shape, bool), 1)
    i, j = np.nonzero(unsettled)
    at_left, at_right = np.stack(left["buckets"].to_numpy()), np.stack(right["buckets"].to_numpy())
    linked = np.zeros(len(i), bool)
    for start in range(0, len(i), 1 << 15):
        part = slice(start, start + (1 << 15))
        new = ~(at_left[i[part], :band] == at_right[j[part], :band]).any(axis=1)  # has not met in an earlier band
        linked[part] = new & (np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= threshold)
    i, j = i[linked], j[linked]
    if not len(i):
        return _NOTHING
    if same:
        ids, m = left["cid"].to_numpy(), left["m"].to_numpy()
    else:
        ids = np.concatenate([left["cid"].to_numpy(), right["cid"].to_numpy()])
        m = np.concatenate([left["m"].to_numpy(), right["m"].to_numpy()])
        j = j + len(left)
    n = np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
    counted = np.flatnonzero(n)
    joined = np.array(_forest(i, j, len(ids)), dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({
        "cid": np.concatenate([ids[counted], ids[joined[:, 0]]]),
        "n": pd.array([*n[counted].astype(np.int64).tolist(), *[None] * len(joined)], dtype="Int64"),
        "other": pd.array([*[None] * len(counted), *ids[joined[:, 1]].tolist()], dtype="Int64"),
    })


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs, at most one per vector."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    kept, left = [], n - 1
    for u, v in zip(i.tolist(), j.tolist()):
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((u, v))
            left -= 1
            if not left:
                break
    return kept
