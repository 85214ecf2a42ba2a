import math
import random

import numpy as np
from pyspark.sql import types as T

from quillon.llm.embedding_dedup import BAND_BITS, BANDS, codes_and_factors, estimates, vector_classes

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("cid", T.StringType()),
])


def brute(rows, threshold=0.98):
    def usable(e, label):
        return label is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e)

    unit = []
    for _, e, label in rows:
        x = np.array(e, np.float32).astype(float) if usable(e, label) else None
        unit.append(None if x is None else x / np.linalg.norm(x))
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] >= threshold:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((repr(rows[i][0]), len(links[i]), repr(component)))
    return sorted(out)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows if r.vec_id is not None and r.component_id is not None)
    return sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in rows)


def clusters(seed=3, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for size in (1, 1, 2, 5, 40):
            centre = rng.standard_normal(dim)
            for _ in range(size):
                x = centre + rng.standard_normal(dim) * 0.09 * rng.random() * np.linalg.norm(centre) / math.sqrt(dim)
                rows.append((len(rows), (x * rng.uniform(0.1, 9)).astype(np.float32).tolist(), label))
    return rows


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = clusters(dim=8) + [
        (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [nan] * 8, 1), (904, [inf] + [0.0] * 7, 1), (905, [1.0, None] + [0.0] * 6, 1),
        (906, [1.0] * 8, None), (907, [1.0] * 8, 5), (908, [2.0] * 8, 5), (907, [1.0] * 8, 5), (None, [1.0] * 8, 5), (None, None, None),
        (909, [1.0, 1.0], 5), (910, [3.0, 3.0], 5), (911, [1e-30] * 8, 5), (912, [1e30] * 8, 5), (913, [-1.0] * 8, 5),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert got(vector_classes(df)) == brute(rows)


def test_empty_table(spark):
    assert vector_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clusters_dealt_into_blocks(spark):
    rows = clusters()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert got(vector_classes(df, block=7)) == brute(rows) == got(vector_classes(df))


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + rng.standard_normal((200, 64)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, factors = codes_and_factors(x, BANDS, BAND_BITS)
    estimate, bound = estimates(codes, factors, x, 0.98)
    exact = x @ x.T
    error = (estimate - exact)[~np.eye(len(x), dtype=bool)]
    assert abs(error.mean()) < 0.001 and error.std() < 0.05
    assert (estimate + bound)[exact >= 0.98].min() >= 0.98
    assert (estimate + bound >= 0.98).sum() < 2 * (exact >= 0.98).sum() + 40


def test_recall_at_the_threshold(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        x = np.array([rng.gauss(0, 1) for _ in range(64)])
        x /= np.linalg.norm(x)
        y = np.array([rng.gauss(0, 1) for _ in range(64)])
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        cosine = 0.9802
        rows += [(2 * k, x.tolist(), 1), (2 * k + 1, (cosine * x + math.sqrt(1 - cosine**2) * y).tolist(), 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = sum(r.n_links for r in vector_classes(df).collect())
    assert found >= 0.99 * sum(n for _, n, _ in brute(rows))
