"""A toxicity score: a linear classifier on character n-grams scaled by naive Bayes ratios.

The features of a text are the distinct n-grams of its characters (lower case, all but letters as
blanks), hashed into ``2 ** BITS`` bins. From labelled texts each bin gets its log-count ratio, the
logarithm of how much more often toxic texts have it than others. Logistic regression is
then fitted on features of that size instead of one, so an n-gram that says nothing has no say. Bins that speak for toxicity
and bins that speak against it are used alike, if they do so beyond chance: the rest of a long text has many n-grams that a few toxic
texts happen to share, and they would speak louder than one telling word. Toxic texts of the sample together weigh as much
as all others, so the score does not shift with their share.

The fit reads a bounded sample: ``ROWS_PER_CLASS`` labelled texts of each class, those with
the smallest hashes of their ids, however many there are. Spark counts their n-grams and picks the telling bins; only
those of the sampled texts meet in one task, whose input the sample bounds. The weights, at most one per bin, go to all
tasks. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import stored

ROWS_PER_CLASS = 2000
SIZES = (4, 5, 6, 7, 8)
BITS = 20
REJECT_AT = 0.7
_LEAST_TEXTS = 2  # of the sample that have an n-gram
_LEAST_RATIO = 0.5  # of either sign
_LEAST_G2 = 8.0  # log-likelihood ratio statistic of an n-gram and the label
_DECAY = 1e-3
_STEPS = 300
_RATE = 0.05

_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


@dataclass(frozen=True)
class Model:
    """Weights of the bins that have one, and the score's logarithmic odds without any."""

    bins: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.bins] = self.weights
        return out


def ngram_bins(text: str | None) -> list[np.ndarray]:
    """The bins of all n-grams of a text, by size, repeats included."""
    letters = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.where(letters < 128, _PLAIN[np.minimum(letters, 127)], letters)
    h = letters.copy()
    out = []
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + letters[n - 1 :] if len(h) > 1 else h[:0]
        if n in SIZES:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return out


def training_fold(doc_id: Column) -> Column:
    """Whether a row may be learned from: two of three, by the CRC-32 of the id written as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, every_label: bool = False) -> Model:
    """A model from the rows of ``labels`` (``doc_id, toxic``) in the training fold, or from every one.

    Null labels and ids are passed over; of several labels of a document the largest counts. Documents without
    text are learned from as empty ones. If one class has no rows, the score is the smoothed share
    of toxic labels for every text.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.lit(every_label) | training_fold(F.col("doc_id")))
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(*order).limit(rows_per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = stored(picked, "picked")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(picked), "doc_id")  # at most rows_per_class ids of each class

    rows = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}  # two rows
    n_toxic, n_other = rows.get(1, 0), rows.get(0, 0)
    none = np.zeros(0, np.int64)
    if not n_toxic + n_other:
        return Model(none, none.astype(np.float32), 0.0)
    if not n_toxic or not n_other:
        return Model(none, none.astype(np.float32), float(np.log((n_toxic + 0.5) / (n_other + 0.5))))

    sample = texts.select("doc_id", "toxic", "text")
    counts = sample.mapInPandas(_counted, "bin int, toxic long, texts long").groupBy("bin").agg(
        F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")
    )
    told = counts.where(F.col("texts") >= _LEAST_TEXTS).mapInPandas(_telling(n_toxic, n_other), "bin int, ratio double")
    told = told.toPandas().sort_values("bin")  # at most one row per bin
    at, ratio = told["bin"].to_numpy(np.int64), told["ratio"].to_numpy(np.float64)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.flatnonzero(_has(t)[at]).astype(np.int32) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "features": found, "all": 1})

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        model = _fit(frame["toxic"].to_numpy(np.float64), list(frame["features"]), at, ratio)
        return pd.DataFrame({"bin": [-1, *model.bins.tolist()], "weight": [model.bias, *model.weights.tolist()]})

    features = sample.mapInPandas(featured, "doc_id long, toxic int, features array<int>, all int")
    rows = features.groupBy("all").applyInPandas(fitted, "bin int, weight double").toPandas()
    bins, weights = rows["bin"].to_numpy(np.int64), rows["weight"].to_numpy(np.float64)
    return Model(bins[bins >= 0], weights[bins >= 0].astype(np.float32), float(weights[bins < 0][0]))


def _has(text: str | None) -> np.ndarray:
    """Whether a text has an n-gram of each bin."""
    out = np.zeros(1 << BITS, dtype=bool)
    for bins in ngram_bins(text):
        out[bins] = True
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts per bin, toxic ones and all, of one task: at most one row per bin."""
    toxic, texts = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"]):
            has = _has(text)
            texts += has
            if label:
                toxic += has
    at = np.flatnonzero(texts)
    for part in np.array_split(at, max(1, len(at) // 100_000)):
        yield pd.DataFrame({"bin": part.astype(np.int32), "toxic": toxic[part], "texts": texts[part]})


def _telling(n_toxic: int, n_other: int):
    """Of counted bins (``bin, toxic, texts``), those that go with either label beyond chance, with their log-count ratios."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy(np.float64)
            other = batch["texts"].to_numpy(np.float64) - toxic
            ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((other + 1) / (n_other + 2))
            used = (np.abs(ratio) >= _LEAST_RATIO) & (_g2(toxic, other, n_toxic, n_other) >= _LEAST_G2)
            yield pd.DataFrame({"bin": batch["bin"][used], "ratio": ratio[used]})

    return run


def _g2(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """How unlikely it is that toxic and other texts with an n-gram are as many by chance."""
    have, total = toxic + other, n_toxic + n_other
    tiny = 1e-9
    part = lambda seen, expected: seen * np.log(np.maximum(seen, tiny) / np.maximum(expected, tiny))
    rest = total - have
    return 2 * (
        part(toxic, have * n_toxic / total) + part(other, have * n_other / total)
        + part(n_toxic - toxic, rest * n_toxic / total) + part(n_other - other, rest * n_other / total)
    )


def _fit(y: np.ndarray, features: list[np.ndarray], at: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression; ``features`` of each text are places in ``at``, the bins with the given ratios."""
    positive = y.sum()
    row = np.repeat(np.arange(len(y)), [len(f) for f in features])
    column = np.concatenate(features).astype(np.int64)
    value = ratio[column]
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (len(y) - positive))
    w, bias = np.zeros(len(at)), 0.0
    slope, size = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    for step in range(1, _STEPS + 1):
        odds = np.bincount(row, value * w[column], len(y)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(odds, -60, 60))) - y)
        gradient = np.append(np.bincount(column, value * error[row], len(at)) + _DECAY * w, error.sum())
        slope = 0.9 * slope + 0.1 * gradient
        size = 0.99 * size + 0.01 * gradient * gradient
        move = _RATE * (slope / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = (w * ratio).astype(np.float32)
    told = np.abs(weights) > 1e-4
    return Model(at[told], weights[told], float(bias))


def score(model: Model):
    """A column function: the score of each text, 0 to 1; null is scored as an empty text."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = model.table()
        for texts in batches:
            odds = np.empty(len(texts))
            for i, text in enumerate(texts):
                found = []
                for bins in ngram_bins(text):
                    weighted = table[bins]
                    found.append(bins[weighted != 0])
                odds[i] = model.bias + float(table[np.unique(np.concatenate(found))].sum(dtype=np.float64))
            yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -700, 700))))

    return scored


def with_score(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, every_label: bool = False) -> DataFrame:
    """``docs`` with ``score``: how likely each whole text is toxic, learned from ``labels`` of the training fold, or from every one.

    Null and empty texts get the score of no n-grams; repeated rows get equal scores; columns other than ``doc_id`` and ``text``
    are passed through unread, and a column ``score`` is replaced. An empty table gives an empty result.
    """
    model = fit(docs, labels, rows_per_class, every_label)
    return docs.withColumn("score", score(model)(F.col("text").cast("string")))
