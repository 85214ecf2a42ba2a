"""Quality rules: fixed counts of a text, and how much more it reads like trusted text than like the corpus.

Tokens are runs of letters, digits and underscores, or runs of other characters that are not blank, so marks count as well as words.
Single tokens and neighbouring pairs are hashed into ``2 ** BITS`` bins. Two multinomials over the bins are counted in
full: one over all documents, one over the trusted ones. A bin weighs the logarithm of its trusted count over
the count that the corpus would have given a text mass of that size, both smoothed by the same number, so bins that say
little weigh little, at any size of the tables. A document's score is the mean weight of its n-grams, and it is kept
if that is at least a fixed limit: no draws, the same verdict on every run.

Weights are whole numbers (``UNIT`` to one), so sums do not depend on their order.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.joins import lookup_join
from quillon.session import stored

BITS = 18
SMOOTHING = 8.0
UNIT = 1 << 20
LEAST_SCORE = -0.12
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
_COUNT_AT_ONCE = 1 << 21  # n-grams in memory
_BLANKS = " \t\n\v\f\r"
_TOKENS = re.compile(r"\w+|[^\w\x20\x09-\x0D]+").findall
_QUALITY = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score_sum long, n_grams long"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


@functools.lru_cache(maxsize=1 << 17)
def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4])


def gram_bins(text: str | None) -> np.ndarray:
    """The bins of all tokens and neighbouring pairs of a text, repeats included."""
    h = np.array([_token_hash(t) for t in _TOKENS(text or "")], dtype=np.int64)
    return np.concatenate([h, 31 * h[:-1] + h[1:]]) & ((1 << BITS) - 1)


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text; null has none.

    Words are runs of anything but blank, tab, line feed, vertical tab, form feed and return. Duplicate lines have a word and equal
    an earlier line. Repeated words lie in a window of ``WINDOW`` words that occurs twice or more.
    """
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    windows = list(zip(*[words[k:] for k in range(WINDOW)]))
    repeated = 0
    if len(set(windows)) < len(windows):
        count, upto = Counter(windows), 0  # words before ``upto`` are settled
        for start, window in enumerate(windows):
            if count[window] > 1:
                repeated += start + WINDOW - max(start, upto)
                upto = start + WINDOW
    blanks = sum(map(text.count, _BLANKS))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-grams per bin, of trusted texts and of all, in one task: at most a row per bin."""
    counts, waiting, n = np.zeros(2 << BITS, dtype=np.int64), [], 0
    for batch in batches:
        for text, trusted in zip(batch["text"], batch["trusted"]):
            bins = gram_bins(text)
            waiting.append(bins + (1 << BITS) if trusted else bins)
            n += len(bins)
            if n > _COUNT_AT_ONCE:
                counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                waiting, n = [], 0
    if waiting:
        counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
    other, trusted = counts.reshape(2, -1)
    at = np.flatnonzero(other + trusted)
    for part in np.array_split(at, max(1, len(at) // 50_000)):
        yield pd.DataFrame({"bin": part.astype(np.int32), "trusted": trusted[part], "every": other[part] + trusted[part]})


def bin_weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The weight of each bin, from all documents and from those that ``labels`` (``doc_id, quality``) trusts.

    A document is trusted if any of its labels has a quality above 0; null labels and ids are passed over. Without trusted
    text, or without any, all weights are 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = stored(known.where("doc_id IS NOT NULL AND quality > 0").select("doc_id", F.lit(True).alias("trusted")).distinct(), "trusted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = lookup_join(texts, known, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = texts.mapInPandas(_counted, "bin int, trusted long, every long").groupBy("bin").agg(
        F.sum("trusted").alias("trusted"), F.sum("every").alias("every")
    )
    rows = counts.toPandas()  # at most one row per bin
    weights = np.zeros(1 << BITS, dtype=np.int64)
    mass, whole = float(rows["trusted"].sum()), float(rows["every"].sum())
    if mass:
        expected = mass * rows["every"].to_numpy(np.float64) / whole
        ratio = np.log((rows["trusted"].to_numpy(np.float64) + SMOOTHING) / (expected + SMOOTHING))
        weights[rows["bin"].to_numpy()] = np.floor(ratio * UNIT + 0.5).astype(np.int64)
    return weights


def quality(weights: np.ndarray):
    """A column function: the counts of each text, the sum of its n-grams' weights, and how many n-grams it has."""

    @F.pandas_udf(_QUALITY)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in _QUALITY.split(", ")]
        for texts in batches:
            rows = np.zeros((len(texts), len(names)), dtype=np.int64)
            for i, text in enumerate(texts):
                bins = gram_bins(text)
                rows[i] = *text_counts(text), weights[bins].sum(), len(bins)
            yield pd.DataFrame(rows, columns=names)

    return judged


def with_quality(docs: DataFrame, labels: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with :data:`ADDED`: the counts of its whole texts, whether they break a rule, the score, and whether to keep them.

    ``base_failed``: fewer than ``LEAST_WORDS`` words, or more than ``MOST_REPEATED_PERCENT`` % of them repeated. ``kept`` is false for those, else whether the
    score reaches ``least_score``. Null and empty texts have no words and score 0; repeated rows get equal results; columns other than ``doc_id`` and ``text`` are passed
    through unread, those of the added names replaced. An empty table gives an empty result.
    """
    weights = bin_weights(docs, labels)
    rows = docs.drop(*ADDED).withColumn("_q", quality(weights)(F.col("text").cast("string"))).select("*", "_q.*").drop("_q")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    least = int(np.floor(least_score * UNIT))
    return rows.withColumns({
        "base_failed": failed,
        "score": F.coalesce(F.col("score_sum") / F.nullif(F.col("n_grams") * UNIT, F.lit(0)), F.lit(0.0)),
        "kept": ~failed & (F.col("score_sum") >= least * F.col("n_grams")),
    }).drop("score_sum", "n_grams")
