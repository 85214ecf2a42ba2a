import math
import re
from collections import Counter
from hashlib import md5

import numpy as np
import pytest

from quillon.llm.quality import ADDED, BITS, LEAST_SCORE, SMOOTHING, UNIT, bin_weights, gram_bins, text_counts, with_quality

GOOD = "the sun rose over the hills and every bird sang to a quiet morning in spring while people walked along"
JUNK = "click&&& here%%% now%%% buy&&& cheap### offers%%% today&&& win### prizes%%% free&&& online### deals%%%"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, kept string")


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = {w for w, c in Counter(windows).items() if c > 1}
    covered = {k + j for k, w in enumerate(windows) if w in many for j in range(5)}
    dups = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), len("".join(words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def grams_by_hand(text):
    h = [int(md5(t.encode()).hexdigest()[:8], 16) for t in re.findall(r"\w+|[^\w\x20\x09-\x0D]+", text or "")]
    return [x % 2**BITS for x in h] + [(31 * x + y) % 2**BITS for x, y in zip(h, h[1:])]


def corpus(n=60):
    rows = [(i, f"{GOOD} {i} w{i}a w{i}b", "s") for i in range(n)] + [(n + i, f"{JUNK} {i} v{i}a", "s") for i in range(n)]
    return rows, [(i, int(i < n), "x") for i in range(2 * n) if i % 2]


@pytest.mark.parametrize("text", [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "a a a a a a a", "x\nx\n \nx \n\nx", "a b c d e f g a b c d e", "#*$%&|<>é|",
    "p q r s t u p q r s t v q r s t u", "\x1c x \x85 y z",
])
def test_counts_by_hand(text):
    assert text_counts(text) == counts_by_hand(text)
    assert sorted(gram_bins(text).tolist()) == sorted(grams_by_hand(text))


def test_weights_and_verdicts_by_hand(spark, make_docs):
    rows, marks = corpus()
    good = {i for i, q, _ in marks if q}
    every, trusted = Counter(), Counter()
    for i, t, _ in rows:
        every.update(grams_by_hand(t))
        trusted.update(grams_by_hand(t) if i in good else ())
    mass, whole = sum(trusted.values()), sum(every.values())
    want = {b: math.floor(math.log((trusted[b] + SMOOTHING) / (mass * c / whole + SMOOTHING)) * UNIT + 0.5) for b, c in every.items()}
    docs, known = make_docs(rows), labels(spark, marks)
    weights = bin_weights(docs, known)
    assert {b: int(weights[b]) for b in want} == want and np.count_nonzero(weights) <= len(want)
    for r in with_quality(docs, known).collect():
        bins = grams_by_hand(r.text)
        assert r.score == pytest.approx(sum(want[b] for b in bins) / len(bins) / UNIT)
        assert r.kept == (not r.base_failed and sum(want[b] for b in bins) >= math.floor(LEAST_SCORE * UNIT) * len(bins))
        assert r.kept == (r.doc_id < 60)


def test_awkward_rows(spark, make_docs, awkward):
    rows, marks = corpus(20)
    docs = make_docs(rows + [(None if i is None else 1000 + i, t, s) for i, t, s in awkward], extra=("kept", "score", "trusted", "bin"))
    marks += [(None, 1, "x"), (1001, None, "x"), (1, 0, "x"), (1, 1, "y"), (99999, 1, "x")]
    got = with_quality(docs, labels(spark, marks))
    assert set(ADDED) | {"trusted", "bin"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    found = got.collect()
    assert len(found) == len(rows) + len(awkward)
    assert all(tuple(r[c] for c in ADDED[:5]) == counts_by_hand(r.text) for r in found)
    assert all(r.base_failed and not r.kept and r.score == 0 for r in found if not (r.text or "").strip())
    assert sum(r.n_words == 30_000 for r in found) == 1


def test_without_labels_rules_decide_alone(spark, make_docs):
    got = with_quality(make_docs([(1, GOOD, "s"), (2, "short", "s"), (3, "a b c d e f " * 9, "s")]), labels(spark, [])).collect()
    assert {r.doc_id: (r.base_failed, r.kept, r.score) for r in got} == {1: (False, True, 0), 2: (True, False, 0), 3: (True, False, 0)}


def test_empty_tables(spark, make_docs):
    assert with_quality(make_docs([]), labels(spark, [])).collect() == []
    assert with_quality(make_docs([]), labels(spark, [(1, 1, "x")])).collect() == []


def test_trusted_texts_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{sf}/labels.parquet")
    held = known.where("crc32(cast(doc_id AS string)) % 3 = 1")
    rows = with_quality(spark.read.parquet(f"{sf}/documents.parquet"), known.join(held, "doc_id", "left_anti")).join(held, "doc_id").collect()
    judged = [r for r in rows if not r.base_failed]
    good, junk = [r for r in judged if r.quality == 1], [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and not any(r.kept for r in junk) and junk
