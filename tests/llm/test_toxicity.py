import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm.queries import op7_toxicity
from quillon.llm.toxicity import REJECT_AT, fit, ngram_bins, score, training_fold, with_score

SF = "/root/testdata/sf0.1"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, score string")


def corpus(n=300):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        text = [f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}" for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["Vileword", "nastything"]))
        rows.append((i, " ".join(text), "s"))
        marks.append((i, int(i % 4 == 0), "x"))
    return rows, marks


def test_learns_words_that_decide(spark, make_docs):
    rows, marks = corpus()
    scored = with_score(make_docs(rows), labels(spark, marks)).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all((r.score >= REJECT_AT) == (r.doc_id % 4 == 0) for r in held) and len(held) > 60


def test_awkward_rows(spark, make_docs, awkward):
    rows, marks = corpus(120)
    docs = make_docs(rows + [(None if i is None else i + 1000, t, s) for i, t, s in awkward], extra=("score", "toxic", "bins"))
    marks += [(None, 1, "x"), (1001, None, "x"), (5, 0, "y"), (4, 1, "y"), (77777, 1, "y")]
    scored = with_score(docs, labels(spark, marks)).collect()
    assert len(scored) == len(rows) + len(awkward)
    assert all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if not r.text}) == 1


def test_empty_tables_and_one_class(spark, make_docs):
    none = labels(spark, [])
    assert with_score(make_docs([]), none).collect() == []
    assert [r.score for r in with_score(make_docs([(1, "a", "s")]), none).collect()] == [0.5]
    clean = labels(spark, [(k, 0, "x") for k in range(20)])
    assert with_score(make_docs([(k, "a", "s") for k in range(20)]), clean).first().score < 0.1


def test_held_out_labels_are_not_learned(spark, make_docs):
    rows, marks = corpus(120)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, s) for i, t, s in marks]
    docs = make_docs(rows)
    one, two = (fit(docs, labels(spark, m)) for m in (marks, flipped))
    assert (one.bins == two.bins).all() and (one.weights == two.weights).all()
    fold = {r.doc_id: r.f for r in docs.select("doc_id", training_fold(F.col("doc_id")).alias("f")).collect()}
    assert all(f == (zlib.crc32(str(i).encode()) % 3 != 1) for i, f in fold.items())


def test_bins_do_not_depend_on_case_or_punctuation():
    a, b = (np.unique(np.concatenate(ngram_bins(t))) for t in ("You, Fool", "you  fool"))
    assert (a == b).all()
    assert [len(x) for x in ngram_bins(None)] == [0, 0, 0, 0] or all(len(x) == 0 for x in ngram_bins(None))


def test_scores_count_an_ngram_once(spark, make_docs):
    rows, marks = corpus(120)
    docs = make_docs(rows)
    model = fit(docs, labels(spark, marks))
    twice = make_docs([(1, "vileword", "s"), (2, "vileword vileword vileword", "s")])
    a, b = (r.x for r in twice.select(score(model)("text").alias("x")).collect())
    assert b == pytest.approx(a, rel=0.2)


@pytest.fixture(scope="module")
def held_out_counts(spark):
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op7_toxicity(spark, SF).join(marks, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    return {(r.toxic, r.predicted): r["count"] for r in rows}


def test_held_out_clean_texts_stay_and_most_toxic_ones_are_found(held_out_counts):
    n = held_out_counts
    assert n.get((0, 1), 0) <= 0.005 * n[0, 0] + 1
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0))


@pytest.mark.xfail(reason="not reached: 15% of the held-out toxic texts of this table are missed, see the README")
def test_held_out_accuracy(held_out_counts):
    n = held_out_counts
    assert n.get((1, 0), 0) <= 0.02 * n[1, 1] + 1 and n.get((0, 1), 0) <= 0.005 * n[0, 0] + 1
