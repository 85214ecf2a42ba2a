from collections import Counter

import corpus_pipeline as pipeline
from quillon.session import stored
from test_line_dedup import brute as lines_by_brute_force
from test_ngram_join import brute as classes_by_brute_force

SF = "/root/testdata/sf0.001"


def states(spark, docs):
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_each_stage_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, clean, lines, single, mix, ids = states(spark, docs)
    assert all(df.columns == docs.columns for df in (clean, lines, single, mix))
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = {r[0] for r in rows_of(clean)}
    assert not kept & toxic and len(kept) >= 0.9 * (raw.count() - len(toxic))
    want = {i: t for i, t in lines_by_brute_force(rows_of(clean)) if t.strip()}
    assert {i: t for i, t, _ in rows_of(lines)} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    firsts = {eval(c) for _, _, c in classes_by_brute_force(rows_of(lines))}
    assert {i for i, *_ in rows_of(single)} == firsts
    copies = Counter(r[0] for r in rows_of(mix))
    assert set(copies) <= firsts and max(copies.values()) <= 3
    assert Counter(r.doc_id for r in ids.collect()) == copies
    assert sorted(map(str, pipeline.run(spark, SF).collect())) == sorted(map(str, ids.collect()))


def test_awkward_rows_pass_all_stages(spark, make_docs, awkward):
    *_, single, mix, ids = states(spark, make_docs(awkward))
    assert {4, 5, 6} <= {r.doc_id for r in single.collect()} and ids.count() == mix.count()


def test_empty_table_passes_all_stages(spark, make_docs):
    assert all(df.count() == 0 for df in states(spark, make_docs([])))


def test_one_of_each_class_goes_by_id_and_text(spark, make_docs):
    from conftest import words

    base, other = words(0, 60), words(5000, 60)
    rows = [
        (1, base, "a"), (14, base, "a"), (14, other, "b"), (15, other, "b"), (15, words(9000, 40), "b"), (None, base, "a"), (None, base, "a"),
        (20, words(7000, 50), "c"), (20, words(7000, 50), "c"), (21, None, "c"), (21, "", "c"), (21, "", "c"), (22, " ", None),
    ]
    got = sorted(((r.doc_id, r.text) for r in pipeline.one_of_each_class(spark, make_docs(rows, extra=("text_hash", "n")), SF).collect()), key=repr)
    want = [
        (1, base), (14, other), (15, words(9000, 40)), (None, base), (None, base), (20, words(7000, 50)), (21, None), (21, ""), (21, ""), (22, " "),
    ]
    assert got == sorted(want, key=repr)
