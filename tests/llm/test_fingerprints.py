import hashlib

from pyspark.sql import functions as F

from quillon.llm.fingerprints import N_PARTS, next_ids, with_edits


def half(n):
    return n // 2


def test_next_ids(spark):
    ids = spark.createDataFrame([(k,) for k in (5, 1, 9, 9, 300, -4)] + [(None,)], "doc_id long")
    found = {r.doc_id: r.next_id for r in next_ids(ids).collect()}
    assert found == {300: 9, 9: 5, 5: 1, 1: -4, -4: None, None: 300}
    assert {r.doc_id: r.next_id for r in next_ids(ids.where("doc_id = 5")).collect()} == {5: 5}


def test_awkward_rows(make_docs, awkward):
    rows = with_edits(make_docs(awkward, extra=("h", "id", "key", "fingerprint"))).collect()
    texts = {(i, t or "") for i, t, _ in awkward}
    assert len(rows) == len(texts)
    ids = sorted({i for i, _ in texts}, key=lambda i: float("-inf") if i is None else i)
    first = {}
    for i, t in texts:
        first.setdefault(i, []).append(t)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 8 * N_PARTS == len(r.edited_fingerprint)
        mine = [t for t in first[r.doc_id] if len(t) == r.n_chars]
        after = ids[ids.index(r.doc_id) - 1]
        edits = {hashlib.sha256((t[: len(t) - half(len(t))] + n[: half(len(t))]).encode()).hexdigest() for t in mine for n in first[after]}
        assert r.edited_sha256 in edits
    by = {(r.doc_id, r.n_chars): r.fingerprint for r in rows}
    assert len({f for (i, n), f in by.items() if n == 0}) == 1


def test_empty_table(make_docs):
    assert with_edits(make_docs([])).collect() == []


def test_equal_texts_have_equal_fingerprints_and_edits_are_nearer_than_others(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = with_edits(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in rows:
        assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    mean = lambda name: sum(r[name] for r in rows) / len(rows)
    assert mean("near_edited") > 2 * mean("near_next")


def test_texts_without_common_terms_are_told_apart(make_docs):
    """Words that no other text has, no words at all, and near copies that make up most of the table: no unlike texts are alike."""
    from conftest import words

    rows = [(i, words(1000 * i, 20), "s") for i in range(50)] + [(100 + i, "!" * (i + 1), "s") for i in range(3)]
    rows += [(200 + i, words(90_000, 30) + f" own{i}", "s") for i in range(60)] + [(300, words(90_000, 30), "s"), (301, words(90_000, 30), "s")]
    texts = {i: t for i, t, _ in rows}
    found = {r.doc_id: r for r in with_edits(make_docs(rows)).collect()}
    ids = sorted(texts, reverse=True)
    for here, after in zip(ids, ids[1:] + ids[:1]):
        assert (found[here].near_next == 1) == (texts[here] == texts[after])
    assert not any(set(r.fingerprint) == {"0"} for r in found.values())
    assert len({r.fingerprint for r in found.values()}) == len(set(texts.values()))
