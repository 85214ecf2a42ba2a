import pytest

from quillon.llm.mixing import MOST, WEIGHTS, mixed, source_targets, with_copies


def poured(sizes):
    """Targets by sharing out again and again; ``sizes`` in order of sources, null last."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(MOST * sizes[s] for s in full)
        open_ones = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_ones) for s in open_ones}
        over = {s for s in open_ones if share[s] > MOST * sizes[s]}
        if not over:
            return {s: share.get(s, MOST * sizes[s]) for s in names}
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 5}, {"a": 0, "b": 7}, {"é": 10, "z": 1, "Z": 900, "": 3, "b": 2},
    {"only": 12}, {"a": 0, "b": 0},
])
def test_targets(spark, sizes):
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in rows} == pytest.approx(poured(sizes))


def test_awkward_rows(make_docs, awkward):
    df = with_copies(make_docs(awkward, extra=("size", "target", "n_copies", "cell")))
    rows = df.collect()
    assert len(rows) == len(awkward) and "cell" in df.columns
    for r in rows:
        assert r["size"] == len((r.text or "").split()) or "▁" in (r.text or "")
        assert 0 <= r.n_copies <= MOST
        expected = r.target / r.source_size if r.source_size else 0
        assert expected - 1 < r.n_copies < expected + 1
    again = sorted((repr(r.doc_id), repr(r.text), r.n_copies) for r in df.collect())
    assert again == sorted((repr(r.doc_id), repr(r.text), r.n_copies) for r in rows)


def test_empty_table(make_docs):
    assert with_copies(make_docs([])).collect() == []
    assert mixed(make_docs([])).collect() == []


def test_words_taken_are_near_the_targets_with_one_hot_size(make_docs):
    rows = [(i, "same words here", "big") for i in range(4000)]
    rows += [(10_000 + i, "w " * (1 + i % 90), "b") for i in range(2000)] + [(20_000 + i, "w " * (1 + i % 50), "c") for i in range(1500)]
    docs = with_copies(make_docs(rows)).collect()
    taken, target, largest = {}, {}, {}
    for r in docs:
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.n_copies
        target[r.source] = r.target
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for source in taken:
        assert abs(taken[source] - target[source]) <= 3 * largest[source]
    # Neighbours in the order take turns: no long stretch is left out.
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in docs))


def test_mixed_repeats_rows(make_docs):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2] if i % 5 else "c") for i in range(300)]
    docs = make_docs(rows)
    copies = {r.doc_id: r.n_copies for r in with_copies(docs).collect()}
    out = [r.doc_id for r in mixed(docs).collect()]
    assert mixed(docs).columns == docs.columns
    assert all(out.count(i) == n for i, n in copies.items())
