import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm.alignment import BYTE_TOKENIZER, PIECE_MODEL, _bitmaps, alignment, bitmap_slots, loaded

import numpy as np


@pytest.fixture(scope="module")
def tokenizers():
    return loaded(BYTE_TOKENIZER, PIECE_MODEL)


def spans(ids, spelled):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(spelled[i]), i))
        at += len(spelled[i])
    return out


def cut_by_hand(tokenizers, text):
    if not text:
        return [], []
    a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
    b = tokenizers.b.encode(text)
    raw = (" " + text).encode()
    same = b"".join(tokenizers.bytes_a[i] for i in a) == raw == b"".join(tokenizers.bytes_b[i] for i in b)
    return (spans(a, tokenizers.bytes_a), spans(b, tokenizers.bytes_b)) if same else ([], [])


def brute(tokenizers, rows):
    """Sorted rows of the documents, and of the pairs."""
    found, n_docs, n_links = [], Counter(), Counter()
    for doc_id, text in rows:
        a, b = cut_by_hand(tokenizers, text)
        links = Counter((i, k) for s, e, i in a for t, f, k in b if s < f and t < e)
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [
            "|".join(",".join(str(i) for _, e, i in side if s < e <= t) for side in (a, b)) for s, t in zip([0, *ends], ends)
        ]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        found.append((doc_id, len(a), len(b), len(groups), links, digest))
        n_docs.update(links.keys())
        n_links.update(links)
    most = {}
    for (i, _), c in n_docs.items():
        most[i] = max(most.get(i, 0), c)
    docs = [
        (d, na, nb, ng, sum(l.values()), sha, sum(n for p, n in l.items() if n_docs[p] == most[p[0]]), sum(n * n_docs[p] for p, n in l.items()))
        for d, na, nb, ng, l, sha in found
    ]
    return sorted(docs, key=repr), sorted((*p, c, n_links[p], c == most[p[0]]) for p, c in n_docs.items())


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def check(tokenizers, df):
    docs, pairs = alignment(df)
    want_docs, want_pairs = brute(tokenizers, [(r.doc_id, r.text) for r in df.collect()])
    assert sorted((tuple(r[c] for c in NAMES) for r in docs.collect()), key=repr) == want_docs
    assert sorted(map(tuple, pairs.select("a", "b", "n_docs", "n_links", "best").collect())) == want_pairs
    return want_docs


def test_awkward_rows(tokenizers, make_docs, awkward):
    rows = [(i, t if t is None else t[:400], s) for i, t, s in awkward]
    rows += [
        (100, "a ▁ b", "s"), (101, "<|endoftext|> and </s> <s> <unk> <0x41>", "s"), (102, "  two  blanks \n\n\t tabs\r\n", "s"), (103, "é é ﬁ 　 \U0001f600‍", "s"),
        (104, "\x00 \x01\x7f", "s"), (105, " ", "s"), (106, "ab" * 150, "s"),
    ]
    got = check(tokenizers, make_docs(rows, extra=("block", "slot", "pair", "n_a", "bits")))
    by_id = {r[0]: r for r in got}
    assert by_id[100][1:] == (0, 0, 0, 0, "", 0, 0) and by_id[101][1] > 10 and by_id[102][1] > 0 and by_id[4][5] == "" == by_id[5][5]


def test_tables_of_the_corpus(tokenizers, spark):
    check(tokenizers, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 4000))


def test_blocks_do_not_change_results(tokenizers, spark, make_docs, monkeypatch):
    """Small blocks over several tasks, with documents that hold a pair many times."""
    from quillon.llm import alignment as module

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "there", "unusual", "of", "x"]) for _ in range(rng.choice([1, 4, 30]))), "s") for i in range(120)]
    docs = make_docs(rows)
    whole = sorted(map(tuple, alignment(docs)[0].collect()))
    cut = module._cutter

    def small(*files):
        def run(batches):
            module.BLOCK_LINKS, module.BATCH_DOCUMENTS = 40, 3
            yield from cut(*files)(batches)

        return run

    monkeypatch.setattr(module, "_cutter", small)
    assert sorted(map(tuple, alignment(docs.repartition(5))[0].collect())) == whole
    check(tokenizers, docs.repartition(3))


def test_bitmaps_of_any_density():
    rng = np.random.default_rng(1)
    for n in (1, 255, 256, 257, 4096):
        slots = np.sort(rng.choice(4096, n, replace=False))
        pairs, count, bits = _bitmaps(7 << 12 | slots, 0)
        assert pairs.tolist() == [7] and count.tolist() == [n] and len(bits[0]) <= 512
        assert bitmap_slots(bits[0], n).tolist() == slots.tolist()


def test_empty_table(make_docs):
    docs, pairs = alignment(make_docs([]))
    assert docs.collect() == [] and pairs.collect() == []
