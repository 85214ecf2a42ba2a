import random
import re

from quillon.llm.common import components
from quillon.llm.ngram_join import _groups, _ordered, _pivots, jaccard_classes
from quillon.llm.shingles import set_blocks, shingle_set, text_words
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def brute(rows, percent=75):
    """Sets, links and components by comparing all pairs."""

    def shingles(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= percent * either:
                root[max(find(i), find(j))] = min(find(i), find(j))
    smallest = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), row[0]), row[0])
    return sorted((repr(r[0]), len(s), repr(smallest[find(i)] if r[0] is not None else None)) for i, (r, s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in df.collect())


def test_awkward_rows(make_docs, awkward):
    df = jaccard_classes(make_docs(awkward, extra=("component_id", "cid", "h")))
    assert got(df) == brute(awkward)


def test_empty_table(make_docs):
    assert jaccard_classes(make_docs([])).collect() == []


def test_families_like_brute_force(make_docs):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 6, 15])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                at = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[at] = rng.choice(vocabulary)
                else:
                    copy.insert(at, rng.choice(vocabulary))
            rows.append((len(rows) * 3 + 1, " ".join(copy), "s"))
    # Texts that share a long passage but are not alike enough, and some that are just alike enough.
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for extra in range(1, 40):
        rows.append((len(rows) * 3 + 1, " ".join(passage + [f"own{len(rows)}x{k}" for k in range(extra)]), "s"))
    rng.shuffle(rows)
    assert got(jaccard_classes(make_docs(rows))) == brute(rows)


def test_threshold_is_inclusive(make_docs):
    # 7 shingles, of which 6 are shared by a set of 7: 6 / 8 is 0.75 exactly.
    a = "a b c d e f g h i j k"
    b = "b c d e f g h i j k l"
    assert got(jaccard_classes(make_docs([(1, a, "s"), (2, b, "s")]))) == [("1", 7, "1"), ("2", 7, "1")]


def test_a_long_chain_is_one_component(spark):
    rows = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    found = {r.id: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(301)) and found[1001] == 1000


def test_numbers_of_words_do_not_depend_on_their_place():
    def numbers(text):
        return text_words(np.frombuffer(text.encode(), np.uint8))

    assert (numbers("Some Words here") == numbers("  some\twords\nHERE ")).all()
    assert len(set(numbers("a b ab ba aa é É").tolist())) == 7
    assert len(shingle_set(numbers("a b c"), 5)) == 1


def test_words_cut_between_slices(monkeypatch):
    import quillon.llm.shingles as module

    text = np.frombuffer(" ".join(f"word{k}" for k in range(500)).encode(), np.uint8)
    whole = text_words(text)
    monkeypatch.setattr(module, "_SLICE", 64)
    assert (text_words(text) == whole).all()


def test_sets_of_many_texts_together(monkeypatch):
    import quillon.llm.shingles as module

    rng = random.Random(3)
    parts = [None, "", " \n", "a", " A b\tc d ", "a b c d e", "x y " * 40, "é Zz " * 9, " ".join(f"w{k}" for k in range(300))]
    texts = [rng.choice(parts) for _ in range(400)]
    own = [shingle_set(text_words(np.frombuffer((t or "").encode(), np.uint8)), 5) for t in texts]
    calls = []
    alone = module.shingle_set
    monkeypatch.setattr(module, "shingle_set", lambda w, size: calls.append(len(w)) or alone(w, size))
    for limit, column in ((1 << 17, pa.array(texts)), (1000, pa.array(texts, pa.large_string())), (1 << 17, pa.array(["z", *texts]).slice(1))):
        monkeypatch.setattr(module, "_BLOCK", limit)
        blocks = list(set_blocks(column, 5))
        assert np.concatenate([sizes for sizes, _ in blocks]).tolist() == [len(h) for h in own]
        assert (np.concatenate([h for _, h in blocks]) == np.concatenate(own)).all()
        assert (len(blocks) > 9) == (limit == 1000)
        assert limit == 1000 or max(calls) < 5  # texts of five words or more are not taken one by one
        calls.clear()


def test_the_pivot_of_a_family_is_the_set_its_copies_come_from(spark):
    base = list(range(1000, 1100))
    # Every copy lacks four runs of three, in places of its own, so two copies are mostly not similar enough but each is to the base.
    lost = lambda k: {base[(k * 7 + run * 29 + i) % 100] for run in range(4) for i in range(3)}
    rows = [(k, 100, [t for t in base if t not in lost(k)] + list(range(k * 12 + 2000, k * 12 + 2000 + len(lost(k))))) for k in range(40)]
    sets = spark.createDataFrame([*rows, (40, 100, base)], "cid long, n long, h array<long>")
    index = _groups(_ordered(sets, 75)).where("cid = gid").select("gid", "n", "u", "central", F.posexplode("prefix").alias("pos", "t"))
    heads = {r.gid for r in index.select("gid").collect()} - {40}
    pivots = [r for r in _pivots(index, None, 0).collect() if r.b != 40]
    assert len(heads) > 20 and {r.b for r in pivots} == heads and {r.a for r in pivots} == {40}
