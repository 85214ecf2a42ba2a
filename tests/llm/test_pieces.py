import random

import pytest
from pyspark.sql import functions as F

from quillon.llm.pieces import MODEL_FILE, Pieces, decode, with_pieces


def vocabulary(extra=()):
    pieces = [("a", -3.0), ("b", -3.5), ("c", -2.0), (" ", -4.0), (" a", -3.0), ("ab", -4.0), ("bc", -4.5), ("abc", -6.0), (" ab", -5.0), ("  ", -5.0)]
    pieces += [(p, -4.0) for p in extra]
    return Pieces(pieces, list(range(100, 356)), 999)


def every_path(pieces, text):
    """Score and ids of all segmentations."""
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, len(text) + 1):
        s = pieces.edges.get(text[:k])
        if s is None and k == 1:
            s = pieces.unknown
        if s is not None:
            ids = tuple(memoryview(pieces._spell(text[:k])).cast("i"))
            out += [(s + rest, ids + more) for rest, more in every_path(pieces, text[k:])]
    return out


def written(encoded):
    """The id sequences of the n best."""
    ids, _, best = encoded
    out = []
    for score, changes in best:
        full = ids.tolist()
        for at, n, new in sorted(changes, reverse=True):
            full[at : at + n] = new
        out.append((score, tuple(full)))
    return out


@pytest.mark.parametrize("extra", [(), ("a b",), ("\na",)])
def test_n_best_like_enumeration(extra):
    rng = random.Random(4)
    pieces = vocabulary(extra)
    for _ in range(150):
        text = "".join(rng.choice("aabbc \nx") for _ in range(rng.randint(1, 9)))
        paths = sorted(every_path(pieces, " " + text), reverse=True)
        for n in (1, 2, 5, 9):
            found = written(pieces.encode(text, n))
            assert [s for s, _ in found] == pytest.approx([s for s, _ in paths[:n]], abs=1e-6), (text, n)
            assert len({ids for _, ids in found}) == len(found)
            known = dict.fromkeys(ids for _, ids in paths)
            assert all(ids in known for _, ids in found)
            assert pieces.decode(found[0][1]) == text


def test_best_is_the_first_of_the_n_best():
    pieces = vocabulary()
    for text in ("abcabc ab c", "aaaa", "  a  b", "b\n\nabc"):
        ids, score, best = pieces.encode(text, 4)
        assert best[0] == (score, [])
        assert pieces.n_best(" " + text, 3)[0][0] == score


def test_equal_scores_have_one_order():
    pieces = Pieces([("x", -1.0), ("xx", -2.0), (" ", -1.0)], list(range(100, 356)), 999)
    first = written(pieces.encode("xx xx xxx", 6))
    assert first == written(Pieces([("x", -1.0), ("xx", -2.0), (" ", -1.0)], list(range(100, 356)), 999).encode("xx xx xxx", 6))
    assert len({s for s, _ in first}) == 1 and len(first) == 6


def test_a_vocabulary_without_bytes_has_an_unknown_piece():
    pieces = Pieces([("a", -1.0), (" ", -1.0)], None, 7)
    assert pieces.encode("aé", 1)[0].tolist() == [1, 0, 7]


def test_long_stretches():
    pieces = Pieces.load(MODEL_FILE)
    text = "ab" * 30_000
    ids, _, best = pieces.encode(text, 3)
    assert pieces.decode(ids.tolist()) == text and len(best) == 3


def test_awkward_rows(make_docs, awkward):
    df = with_pieces(make_docs(awkward, extra=("ids", "score", "n_best")))
    rows = df.withColumn("back", decode()(F.col("ids"))).collect()
    assert len(rows) == len(awkward)
    for r in rows:
        assert r.back == r.text
        assert (r.ids is None) == (r.text is None) and (r.text != "" or r.ids == [])
    assert {r.n_best[0].score == r.score for r in rows if r.ids} == {True}


def test_empty_table(make_docs):
    assert with_pieces(make_docs([])).collect() == []


def test_stretches_searched_together_have_the_same_paths():
    import random

    from quillon.llm.pieces import MODEL_FILE, Pieces, loaded

    rng = random.Random(2)
    known = loaded(MODEL_FILE)
    toy = Pieces([("a", -1.0), ("aa", -2.0), ("aab", -3.0), ("b", -1.0), ("ba", -2.0)], None, 9)
    for pieces, letters in ((known, " theéan日▁x\n😀ing"), (toy, "aabc")):
        for n in (1, 2, 7, 20):
            texts = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(60)]
            for got, want in zip(pieces.best_paths(texts), map(pieces.best_path, texts)):
                assert got[:2] == want[:2] and repr(got[2]) == repr(want[2])


def test_forgetting_changes_nothing(monkeypatch):
    from quillon.llm import pieces as module

    texts = [f"word{k} and other{k % 7} words {'x' * (k % 60)}" for k in range(80)] + [""]
    plain = module.Pieces.load(module.MODEL_FILE)
    want = [(ids.tolist(), score, best) for ids, score, best in map(plain.encode, texts)]
    monkeypatch.setattr(module, "_REMEMBERED", 5)
    short = module.Pieces.load(module.MODEL_FILE)
    got = [(ids.tolist(), score, best) for k in range(0, len(texts), 9) for ids, score, best in short.encode_all(texts[k : k + 9])]
    assert got == want


def test_stretches_of_any_lengths_are_searched_together():
    pieces = Pieces([("a", -1.0), ("b", -1.5), ("ab", -2.0), ("ba", -2.5), ("aba", -3.0), (" a", -0.5), ("bbbb", -1.0)], None, 99)
    texts = ["a", " abab", "bbbbbab", "", "日a", "ab" * 9, " a\0b", "b"]
    texts = [t for t in texts if t]
    assert pieces.best_paths(texts) == [pieces.best_path(t) for t in texts]
    pieces.encode_all(["ab abab bbbbb"])
    assert all(isinstance(path, bytes) for path in pieces.remembered.values())
