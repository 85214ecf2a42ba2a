import random
import re

from pyspark.sql import functions as F

from quillon.llm.line_dedup import drop_repeated_runs, suffix_ranks, text_lines


def brute(rows, min_words=50):
    """Texts after deletion, by comparing every pair of starts of runs."""
    order = sorted({(-(2**63) if i is None else i, t) for i, t, *_ in rows if t is not None}, key=lambda x: x[0])
    assert len({i for i, _ in order}) == len(order)
    lines = [(i, k, r, line) for i, t in order for k, (r, line) in enumerate(
        (r, line) for r, line in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", line))]
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", x[3])) for x in lines]
    gone = set()
    for s in range(len(lines)):
        for p in range(s):
            n = total = 0
            while s + n < len(lines) and lines[s + n][3] == lines[p + n][3] and lines[s + n][0] == lines[s][0] and lines[p + n][0] == lines[p][0]:
                total += count[s + n]
                n += 1
            if total >= min_words:
                gone |= {(lines[s + k][0], lines[s + k][2]) for k in range(n)}
    out = {}
    for i, t in order:
        kept, before = [], False
        every = t.split("\n")
        state = [(i, r) in gone if re.search(r"[^\x20\x09-\x0D]", x) else None for r, x in enumerate(every)]
        for r, line in enumerate(every):
            after = next((x for x in state[r + 1 :] if x is not None), False)
            if state[r] is None:
                drop = before and (after or state[r - 1] is True)
            else:
                drop = before = state[r]
            if not drop:
                kept.append(line)
        out[i] = "\n".join(kept) if any(i == g for g, _ in gone) else t
    return [(i, None if t is None else out[-(2**63) if i is None else i]) for i, t, *_ in rows]


def got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_awkward_rows(make_docs, awkward):
    rows = [r for r in awkward if r[0] is not None]
    df = drop_repeated_runs(make_docs(rows, extra=("n_lines", "rank", "did", "length")))
    assert got(df) == sorted(brute(rows), key=repr)
    assert {"rank", "did", "length", "lang", "source"} < set(df.columns)


def test_null_ids_come_first(make_docs):
    line = " ".join(f"a{k}" for k in range(50))
    df = drop_repeated_runs(make_docs([(1, line, "s"), (None, f"x\n{line}", "s"), (2, line + " ", "s")]))
    assert got(df) == sorted([(1, ""), (None, f"x\n{line}"), (2, line + " ")], key=repr)


def test_empty_table(make_docs):
    assert drop_repeated_runs(make_docs([])).collect() == []


def test_runs_like_brute_force(make_docs):
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 3, 8, 20, 30]))) + f" {k}" for k in range(14)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(pool))
            lines += [pool[(at + k) % len(pool)] for k in range(rng.randint(1, 9))]
            lines += [rng.choice(["", " ", f"own {i} {len(lines)}"])]
        rows.append((i, "\n".join(lines), "s"))
    df = drop_repeated_runs(make_docs(rows)).cache()
    assert got(df) == sorted(brute(rows), key=repr)
    assert df.agg(F.sum("n_removed")).first()[0] > 100


def test_runs_inside_one_text_and_overlapping_ones(make_docs):
    line = " ".join(f"a{k}" for k in range(25))
    rows = [(1, "\n".join([line] * 5 + ["end"]), "s")]
    assert got(drop_repeated_runs(make_docs(rows))) == sorted(brute(rows), key=repr)


def test_ranks_name_windows(make_docs):
    ranks = suffix_ranks(text_lines(make_docs([(1, "a\nb\nc\nd", "s"), (2, "x\na\nb\nc", "s"), (3, "b\nc", "s")])), 3)
    assert len(ranks) == 2  # three lines are repeated together, not four
    second = {(r.did, r.i): (r["rank"].did, r["rank"].i) for r in ranks[1].collect()}
    assert second == {(1, 0): (1, 0), (2, 1): (1, 0), (1, 1): (1, 1), (2, 2): (1, 1), (3, 0): (1, 1)}
