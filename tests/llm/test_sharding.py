import zlib
from collections import Counter, defaultdict

import numpy as np

from quillon.llm.sharding import pack, placed


def test_pack_prefers_the_shard_with_room_for_the_measure():
    vectors = np.array([[8, 1], [1, 8], [7, 1], [1, 7], [2, 2], [1, 1]], float)
    shards = pack(vectors, 2)
    loads = np.array([vectors[shards == s].sum(axis=0) for s in (0, 1)])
    assert np.abs(loads[0] - loads[1]).max() <= 2


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def checked(rows, shards):
    by = defaultdict(list)
    for r in rows:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and 0 <= r["shard"] < shards
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_awkward_rows(make_docs, awkward):
    rows = rows_of(placed(make_docs(awkward, extra=("size", "shard", "rows", "tokens")), shards=3))
    assert len(rows) == len(awkward)
    checked(rows, 3)


def test_empty_table(make_docs):
    assert placed(make_docs([])).collect() == []


def test_measures_are_balanced_and_groups_stay_together(make_docs):
    docs = [(i, f"text {i} " + "x " * (i % 37) + "longword" * (i % 11), "s") for i in range(3000)]
    docs += [(10_000 + i, "a text with copies", "s") for i in range(3)]
    rows = rows_of(placed(make_docs(docs), shards=4))
    checked(rows, 4)
    for measure in ("size", None):
        load = Counter()
        for r in rows:
            load[r["shard"]] += r[measure] if measure else 1
        assert max(load.values()) < 1.02 * min(load.values())
    assert len({r["shard"] for r in rows if r["text"] == "a text with copies"}) == 1


def test_a_group_with_a_third_of_all_rows_is_dealt_into_pieces(make_docs):
    docs = [(i, "the same text everywhere" if i % 3 == 0 else f"text {i}", "s") for i in range(3000)]
    rows = rows_of(placed(make_docs(docs), shards=4))
    checked(rows, 4)
    load = Counter(r["shard"] for r in rows)
    assert max(load.values()) < 1.03 * min(load.values())
    assert rows == rows_of(placed(make_docs(docs), shards=4)) or sorted(map(str, rows)) == sorted(map(str, rows_of(placed(make_docs(docs), shards=4))))


def test_copies_meet_in_one_of_24_shards_on_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rows_of(placed(docs))
    checked(rows, 24)
    at = defaultdict(list)
    for r in rows:
        at[r["text"]].append(r["shard"])
    copies = [s for s in at.values() if len(s) > 1]
    assert len(copies) == 10 and all(len(set(s)) == 1 for s in copies)


def test_a_group_larger_than_a_shard_is_cut_into_few_pieces(make_docs):
    docs = [(i, "the same text everywhere" if i % 8 == 0 else f"text number {i} is other", "s") for i in range(4800)]
    rows = rows_of(placed(make_docs(docs), shards=24))
    checked(rows, 24)
    assert len({r["shard"] for r in rows if r["text"] == "the same text everywhere"}) <= 13
    load = Counter(r["shard"] for r in rows)
    assert max(load.values()) < 1.05 * min(load.values())
