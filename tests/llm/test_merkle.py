import hashlib
import zlib

import pytest

from quillon.llm.merkle import FIELDS, checked_manifest, manifest, numbered, with_paths


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = [row[c] + more if c == "n_chars" and row[c] is not None else row[c] for c in FIELDS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, run=2):
    """The last node, and for each leaf its siblings before and after, from the leaf up."""
    paths, nodes, below = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(nodes) > 1:
        runs = [range(k, min(k + run, len(nodes))) for k in range(0, len(nodes), run)]
        for members in runs:
            for m in members:
                around = "".join(nodes[x] for x in members if x < m), "".join(nodes[x] for x in members if x > m)
                for k in below[m]:
                    paths[k].append(around)
        below = [[k for m in members for k in below[m]] for members in runs]
        nodes = [sha("".join(nodes[m] for m in members)) for members in runs]
    return nodes[0], paths


def brute(rows, run=2):
    """Sorted rows of doc_id, leaf, subroot, root, siblings' digest, and the root that the tampered row leads to."""
    first = lambda v: (v is not None, v)
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    parts = []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (*first(r["doc_id"]), leaf(r)))
        parts.append((own, *tree([leaf(r) for r in own], run)))
    out = []
    root, above = tree([p[1] for p in parts], run) if parts else (None, [])
    for (own, subroot, paths), up in zip(parts, above):
        for row, path in zip(own, paths):
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf(row, int(hit))
            for before, after in path + up:
                node = sha(before + node + after)
            out.append((row["doc_id"], leaf(row), subroot, root, sha("".join(b + a for b, a in path + up)), node, node == root))
    return sorted(out, key=repr)


def check(df):
    got = sorted((tuple(r) for r in checked_manifest(df).collect()), key=repr)
    assert got == brute([r.asDict() for r in df.collect()])
    return got


def test_awkward_rows(make_docs, awkward):
    docs = make_docs(awkward, extra=("leaf", "root", "path", "_key", "_at"))
    langs = docs.selectExpr("* except (lang)", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' WHEN doc_id < 9 THEN 'é' ELSE 'en' END AS lang")
    got = check(langs)
    assert len(got) == len(awkward) and any(not r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 33])
def test_one_language_of_any_size(make_docs, n):
    check(make_docs([(i, f"text {i}", "s") for i in range(n)]))


def test_empty_table(make_docs):
    assert checked_manifest(make_docs([])).collect() == []


@pytest.mark.parametrize("run, levels", [(2, 1), (2, 3), (3, 2), (4, 1)])
def test_windows_shorter_than_the_tree(spark, run, levels):
    """Several tiers, and runs of more than two: the same trees as by hand."""
    data = [(key, f"{key}{i:04d}") for key, n in (("a", 1), ("b", 70), ("c", 203), ("d", 64)) for i in range(n)]
    nodes = spark.createDataFrame([(k, v, sha(v)) for k, v in data], "key string, v string, _h string")
    rows, roots = with_paths(numbered(nodes, "key", "v"), "key", run, levels)
    got = {r.v: [tuple(s) for s in r._path] for r in rows.collect()}
    tops = {r.key: r._root for r in roots.collect()}
    for key in "abcd":
        own = [v for k, v in data if k == key]
        top, paths = tree([sha(v) for v in own], run)
        assert tops[key] == top and [got[v] for v in own] == paths


def test_many_languages(make_docs):
    docs = make_docs([(i, "x", "s") for i in range(300)]).selectExpr("* except (lang)", "concat('l', doc_id % 41) AS lang")
    check(docs)


def test_windows_are_bounded_and_nothing_leaves_the_engine(make_docs):
    plan = manifest(make_docs([(1, "a", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
