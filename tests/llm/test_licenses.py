from quillon.llm.license_texts import TEMPLATES
from quillon.llm.licenses import Scan, _stretches, blocks_of, licence_spans


def spans(df):
    return {(r.doc_id, r.start, r.end, r.name): r for r in df.collect()}


def test_every_wording_is_found_as_itself():
    scan = Scan()
    for name, text in TEMPLATES:
        block = f"some words before it {text} and more after it"
        found = scan.found(block)
        assert [f["name"] for f in found] == [name], name
        assert block[found[0]["start"] : found[0]["end"]] == " ".join(block.split(" "))[21 : 21 + len(text)]
        assert found[0]["missing"] == [] == found[0]["put_in"]


def test_differences_are_listed():
    name, text = TEMPLATES[1]
    changed = text.replace("in writing", "").replace("specific language", "specific and exact language")
    found = Scan().found(changed)
    assert [f["name"] for f in found] == ["Apache-2.0"]
    assert found[0]["missing"] == ["in", "writing"] and found[0]["put_in"] == ["and", "exact"]


def test_a_whole_notice_is_found_beside_longer_texts_cut_short():
    def cut(k):
        words = TEMPLATES[k][1].split()
        return " ".join(words[: len(words) * 7 // 10])

    for name, notice in (("CC-BY-4.0", "Licensed under CC BY 4.0."), ("MIT", "Released under the MIT License."), TEMPLATES[8]):
        block = f"{cut(1)} {cut(3)} {cut(5)} {notice} end"
        found = Scan().found(block)
        assert [(f["name"], block[f["start"] : f["end"]]) for f in found] == [
            ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), (name, notice),
        ]  # the header's first line is a notice by itself


def test_a_wording_is_found_behind_a_longer_stretch_that_does_not_fit():
    wording = TEMPLATES[8][1].split()
    changed = [w for k, w in enumerate(wording) if k not in (12, 25)]
    assert max(13, len(wording) - 26) < 20
    block = " ".join(wording[:20]) + " something else altogether " * 3 + " ".join(changed)
    found = Scan().found(block)
    assert [(f["name"], len(f["missing"])) for f in found] == [("GPL-3.0-or-later", 2)]
    assert block[found[0]["start"] : found[0]["end"]] == " ".join(changed)


def test_stretches_are_the_longest_common_runs():
    words = "a b c x a b y b c d a b c d".split()
    at = {}
    for k, w in enumerate(words):
        at.setdefault(w, []).append(k)
    assert _stretches("a b c d".split(), at, 2) == [(0, 10, 4), (0, 0, 3), (1, 7, 3), (0, 4, 2)]


def test_versions_are_told_apart(make_docs):
    docs = make_docs([
        (1, "This work is licensed under the GNU General Public License, version 2.", "s"),
        (2, "x This work is licensed under the GNU General Public License, version 3. y", "s"),
        (3, "Licensed under CC BY-NC 4.0. Released under the MIT License.", "s"),
        (4, "a license to nothing, no permission to speak of", "s"),
    ])
    assert sorted((i, name) for i, _, _, name in spans(licence_spans(docs))) == [(1, "GPL-2.0"), (2, "GPL-3.0"), (3, "CC-BY-NC-4.0"), (3, "MIT")]


def test_awkward_rows(make_docs, awkward):
    text = "Straße 😀\nReleased under the MIT License.\nend"
    rows = awkward + [(50, text, "s"), (50, text, "s"), (None, text, None), (51, "w " * 50_000 + text, "s")]
    found = spans(licence_spans(make_docs(rows, extra=("name", "block", "key"))))
    at = text.index("Released")
    assert set(found) == {
        (50, at, at + 31, "MIT"), (None, at, at + 31, "MIT"), (51, 100_000 + at, 100_000 + at + 31, "MIT"),
    }


def test_empty_table(make_docs):
    assert licence_spans(make_docs([])).collect() == []


def test_blocks_are_whole_words_and_disjoint():
    text = " ".join(f"w{k}" if k % 300 else "license" for k in range(1, 2000))
    blocks = blocks_of(text)
    assert all(a[1] < b[0] for a, b in zip(blocks, blocks[1:]))
    assert all((a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ") for a, b in blocks)
