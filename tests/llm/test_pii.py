import re
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import pii
from quillon.llm.pii import KINDS, _all_patterns, _apart, base_spans, candidates, digest_columns, patterns_beside, personal_data
from quillon.llm.shingles import text_words

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain(text):
    """The fixed forms by their patterns as they are written down."""
    out = []
    for kind, name in enumerate(KINDS):
        for m in re.finditer(PATTERNS[name], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": name == "ip" and all(Decimal(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[name]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-+ 01259()%é", max_size=40))
def test_fixed_forms_like_their_patterns(text):
    assert base_spans(text) == plain(text)


@pytest.mark.parametrize("text", [
    "a.b@c.de", "x@y", "@a.b", "a@b.c@d.e", "é@a.bc a_b@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "+1 (123) 555-1234.", "+12345678", "+123456789012345678", "0" * 5000 + ".1.2.3", "a@b.c-d@e.f.g",
])
def test_fixed_forms(text):
    assert base_spans(text) == plain(text)


def test_awkward_rows(make_docs, awkward):
    rows = digest_columns(personal_data(make_docs(awkward, extra=("h", "base", "spans")))).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows}
    assert by[16].spans == "email:11:19,phone:23:40" and by[16].n_phone == 1 and by[4].spans == "" == by[5].spans


def test_empty_table(make_docs):
    assert personal_data(make_docs([])).collect() == []


def test_contexts_find_what_no_form_does(make_docs):
    rows = [(k, f"some words {k} here my number: +1 (555) {100 + k}-{1000 + k} thanks and bye", "s") for k in range(20)]
    rows += [(100, "please call my number: 555-123-9876 thanks a lot", "s"), (101, "an order 555-123-9876 of things", "s")]
    found = {r.doc_id: [(s.start, KINDS[s.kind], s.end) for s in r.added] for r in personal_data(make_docs(rows)).collect()}
    assert found[100] == [(23, "phone", 35)] and found[101] == []
    assert all(found[k] == [] for k in range(20))


@pytest.mark.parametrize("text, want", [
    ("my number: 555 123 4567, thanks", ["555 123 4567"]), ("card 4111 1111 1111 1112 ok", ["4111 1111 1111 1112"]),
    ("at (555) 123-4567.", ["(555) 123-4567", "123-4567"]), ("tel:5551234567", ["5551234567"]), ("id=555 123 4567", ["555 123 4567"]),
    ("(555)123-4567 (555 123 4567)", ["(555)123-4567", "555 123 4567"]), ("555-1234 555-1235", ["555-1234", "555-1235"]),
    ("email:x@localhost <y@z>", ["x@localhost", "y@z"]), ("a1 234 567b x@y.de", []), ("(555) (123-4567)", ["(555) (123-4567)"]),
])
def test_candidates(text, want):
    assert [text[s:e] for s, e, _ in candidates(text, base_spans(text))] == want


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.:=(<[)>]\"+ 0123456789-,é\n", max_size=60), st.integers(0, 250))
def test_patterns_are_counted_for_the_same_words(text, n):
    text = "x" * n + text
    used = set(_all_patterns(text_words(_apart(np.frombuffer(text.encode(), np.uint8)))).tolist()) if text.strip() else set()
    base = base_spans(text)
    found = candidates(text, base)
    assert all(a[1] <= b[0] or a[1] == b[1] for a, b in zip(found, found[1:]))
    for s, e in [(s, e) for s, _, e in base] + [(s, e) for s, e, _ in found]:
        assert set(patterns_beside(text, s, e)) <= used


def test_contexts_find_groups_of_digits_and_glued_values(make_docs):
    rows = [(k, f"some words {k} here my number: +1 (555) {100 + k}-{1000 + k} thanks and bye", "s") for k in range(20)]
    rows += [(20 + k, f"some words {k} here tel:+1555{100 + k}{1000 + k} thanks and bye", "s") for k in range(20)]
    rows += [(40 + k, f"some words {k} here my card is 4111-1111-1111-1111 or {c} but hush", "s") for k, c in enumerate(
        ["4012 8888 8888 1881", "5555 5555 5555 4444", "5105 1051 0510 5100", "3782 822463 10005", "6011 1111 1111 1117"])]
    texts = {
        100: ("my number: 555 123 4567 thanks", "555 123 4567"), 101: ("my number: (555) 123-4567 thanks", "(555) 123-4567"),
        102: ("here tel:5551234567 and", "5551234567"), 103: ("is or 4111 1111 1111 1112 but", "4111 1111 1111 1112"),
    }
    rows += [(k, t, "s") for k, (t, _) in texts.items()]
    found = {r.doc_id: r.added for r in personal_data(make_docs(rows)).collect()}
    for k, (text, want) in texts.items():
        assert [text[s.start : s.end] for s in found[k]] == [want], text
    assert all(found[k] == [] for k in range(45))


def test_a_token_with_many_fixed_forms_has_no_candidate_on_them():
    text = "k=" + "=".join(["x@y.de"] * 14) + " 1.2.3.4 " + " ".join(["+49 151 1234567"] * 12) + " 4111 1111 1111 1112"
    base = pii.base_spans(text)
    found = pii.candidates(text, base)
    assert len(base) > 20 and not any(s < e2 and e > s2 for s, e, _ in found for s2, _, e2 in base)


def test_words_beside_a_value_are_found_however_far_away():
    near, far = "my number: 555 today", "my number:" + " " * 5000 + "555" + "\n" * 3000 + "today"
    assert pii.patterns_beside(near, 11, 14) == pii.patterns_beside(far, far.index("555"), far.index("555") + 3)
    long_word = "w" * 3000
    assert pii.patterns_beside(f"a {long_word} 555", 3003, 3006) == pii.patterns_beside(f"zz a {long_word} 555", 3006, 3009)
