"""Licence wordings in texts, found by conditional compression and confirmed word by word.

Around every word that licences are named or granted with, the text is cut into a candidate block of
a few words each way. Equal blocks are one. A block is compressed alone and with each known wording as a raw
dictionary; the wording that saves most bytes is the likeliest. All wordings of which the block has enough words are
laid over it word by word, at every place where they have a stretch of words in common: what is missing, what is put in and
what is changed is listed exactly, and a wording counts as found only if enough of it is there in unbroken order. Of those
that fit, the one with most words counts, then the likeliest.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.license_texts import TEMPLATES
from quillon.operators.joins import lookup_join
from quillon.session import stored

#: Words that a candidate block is cut around.
TRIGGER = re.compile(r"licen[sc]e|permission|redistribution|unencumbered|warrant|creative commons", re.IGNORECASE)
LEAST_COVERED = 0.85  # of a wording's words
MOST_PUT_IN = 0.15  # words within it that are not its own, as a share of its words
LEVEL = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = re.compile(r"[\W_]+")


def _placed_words(text: str) -> list[tuple[int, int, str]]:
    """``start, end, word`` of the words of a text, plain; what is only punctuation is no word."""
    found = [(*m.span(), _PLAIN.sub("", m[0].lower())) for m in _WORD.finditer(text)]
    return [w for w in found if w[2]]


def _words(text: str) -> list[str]:
    return [w for _, _, w in _placed_words(text)]


#: Words to each side of a trigger: no wording reaches further from any of its triggers.
REACH = max(len(_WORD.findall(t)) for _, t in TEMPLATES)


def blocks_of(text: str | None) -> list[tuple[int, int]]:
    """``start, end`` of the candidate blocks, whole words around triggers; overlapping ones are united."""
    if not text or TRIGGER.search(text) is None:
        return []
    out: list[list[int]] = []
    spans: list[tuple[int, int]] | None = None
    at = 0
    for m in TRIGGER.finditer(text):
        if spans is None:
            spans = [w.span() for w in _WORD.finditer(text)]
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        first, last = max(0, at - REACH), min(len(spans) - 1, at + REACH)
        if out and first <= out[-1][1] + 1:
            out[-1][1] = last
        else:
            out.append([first, last])
    return [(spans[a][0], spans[b][1]) for a, b in out]


def _stretches(wording: list[str], at: dict[str, list[int]], least: int) -> list[tuple[int, int, int]]:
    """``a, b, size`` of the stretches that a wording and a block have in common and that go on neither way: longest, then first."""
    found, open_ = [], {}
    for a, w in enumerate([*wording, None]):
        longer = {b: open_.pop(b, 0) + 1 for b in at.get(w, ())}
        found += [(a - size, b - size, size) for b, size in open_.items() if size >= least]
        open_ = {b + 1: size for b, size in longer.items()}
    return sorted(found, key=lambda x: (-x[2], x[0], x[1]))


class Scan:
    """The wordings with their dictionaries, and how blocks are compared with them."""

    def __init__(self, templates=TEMPLATES):
        import zstandard

        self.templates = [(name, _words(text)) for name, text in templates]
        self.counts = [Counter(words) for _, words in self.templates]
        plain = [" ".join(words).encode() for _, words in self.templates]
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t, dict_type=raw)) for t in plain]

    def saved(self, words: list[str]) -> list[int]:
        """Bytes that each wording saves when the block is compressed."""
        data = " ".join(words).encode()
        size = len(self.alone.compress(data))
        return [size - len(c.compress(data)) for c in self.given]

    def found(self, block: str) -> list[dict]:
        """Wordings in a block: name, place in it (characters), bytes saved and differences."""
        placed = _placed_words(block)
        places, words = [(a, b) for a, b, _ in placed], [w for _, _, w in placed]
        out: list[dict] = []
        taken = [False] * len(words)
        while True:
            rest = ["\0" if t else w for w, t in zip(words, taken)]
            saved = self.saved([w for w in rest if w != "\0"])
            ranked = sorted(range(len(saved)), key=lambda i: (-saved[i], i))
            at = defaultdict(list)
            for k, w in enumerate(rest):
                at[w].append(k)
            best = None
            for i in ranked:
                wording = self.templates[i][1]
                there = sum(min(n, len(at.get(w, ()))) for w, n in self.counts[i].items())
                if there < LEAST_COVERED * len(wording) or best is not None and there < best[0]["covered"]:
                    continue
                fit = self._laid_over(i, rest, at)
                if fit and (best is None or (fit["covered"], saved[i]) > (best[0]["covered"], best[2])):
                    best = (fit, i, saved[i])
            if best is None:
                return sorted(out, key=lambda x: x["start"])
            fit, i, bytes_saved = best
            for k in range(fit["first"], fit["last"] + 1):
                taken[k] = True
            out.append({
                "name": self.templates[i][0], "wording": i, "start": places[fit["first"]][0], "end": places[fit["last"]][1],
                "saved": bytes_saved, "missing": fit["missing"], "put_in": fit["put_in"],
            })

    def _laid_over(self, i: int, words: list[str], at: dict[str, list[int]]) -> dict | None:
        """The exact differences at the first place with enough of a wording, the longest common stretches first.

        ``at`` has the places of each word. A place that fits has at least one stretch of the least length: there are too few
        breaks in it for shorter ones only.
        """
        wording, counts = self.templates[i][1], self.counts[i]
        tried = set()
        for a, b, _ in _stretches(wording, at, max(1, min(3, len(wording) // 2))):
            # Only the words beside the common stretch can belong to this place.
            lo = max(0, b - int(a * (1 + MOST_PUT_IN)) - 1)
            hi = min(len(words), b + int((len(wording) - a) * (1 + MOST_PUT_IN)) + 1)
            if (lo, hi) in tried:
                continue
            tried.add((lo, hi))
            there = Counter(words[lo:hi])
            if sum(min(n, there[w]) for w, n in counts.items()) < LEAST_COVERED * len(wording):
                continue
            fit = self._differences(wording, words, lo, hi)
            if fit:
                return fit
        return None

    def _differences(self, wording: list[str], words: list[str], lo: int, hi: int) -> dict | None:
        same = [m for m in difflib.SequenceMatcher(None, wording, words[lo:hi], autojunk=False).get_matching_blocks() if m.size]
        covered = sum(m.size for m in same)
        first, last = lo + same[0].b, lo + same[-1].b + same[-1].size - 1
        put_in = last - first + 1 - covered
        if covered < LEAST_COVERED * len(wording) or put_in > MOST_PUT_IN * len(wording):
            return None
        kept = {m.a + k for m in same for k in range(m.size)}
        return {
            "covered": covered, "first": first, "last": last,
            "missing": [w for k, w in enumerate(wording) if k not in kept],
            "put_in": [w for k, w in enumerate(words[first : last + 1]) if not any(m.b + lo - first <= k < m.b + lo - first + m.size for m in same)],
        }


_BLOCKS = "array<struct<start:int,end:int,block:string>>"
_MATCHES = (
    "array<struct<name:string,wording:int,start:int,end:int,saved:int,missing:array<string>,put_in:array<string>>>"
)


def licence_spans(docs: DataFrame) -> DataFrame:
    """One row per licence wording in a text: ``doc_id, h, start, end, name, saved, missing, put_in``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. ``start`` and ``end`` are code points of the whole text, ``h``
    is a hash of it, ``saved`` counts the bytes the wording saves, ``missing`` and ``put_in`` are the words that differ. Of equally good
    wordings the first listed counts. Null and empty texts have none; equal texts have equal spans, rows that repeat both id and text come out once.
    Ids may be null. An empty table gives an empty result.
    """

    @F.pandas_udf(_BLOCKS)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b, "block": t[a:b]} for a, b in blocks_of(t)] for t in texts])

    @F.pandas_udf(_MATCHES)
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = Scan()
        for blocks in batches:
            yield pd.Series([scan.found(b) for b in blocks])

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.explode(cut(text)).alias("b")).select("doc_id", "h", "b.*")
    rows = stored(rows.select("doc_id", "h", "start", F.sha2("block", 256).alias("key"), "block"), "blocks")
    distinct = rows.groupBy("key").agg(F.first("block").alias("block"))
    known = distinct.select("key", matched("block").alias("found")).where(F.size("found") > 0)
    met = lookup_join(rows.drop("block"), stored(known, "known"), "key").distinct()
    met = met.select("doc_id", "h", F.col("start").alias("at"), F.explode("found").alias("f"))
    return met.select(
        "doc_id", "h", (F.col("at") + F.col("f.start")).alias("start"), (F.col("at") + F.col("f.end")).alias("end"),
        F.col("f.name").alias("name"), F.col("f.saved").alias("saved"), F.col("f.missing").alias("missing"), F.col("f.put_in").alias("put_in"),
    )
