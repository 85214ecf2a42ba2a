"""Personal data in texts: fixed forms, and more of it found by the contexts they are used in.

The fixed forms (:data:`KINDS`) are found in every text and always reported. They are the seeds
of a bootstrap. The words around a seed are lexical patterns: one or two words before it, one after it; words
end behind a colon, equals sign, quotation mark or opening bracket, and before a quotation mark or closing bracket.
Other tokens that look a little like an identifier (digits that fail the check sum, a number
without its plus, an address without a domain) are candidates, and so are groups of digits with single blanks between. Patterns and values form a
graph, which is scored in turns: a pattern is as good as the share of all its uses in the corpus
that stand beside good values of one kind; a value is as good as its patterns together make it. Seeds
stay certain. At the end a candidate that stands beside a pattern of high confidence is reported with the pattern's kind.

The uses of a pattern are counted over all texts. Each text is read for that with a bit field of fixed size that
knows the patterns that matter, and the few words that pass it are joined with them exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shingles import _SLICE, column_bytes, mix, text_words
from quillon.operators.joins import lookup_join
from quillon.session import stored

KINDS = ("email", "ip", "card", "phone")
TURNS = 3
LEAST_SEEDS = 3  # distinct values beside a pattern
CONFIDENT = 0.5
FIELD_BITS = 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile("[0-9@]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_AROUND = 200  # characters looked at first for the words beside a value
_OPENS, _CLOSES = ':=([{<"', ')]}>"'  # a word ends behind the one and before the other
_APART = str.maketrans({c: " " * (c in _CLOSES) + c + " " * (c in _OPENS) for c in _OPENS + _CLOSES})
_BREAK = re.compile(r'(?<=[:=(\[{<"])|(?=[)\]}>"])')
_GROUPS = re.compile(r"[0-9(][0-9().-]*(?:\x20[0-9(][0-9().-]*)+")
_STRIP_LEFT, _STRIP_RIGHT = "\"'([{<,;:", "\"')]}>,;:.!?"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the fixed forms, sorted; each kind leftmost first and without overlaps."""
    found = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and _LOCAL_END.match(text[start - 1]):
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    if _DIGIT_OR_AT.search(text) is None:
        return found
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def could_be(token: str) -> int:
    """Bits of the kinds that a token looks like."""
    digits = sum(c.isdigit() for c in token)
    bits = 0
    if "@" in token[1:-1]:
        bits |= 1
    if token.count(".") >= 3 and re.fullmatch(r"[0-9.:]+", token):
        bits |= 2
    if 12 <= digits <= 19 and re.fullmatch("[0-9-]+", token):
        bits |= 4
    if 6 <= digits <= 15 and re.fullmatch("[0-9().-]+", token):
        bits |= 8
    return bits


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``start, end, kinds`` of tokens and groups of digits that look like identifiers and meet no fixed form.

    Those that overlap have the same end.
    """
    found, at, meets = [], 0, _meeting(base)
    while (m := _DIGIT_OR_AT.search(text, at)) is not None:
        start = m.start()
        while start > at and not _BLANK.match(text[start - 1]):
            start -= 1
        stop = _BLANK.search(text, m.start())
        end = at = stop.start() if stop else len(text)
        found += [(s, e, kinds) for s, e, kinds in _parts(text, start, end) if not meets(s, e)]
    alone = {e for _, e, kinds in found if kinds & 12}
    groups = _digit_groups(text, meets, alone)
    starts = [s for s, _, _ in groups]
    for s, e, kinds in found:
        k = bisect_left(starts, e) - 1
        if k < 0 or groups[k][1] <= s or groups[k][1] == e:
            groups.append((s, e, kinds))
    return sorted(set(groups))


def _meeting(base: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch meets any of the sorted spans: whether the furthest end of those that start before its end is beyond its start."""
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def meets(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k > 0 and furthest[k - 1] > start

    return meets


def _stripped(text: str, start: int, end: int) -> tuple[int, int]:
    token = text[start:end]
    start += len(token) - len(token.lstrip(_STRIP_LEFT))
    return start, max(start, start + len(text[start:end].rstrip(_STRIP_RIGHT)))


def _parts(text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """``start, end, kinds`` of a token between blanks, or of what stands in it behind marks."""
    s, e = _stripped(text, start, end)
    whole = could_be(text[s:e])
    if whole & ~1:
        return [(s - (text[s:e].count(")") > text[s:e].count("(") and text[s - 1 : s] == "("), e, whole)]
    cuts = [s, *(m.start() + s for m in _BREAK.finditer(text[s:e])), e]
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        a, b = _stripped(text, a, b)
        if b > a and (kinds := could_be(text[a:b])):
            parts.append((a, b, kinds))
    return parts or ([(s, e, whole)] if whole else [])


def _digit_groups(text: str, meets: Callable[[int, int], bool], alone: set[int]) -> list[tuple[int, int, int]]:
    """``start, end, kinds`` of runs of groups of digits with single blanks between: the longest that look like one number.

    A group at the end of which (``alone``) a candidate ends is the last of its run.
    """
    found = []
    for m in _GROUPS.finditer(text):
        groups: list[tuple[int, int] | None] = []  # None where a run cannot go on
        for g in re.finditer(r"[^\x20]+", m[0]):
            start, end = m.start() + g.start(), m.start() + g.end()
            close = start + len(text[start:end].rstrip(_STRIP_RIGHT.replace(")", "")))
            whole = _starts(text, start) and (end == len(text) or _BLANK.match(text[end]) or text[end] in _STRIP_RIGHT)
            if not whole or meets(start, end):
                groups.append(None)
                continue
            groups.append((start, close))
            if close < end or close in alone or _stripped(text, start, close)[1] in alone:
                groups.append(None)
        at = 0
        while at < len(groups):
            best, digits = None, 0
            for k in range(at, len(groups)):
                if groups[k] is None:
                    break
                digits += sum(c.isdigit() for c in text[slice(*groups[k])])
                if digits > 19:
                    break
                if k > at and (kinds := _grouped(text, groups[at][0], groups[k][1])):
                    best = kinds, k
            if best:
                found.append(best[0])
            at = best[1] + 1 if best else at + 1
    return found


def _grouped(text: str, start: int, end: int) -> tuple[int, int, int] | None:
    """``start, end, kinds`` of groups without the brackets around all of them."""
    token = text[start:end]
    while token.count(")") > token.count("(") and token.endswith(")"):
        token = token[:-1]
    while token.startswith("(") and (token.count("(") > token.count(")") or token.find(")") == len(token) - 1):
        token, start = token[1:].removesuffix(")") if token.count("(") == token.count(")") else token[1:], start + 1
    kinds = could_be(token.replace(" ", "")) & 12
    return (start, start + len(token), kinds) if kinds else None


def _starts(text: str, at: int) -> bool:
    """Whether a word starts there."""
    return at == 0 or text[at - 1] in _OPENS or text[at : at + 1] in tuple(_CLOSES) or _BLANK.match(text[at - 1]) is not None


def _ends(text: str, at: int) -> bool:
    """Whether a word ends there."""
    return at == len(text) or text[at] in _CLOSES or text[at - 1 : at] in tuple(_OPENS) or _BLANK.match(text[at]) is not None


def _apart(data: np.ndarray) -> np.ndarray:
    """The bytes of a text with blanks put in where words end at marks."""
    opens, closes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    opens[[ord(c) for c in _OPENS]] = 1
    closes[[ord(c) for c in _CLOSES]] = 1
    parts = []
    for k in range(0, len(data), _SLICE):
        part = data[k : k + _SLICE]
        ends = np.cumsum(1 + closes[part] + opens[part])
        out = np.full(int(ends[-1]), 32, dtype=np.uint8)
        out[ends - 1 - opens[part]] = part
        parts.append(out)
    return np.concatenate(parts) if parts else data


def _numbers(words: list[str]) -> list[int]:
    return [int(x) for x in text_words(np.frombuffer(" ".join(words).encode("utf-8", "replace"), np.uint8))]


def _pattern(side: int, first, second=0):
    """The number of a pattern: a side, the nearest word and perhaps the one before it."""
    with np.errstate(over="ignore"):
        x = mix(np.asarray(first, np.uint64) * np.uint64(4) + np.uint64(side))
        return mix(x + mix(np.asarray(second, np.uint64))).astype(np.int64)


def _words_before(text: str, start: int) -> list[str]:
    """The two whole words before a place, however far away."""
    reach = _AROUND
    while True:
        lo = max(0, start - reach)
        words = _WORD.findall(text[lo:start].translate(_APART))
        words = words[0 if lo == 0 or _starts(text, lo) else 1 :]
        if lo == 0 or len(words) >= 2:
            return words[-2:]
        reach *= 4


def _words_after(text: str, end: int) -> list[str]:
    """The whole word after a place, however far away."""
    reach = _AROUND
    while True:
        hi = min(len(text), end + reach)
        words = _WORD.findall(text[end:hi].translate(_APART))
        words = words[: len(words) if hi == len(text) or _ends(text, hi) else -1]
        if hi == len(text) or words:
            return words[:1]
        reach *= 4


def patterns_beside(text: str, start: int, end: int) -> list[int]:
    """Patterns of a value's place: the word before, the two words before, the word after."""
    before = _words_before(text, start) if _starts(text, start) else []
    after = _words_after(text, end) if _ends(text, end) else []
    numbers = _numbers(before + after)
    out = []
    if before:
        out.append(int(_pattern(1, numbers[len(before) - 1])))
    if len(before) == 2:
        out.append(int(_pattern(2, numbers[1], numbers[0])))
    if after:
        out.append(int(_pattern(3, numbers[-1])))
    return out


def _all_patterns(words: np.ndarray) -> np.ndarray:
    """The patterns of every place of a text, as often as they are used."""
    return np.concatenate([
        _pattern(1, words), _pattern(2, words[1:], words[:-1]) if len(words) > 1 else np.zeros(0, np.int64), _pattern(3, words),
    ])


_PLACE = "start int, end int, kinds int, seed boolean, value long, patterns array<long>"
_FOUND = f"base array<struct<start:int,kind:int,end:int>>, places array<struct<{_PLACE.replace(' ', ':').replace(',:', ',')}>>"


def found_in(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text``) as ``doc_id, h`` with the fixed forms, and all places of seeds and candidates."""

    @F.pandas_udf(f"struct<{_FOUND.replace('base array', 'base:array').replace(', places array', ',places:array')}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            bases, places = [], []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                spans = [(s, e, 1 << k, True) for s, k, e in base]
                if _DIGIT_OR_AT.search(text):
                    spans += [(s, e, kinds, False) for s, e, kinds in candidates(text, base)]
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                places.append([
                    {"start": s, "end": e, "kinds": kinds, "seed": seed, "value": _value(text[s:e]), "patterns": patterns_beside(text, s, e)}
                    for s, e, kinds, seed in spans
                ])
            yield pd.DataFrame({"base": bases, "places": places})

    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("h"), run(text).alias("x")).select("doc_id", "h", "x.*")


def _value(token: str) -> int:
    return int(np.uint64(sum(_numbers([token.replace(" ", "")])) & ((1 << 64) - 1)).astype(np.int64))


def _uses(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``pattern, uses``: how often each of the wanted patterns is used in all texts."""
    spark = docs.sparkSession
    slots = wanted.select(F.expr(f"pattern & {(1 << FIELD_BITS) - 1}").alias("slot")).distinct()
    packed = slots.groupBy(F.expr("slot div 4096").alias("block")).agg(F.collect_list((F.col("slot") % 4096).cast("int")).alias("bits"))
    field = np.zeros(1 << FIELD_BITS, dtype=bool)  # of fixed size, whatever the number of patterns
    for block, bits in packed.toLocalIterator():
        field[int(block) * 4096 + np.array(bits, dtype=np.int64)] = True
    shared = spark.sparkContext.broadcast(np.packbits(field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            met = []
            for data in column_bytes(batch.column(0)):
                if data is not None and len(data):
                    p = _all_patterns(text_words(_apart(data)))
                    met.append(p[known[p & ((1 << FIELD_BITS) - 1)]])
            pattern, uses = np.unique(np.concatenate(met) if met else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(uses.astype(np.int64))], names=["pattern", "uses"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern long, uses long")
    return counted.groupBy("pattern").agg(F.sum("uses").alias("uses")).join(wanted, "pattern").select("pattern", "uses")


def pattern_scores(docs: DataFrame, found: DataFrame, turns: int = TURNS, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """``pattern, kind, confidence`` after ``turns`` turns over the graph of patterns and values."""
    places = found.select(F.explode("places").alias("p")).select("p.*")
    edges = places.select("value", "kinds", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value", "kinds", "seed").agg(
        F.count(F.lit(1)).alias("n")
    )
    edges = stored(edges, "edges")
    seeded = edges.where("seed").groupBy("pattern").agg(F.count_distinct("value").alias("values")).where(F.col("values") >= least_seeds)
    wanted = stored(seeded.select("pattern"), "wanted")
    uses = stored(_uses(docs, wanted), "uses")
    bits = F.expr(f"filter(sequence(0, {len(KINDS) - 1}), k -> shiftright(kinds, k) & 1 = 1)")
    graph = edges.join(uses, "pattern").withColumn("kind", F.explode(bits))
    graph = stored(graph.select("pattern", "uses", "value", "kind", "seed", "n"), "graph")
    values = None
    for turn in range(turns):
        score = F.when(F.col("seed"), 1.0)
        rows = graph
        if values is not None:
            rows = rows.join(values, ["value", "kind"], "left")
            score = score.otherwise(F.coalesce("score", F.lit(0.0)))
        else:
            score = score.otherwise(0.0)
        share = F.least(F.lit(1.0), F.sum(F.col("n") * score) / F.max("uses"))
        patterns = stored(rows.groupBy("pattern", "kind").agg(share.alias("confidence")).where("confidence > 0"), "patterns")
        if turn < turns - 1:
            doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
            values = graph.where("NOT seed").join(patterns, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - doubt).alias("score"))
            values = stored(values, "values")
    return patterns


def personal_data(docs: DataFrame, confident: float = CONFIDENT, turns: int = TURNS, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """``doc_id, h, base, added`` per row: spans (``start, kind, end``, code points, kinds as numbers of :data:`KINDS`) of the fixed forms and
    those found by context.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. ``h`` is a hash of the text. A null text counts as empty. Equal texts
    have equal spans, repeated rows come out as often as they went in, ids may be null. Added spans meet no fixed
    form. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    found = stored(found_in(docs), "found")
    patterns = stored(pattern_scores(docs, found, turns, least_seeds).where(F.col("confidence") >= confident), "confident")
    open_places = found.select("h", F.explode("places").alias("p")).where("NOT p.seed").select(
        "h", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.kinds").alias("kinds"), F.explode("p.patterns").alias("pattern")
    ).distinct()
    told = open_places.join(patterns, "pattern").where("shiftright(kinds, kind) & 1 = 1")
    # Candidates that overlap have one end: the surest counts, then the longest.
    best = told.groupBy("h", "end").agg(F.max(F.struct("confidence", (-F.col("start")).alias("s"), (-F.col("kind")).alias("k"))).alias("b"))
    span = F.struct((-F.col("b.s")).alias("start"), (-F.col("b.k")).alias("kind"), "end")
    added = best.groupBy("h").agg(F.array_sort(F.collect_list(span)).alias("added"))
    rows = lookup_join(found.select("doc_id", "h", "base"), stored(added, "added"), "h", "left")
    return rows.withColumn("added", F.coalesce("added", F.filter("base", lambda s: F.lit(False))))


def digest_columns(rows: DataFrame) -> DataFrame:
    """Counts of the fixed forms, their digest, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
