"""Encoding texts into vocabulary pieces with the n best segmentations, and decoding them.

A text's segmentations are the paths of a lattice whose edges are pieces, and the best path has the
largest sum of scores. The forward Viterbi pass gives the best score up to every position.
Going backward from the end, a hypothesis can be completed at best by that score, exactly, so an
A* search that expands the most promising hypothesis first yields the paths from best to worst and visits
little else.

A lattice falls apart where no piece can lie across: between a character and a following blank, and around
line feeds, if the vocabulary has no such pieces. The n best of the text are then combined from those of its stretches:
they can differ from the best only in the n - 1 stretches whose second best path loses least, so
only those are searched backward. That is exact, whatever the length of the text.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
UNKNOWN_PENALTY = 10.0
_REMEMBERED = 200_000  # stretches, of at most _LONGEST_REMEMBERED characters, before the older half of what a worker knows is forgotten
_LONGEST_REMEMBERED = 40
_LENGTHS = (4, 6, 8, 10, 12, 14, 17, 22, 30, _LONGEST_REMEMBERED)  # up to which stretches are searched together
_SEARCHED = 16_384  # stretches at most in one search, which bounds its arrays
_SEEN_BITS = 20
_RANKED = 10_000  # stretches whose n best are remembered
_FACTORS, _WORD64 = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (1 << 64) - 1
_BATCH_TEXTS = 512  # texts whose results are in memory as Python objects
_BATCH_CHARACTERS = 1_000_000

#: One way to write a text: its score, and where it differs from the best one: from piece ``at`` on, ``n`` pieces are ``ids`` instead.
N_BEST_TYPE = "array<struct<score:double,changes:array<struct<at:int,n:int,ids:array<int>>>>>"
ENCODED_TYPE = f"struct<ids:array<int>,score:double,n_best:{N_BEST_TYPE}>"


def _packed(ids: bytes, score: float, loss: float) -> bytes:
    """A path as remembered: its ids, its score, and what the second best loses."""
    return ids + np.array([score, loss], np.float64).tobytes()


class Pieces:
    """A vocabulary as a lattice: pieces with blanks written as blanks, their ids and scores."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int] | None, unknown_id: int, ids: list[int] | None = None):
        """``pieces`` with scores; ``byte_ids`` of the 256 bytes that spell unknown characters, else ``unknown_id`` stands for them."""
        ids = list(range(len(pieces))) if ids is None else ids
        self.edges = {p: s for p, s in pieces}
        self.ids = {p: np.array([i], np.int32).tobytes() for (p, _), i in zip(pieces, ids)}
        self.longest = max(map(len, self.edges), default=1)
        ends: dict[str, set[int]] = {}
        for piece in self.edges:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {end: tuple(sorted(sizes, reverse=True)) for end, sizes in ends.items()}  # of pieces that end so
        self._index()
        self.unknown = min(self.edges.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        self.spelled = {i: p.encode() for (p, _), i in zip(pieces, ids)}
        for value, i in enumerate(byte_ids or ()):
            self.spelled[i] = bytes([value])
        inner = any(re.search("[^ ] ", p) for p in self.edges)
        lines = any("\n" in p and len(p) > 1 for p in self.edges)
        stretch = "(?s).+" if inner else " +[^ ]*|[^ ]+" if lines else r"\n| +[^ \n]*|[^ \n]+"
        self.stretches = re.compile(stretch).findall
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ranked: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(model.get_piece_size())
        skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        plain = [i for i in every if not skip(i)]
        found = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
        return cls(
            [(model.id_to_piece(i).replace("▁", " "), model.get_score(i)) for i in plain],
            [found[b] for b in range(256)] if len(found) == 256 else None, model.unk_id(), plain,
        )

    def _spell(self, piece: str) -> bytes:
        known = self.ids.get(piece)
        if known is not None:
            return known
        ids = [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown_id]
        return np.array(ids, np.int32).tobytes()

    def forward(self, text: str) -> tuple[list[float], list[int], float]:
        """Best score up to each position, the start of the best last piece, and the second best score at the end."""
        edges, lengths, unknown = self.edges.get, self.lengths.get, self.unknown
        lowest = float("-inf")
        best, second, start = [0.0], [lowest], [0]
        for j in range(1, len(text) + 1):
            b1 = b2 = lowest
            at = j - 1
            if j > 1:
                for size in lengths(text[j - 2 : j], ()):  # longest first: it wins ties
                    i = j - size
                    if i >= 0 and (s := edges(text[i:j])) is not None:
                        v = best[i] + s
                        if v > b1:
                            w = second[i] + s
                            b2 = b1 if b1 > w else w
                            b1, at = v, i
                        elif v > b2:
                            b2 = v
            s = edges(text[j - 1])
            if s is None:
                s = unknown
            v = best[j - 1] + s
            if v > b1:
                w = second[j - 1] + s
                b2 = b1 if b1 > w else w
                b1, at = v, j - 1
            elif v > b2:
                b2 = v
            best.append(b1)
            second.append(b2)
            start.append(at)
        return best, start, second[-1]

    def _index(self) -> None:
        """The pieces by two hashes of their characters, and their scores, for looking up many stretches at once."""
        hashes = np.zeros((2, len(self.edges)), np.uint64)
        for k, piece in enumerate(self.edges):
            for row in range(2):
                h = 0
                for c in piece:
                    h = (h * _FACTORS[row] + ord(c) + 1) & _WORD64
                hashes[row, k] = h
        order = np.argsort(hashes[0], kind="stable")
        self.hashes, self.checks = hashes[0, order], hashes[1, order]
        self.scores = np.array(list(self.edges.values()), np.float64)[order]
        self.places = np.frombuffer(b"".join(self.ids.values()), np.int32)[order]
        self.seen = np.zeros(1 << _SEEN_BITS, bool)  # tells most strings that are no piece from the pieces, in one step
        self.seen[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(_FACTORS[0])) >> np.uint64(64 - _SEEN_BITS)

    def _looked_up(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores and ids of the pieces with these hashes, minus infinity and -1 where there is none."""
        scores, ids = np.full(hashes.size, -np.inf), np.full(hashes.size, -1, np.int32)
        maybe = np.flatnonzero(self.seen[self._slot(hashes)])
        wanted, check = hashes.ravel()[maybe], checks.ravel()[maybe]
        if len(wanted):
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            found = (self.hashes[at] == wanted) & (self.checks[at] == check)
            scores[maybe[found]], ids[maybe[found]] = self.scores[at[found]], self.places[at[found]]
        return scores.reshape(hashes.shape), ids.reshape(hashes.shape)

    def best_paths(self, texts: list[str]) -> list[tuple[bytes, float, float]]:
        """:meth:`best_path` of several texts."""
        return [(path[:-16], *map(float, np.frombuffer(path[-16:], np.float64))) for path in self._packed_paths(texts)]

    def _packed_paths(self, texts: list[str]) -> list[bytes]:
        """:meth:`best_path` of several texts, each packed by :func:`_packed`: the same forward pass, one position of all texts at a time.

        Shorter texts are filled up; no score depends on what comes behind it.
        """
        sizes, m = np.array([len(t) for t in texts]), len(texts)
        n, every = int(sizes.max()), np.arange(m)
        filled = "".join([t.ljust(n, "\0") for t in texts]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(filled, np.uint32).reshape(m, n).T.astype(np.uint64) + np.uint64(1)
        best, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        start, last, best[0] = np.zeros((n + 1, m), np.int64), np.full((n + 1, m), -1, np.int32), 0.0
        hashes, checks = np.zeros((n, m), np.uint64), np.zeros((n, m), np.uint64)  # of what starts at each position
        for j in range(1, n + 1):
            first = max(0, j - self.longest)
            hashes[first:j] = hashes[first:j] * np.uint64(_FACTORS[0]) + codes[j - 1]
            checks[first:j] = checks[first:j] * np.uint64(_FACTORS[1]) + codes[j - 1]
            b1, b2, at, of = np.full(m, -np.inf), np.full(m, -np.inf), np.full(m, j - 1), np.full(m, -1, np.int32)
            scores, ids = self._looked_up(hashes[first:j], checks[first:j])
            scores[-1] = np.where(ids[-1] < 0, self.unknown, scores[-1])
            for i in np.flatnonzero((scores > -np.inf).any(axis=1)).tolist():  # longest first: it wins ties
                s, i = scores[i], i + first
                v, w = best[i] + s, second[i] + s
                better = v > b1
                b2 = np.where(better, np.maximum(b1, w), np.maximum(b2, v))
                b1, at, of = np.where(better, v, b1), np.where(better, i, at), np.where(better, ids[i - first], of)
            best[j], second[j], start[j], last[j] = b1, b2, at, of
        total = best[sizes, every]
        found, fewest, plain = np.zeros((m, n + 4), np.int32), np.full(m, n), np.ones(m, bool)  # a text's ids before the two numbers that end its row
        found[:, n:] = np.stack([total, total - second[sizes, every]], axis=1).view(np.int32)
        at, going = sizes, every
        while len(going):
            fewest[going] -= 1
            found[going, fewest[going]] = last[at, going]
            plain[going] &= last[at, going] >= 0
            at = start[at, going]
            going, at = going[at > 0], at[at > 0]
        whole, row = found.tobytes(), 4 * (n + 4)
        out = [whole[at:end] for at, end in zip((every * row + 4 * fewest).tolist(), range(row, (m + 1) * row, row))]
        for k in np.flatnonzero(~plain).tolist():  # characters outside the vocabulary
            pieces, j = [], len(texts[k])
            while j:
                pieces.append(self._spell(texts[k][start[j, k] : j]))
                j = int(start[j, k])
            out[k] = b"".join(reversed(pieces)) + out[k][-16:]
        return out

    def _learn(self, parts: set[str]) -> None:
        """Remembers the best paths of stretches; those of about one length are searched together."""
        if len(self.remembered) > _REMEMBERED:
            self.older, self.remembered = self.remembered, {}
        by_length: dict[int, list[str]] = {}
        for part in parts.difference(self.remembered):
            if part in self.older:
                self.remembered[part] = self.older[part]
            elif len(part) <= _LONGEST_REMEMBERED:
                by_length.setdefault(bisect.bisect_left(_LENGTHS, len(part)), []).append(part)
        for group in by_length.values():
            for k in range(0, len(group), _SEARCHED):
                some = group[k : k + _SEARCHED]
                self.remembered.update(zip(some, self._packed_paths(some)))

    def encode_all(self, texts: list[str], n: int = N_BEST) -> list[tuple[np.ndarray, float, list[tuple[float, list]]]]:
        """:meth:`encode` of several texts; stretches that are new to the worker are searched together."""
        parts = [self.stretches(" " + t) if t else [] for t in texts]
        self._learn(set().union(*parts))
        return [self._encoded(p, n) for p in parts]

    def best_path(self, text: str) -> tuple[bytes, float, float]:
        """Ids of the best path, its score, and what the second best loses; of equal paths, that with longer pieces at the end."""
        best, start, second = self.forward(text)
        spelled, j = [], len(text)
        while j:
            spelled.append(self._spell(text[start[j] : j]))
            j = start[j]
        return b"".join(reversed(spelled)), best[-1], best[-1] - second

    def n_best(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best paths, best first: backward A* search guided by the forward scores."""
        best, _, _ = self.forward(text)
        heap, order, found = [(-best[-1], 0, len(text), 0.0, None)], 0, []
        while heap and len(found) < n:
            _, _, j, score, path = heapq.heappop(heap)
            if j == 0:
                spelled = []
                while path:
                    spelled.append(self._spell(path[0]))
                    path = path[1]
                found.append((score, b"".join(spelled)))
                continue
            for i in range(j - 1, max(0, j - self.longest) - 1, -1):
                s = self.edges.get(text[i:j])
                if s is None and i == j - 1:
                    s = self.unknown
                if s is not None:
                    order -= 1  # of equal hypotheses, the one found last: the longest piece
                    heapq.heappush(heap, (-(score + s + best[i]), order, i, score + s, (text[i:j], path)))
        return found

    def _ranked(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """:meth:`n_best`, remembered for short stretches: those that lose little recur."""
        known = self.ranked.get((part, n))
        if known is None:
            known = self.n_best(part, n)
            if len(part) <= _LONGEST_REMEMBERED:
                if len(self.ranked) >= _RANKED:
                    self.ranked.clear()
                self.ranked[part, n] = known
        return known

    def encode(self, text: str, n: int = N_BEST) -> tuple[np.ndarray, float, list[tuple[float, list]]]:
        """Ids and score of the best segmentation, and the ``n`` best as scores with changes (:data:`N_BEST_TYPE`).

        A blank is put before the text. Equal scores: fewer changed stretches first, then earlier ones.
        """
        return self.encode_all([text], n)[0]

    def _encoded(self, parts: list[str], n: int) -> tuple[np.ndarray, float, list[tuple[float, list]]]:
        if not parts:
            return np.zeros(0, np.int32), 0.0, [(0.0, [])]
        paths = list(map(self.remembered.get, parts))
        if None in paths:
            paths = [path or _packed(*self.best_path(part)) for path, part in zip(paths, parts)]
        joined = np.frombuffer(b"".join(paths), np.int32)
        ends = np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths))) // 4
        tails = ends[:, None] + np.arange(-4, 0)
        totals, losses = joined[tails].view(np.float64).T
        plain = np.ones(len(joined), bool)
        plain[tails] = False
        ids, score = joined[plain], float(sum(totals.tolist()))
        if n < 2:
            return ids, score, [(score, [])]
        nearest = np.flatnonzero(np.isfinite(losses))
        if len(nearest) >= n:
            edge = np.partition(losses[nearest], n - 2)[n - 2]
            nearest = nearest[losses[nearest] <= edge]
            nearest = np.sort(nearest[np.argsort(losses[nearest], kind="stable")][: n - 1])
        return ids, score, self._combined(parts, (ends - 4 * np.arange(1, len(ends) + 1)).tolist(), nearest.tolist(), score, n)

    def _combined(self, parts: list[str], ends: list[int], nearest: list[int], score: float, n: int) -> list[tuple[float, list]]:
        """The ``n`` best combinations of the paths of a few stretches; ``ends`` says where the ids of each stretch end."""
        kept = [(0.0, 0, (), ())]  # loss, changed stretches, order, choices
        options = {}
        for k in nearest:
            options[k] = self._ranked(parts[k], n)
            more = []
            for loss, changed, order, choice in kept:
                for c, (path_score, _) in enumerate(options[k]):
                    more.append((loss + options[k][0][0] - path_score, changed + (c > 0), (*order, -1 if c else 0, c), (*choice, c)))
            kept = heapq.nsmallest(n, more)
        starts = {k: ends[k - 1] if k else 0 for k in nearest}
        out = []
        for loss, _, _, choice in kept:
            changes = [
                (starts[k], ends[k] - starts[k], np.frombuffer(options[k][c][1], np.int32).tolist())
                for k, c in zip(nearest, choice) if c
            ]
            out.append((score - loss, changes))
        return out

    def decode(self, ids) -> str:
        """The text that ids spell; bytes that are not UTF-8 become replacement characters."""
        spelled = self.spelled
        text = b"".join([spelled.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=4)
def loaded(model_file: str) -> Pieces:
    """The vocabulary of a file, read once per worker."""
    return Pieces.load(model_file)


def _parts(texts: pd.Series) -> Iterator[pd.Series]:
    """A batch in pieces of few texts and characters, or of one long text."""
    sizes = texts.str.len().fillna(0).to_numpy()
    start = size = 0
    for k, length in enumerate(sizes):
        if k > start and (k - start >= _BATCH_TEXTS or size + length > _BATCH_CHARACTERS):
            yield texts[start:k]
            start, size = k, 0
        size += length
    if start < len(texts):
        yield texts[start:]


def encode(model_file: str = MODEL_FILE, n: int = N_BEST) -> Callable[[Column], Column]:
    """A column function from a text to :data:`ENCODED_TYPE`: ids and score of the best segmentation, and the n best.

    A null text gives null, an empty one no ids. Every character is spelled: those outside the
    vocabulary as their bytes. ``model_file`` must be there on every worker.
    """

    @F.pandas_udf(ENCODED_TYPE)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model_file)
        for texts in batches:
            for part in _parts(texts):
                found = iter(pieces.encode_all([t for t in part if t is not None], n))
                rows = [(None, None, None) if t is None else next(found) for t in part]
                best = [
                    None if r[2] is None else [
                        {"score": s, "changes": [{"at": at, "n": k, "ids": ids} for at, k, ids in changes]} for s, changes in r[2]
                    ] for r in rows
                ]
                yield pd.DataFrame({"ids": [r[0] for r in rows], "score": [r[1] for r in rows], "n_best": best})

    return encoded


def decode(model_file: str = MODEL_FILE) -> Callable[[Column], Column]:
    """A column function from an array of ids back to the text; null gives null, ids without spelling give nothing."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = loaded(model_file)
        for ids in batches:
            yield pd.Series([None if i is None else pieces.decode(i.tolist()) for i in ids], dtype=object)

    return decoded


def with_pieces(docs: DataFrame, model_file: str = MODEL_FILE, n: int = N_BEST) -> DataFrame:
    """``docs`` with ``ids, score, n_best`` of each whole text; columns of these names are replaced, all others kept.

    Repeated rows get equal results, and an empty table gives an empty one.
    """
    rows = docs.drop("ids", "score", "n_best").withColumn("_encoded", encode(model_file, n)(F.col("text").cast("string")))
    return rows.select("*", "_encoded.*").drop("_encoded")
