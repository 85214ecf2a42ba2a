"""How the tokens of two tokenizers meet: links between tokens that share bytes, counted over the corpus by bitmaps.

Each text is cut by both tokenizers. A token of one is linked with every token of the other whose bytes overlap its own, and bytes
where both have a token end cut the text into groups.

How common a pair of ids is, is how many documents hold it linked. Documents are numbered inside blocks of up to ``BLOCK_DOCUMENTS``
by the task that reads them, and each pair of a block gets a bitmap of the documents that hold it, merged by OR from the
batches of the block, as sorted numbers or as bits, whichever is shorter. How often a document holds it stands in further bitmaps,
one per binary digit of the further times: popcounts of the first add up to document counts, those of the planes,
times their digit, to link counts. The bitmaps are also postings: a pair's counts, once known, are
sent along them, back to the documents of the block, which add up what their links are worth.

A task keeps one block, bounded in documents and links. What is shuffled is a bitmap per pair and block, not a row per link.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.joins import lookup_join
from quillon.session import stored

BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how a byte-level vocabulary cuts text into words.
BYTE_LEVEL_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_DOCUMENTS = 4096
BLOCK_LINKS = 3_000_000
BATCH_DOCUMENTS = 256
BATCH_CHARACTERS = 500_000
_SLOT_BITS = 12
_DENSE_BYTES = BLOCK_DOCUMENTS // 8
_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "pair long, plane int, n int, bits binary"
_CUT = f"block long, slot int, {_DOCUMENT}, {_POSTING}"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_CUT_SCHEMA = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in _CUT.split(", ")])


def _byte_of_character() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: visible ones for themselves, the others numbered from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ranked(stated: dict, spelled: list[bytes]):
    """A faster encoder with the same results, if ids of merged tokens ascend in the order of the merges; else nothing.

    Such ids are ranks: of the pairs in a word, the one that spells the token with the lowest id is merged first.
    """
    model, before = stated["model"], stated.get("pre_tokenizer") or {}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = not stated.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if model["type"] != "BPE" or model.get("ignore_merges") or not plain or merged != sorted(merged):
        return None
    import tiktoken

    first = {t["id"] for t in stated["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks={x: i for i, x in enumerate(spelled) if i not in first}, special_tokens={})


class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, byte_tokenizer: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(byte_tokenizer)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        with open(byte_tokenizer, encoding="utf-8") as file:
            stated = json.load(file)
        vocabulary = stated["model"]["vocab"]
        byte = _byte_of_character()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes([byte[c] for c in token]) if all(c in byte for c in token) else token.encode()
        spell = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [spell(i) for i in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in s], np.int64) for s in (self.bytes_a, self.bytes_b))
        self.fast = _ranked(stated, self.bytes_a)
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = np.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], dtype=object).reshape(3, most)

    def cut(self, texts: list[str]) -> tuple[list, list]:
        """Ids of each text by both, or empty ones where their bytes are not those of a blank and the text."""
        led = [" " + t for t in texts]
        if self.fast:
            by_a = [self.fast.encode_ordinary(t) for t in led]
        else:
            by_a = [e.ids for e in self.a.encode_batch(led, add_special_tokens=False)]
        by_b = self.b.encode(texts, num_threads=1)
        for k, text in enumerate(texts):
            raw = b" " + text.encode()
            if not text or any(
                raw != b"".join(map(spelled.__getitem__, ids)) for ids, spelled in ((by_a[k], self.bytes_a), (by_b[k], self.bytes_b))
            ):
                by_a[k], by_b[k] = [], []
        return by_a, by_b


@functools.lru_cache(maxsize=2)
def loaded(byte_tokenizer: str, piece_model: str) -> Tokenizers:
    """The tokenizers of two files, read once per worker."""
    return Tokenizers(byte_tokenizer, piece_model)


@dataclass
class Links:
    """Texts of a batch one after the other: counts per text, the digests of their groups, and the linked ids with the text's number."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups_sha256: list[str]
    text: np.ndarray
    a: np.ndarray
    b: np.ndarray


def link(tokenizers: Tokenizers, texts: list[str]) -> Links:
    """The links of a batch of texts. Ends of both tokenizers meet at the end of every text, so the texts are treated as one."""
    by_a, by_b = tokenizers.cut(texts)
    n_a, n_b = (np.array([len(ids) for ids in by], np.int64) for by in (by_a, by_b))
    a, b = (np.fromiter(itertools.chain.from_iterable(by), np.int64, n.sum()) for by, n in ((by_a, n_a), (by_b, n_b)))
    end_a, end_b = np.cumsum(tokenizers.sizes_a[a]), np.cumsum(tokenizers.sizes_b[b])
    start_a, start_b = end_a - tokenizers.sizes_a[a], end_b - tokenizers.sizes_b[b]
    first, after = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = after - first
    linked_a = np.repeat(np.arange(len(a)), n)
    linked_b = np.arange(len(linked_a)) + np.repeat(first - (np.cumsum(n) - n), n)
    text_of_a = np.repeat(np.arange(len(texts)), n_a)
    per_text = lambda x: np.bincount(text_of_a, x, len(texts)).astype(np.int64)

    # Groups: a token belongs to the first common end that is not before its own.
    common = end_a[end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a] if len(a) else end_a
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    side = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    follows = np.append(side[1:], -1)
    mark = np.where(follows == side, 0, np.where(follows >> 1 == side >> 1, 1, 2))
    written = tokenizers.written[mark, np.concatenate([a, b])[order]].tolist()
    upto = np.cumsum(n_a + n_b).tolist()
    digests = [
        hashlib.sha256("".join(written[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip([0, *upto], upto)
    ]
    ends = np.bincount(np.searchsorted(np.cumsum(n_a), np.searchsorted(end_a, common), "right"), minlength=len(texts))
    return Links(n_a, n_b, ends, per_text(n), digests, text_of_a[linked_a], a[linked_a], b[linked_b])


def _bitmaps(keys: np.ndarray, plane: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Pairs, popcounts and bitmaps from sorted keys of pair and slot."""
    pairs, start, n = np.unique(keys >> _SLOT_BITS, return_index=True, return_counts=True)
    slots = (keys & (BLOCK_DOCUMENTS - 1)).astype("<u2")
    raw = slots.tobytes()
    bits = [raw[2 * s : 2 * (s + c)] for s, c in zip(start.tolist(), n.tolist())]
    for k in np.flatnonzero(2 * n >= _DENSE_BYTES).tolist():
        held = np.zeros(BLOCK_DOCUMENTS, np.uint8)
        held[slots[start[k] : start[k] + n[k]]] = 1
        bits[k] = np.packbits(held, bitorder="little").tobytes()
    return pairs, n, bits


def bitmap_slots(bits: bytes, n: int) -> np.ndarray:
    """The documents of a bitmap with ``n`` of them."""
    if 2 * n >= _DENSE_BYTES:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    return np.frombuffer(bits, "<u2").astype(np.int64)


class _Block:
    """Documents and links that wait to be written as rows of :data:`_CUT`."""

    def __init__(self, number: int):
        self.number, self.documents, self.keys, self.links = number, [], [], 0

    def add(self, ids: list, found: Links) -> None:
        slot = len(self.documents)
        self.documents += zip(ids, found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), found.n_links.tolist(), found.groups_sha256)
        self.keys.append(((found.a << 16 | found.b) << _SLOT_BITS) | (found.text + slot))
        self.links += len(found.a)

    def rows(self) -> Iterator[pa.RecordBatch]:
        n = len(self.documents)
        columns = dict(zip([f.split()[0] for f in _DOCUMENT.split(", ")], zip(*self.documents)))
        yield _batch(n, block=[self.number] * n, slot=range(n), **columns)
        keys, times = np.unique(np.concatenate(self.keys), return_counts=True)
        planes = [(-1, keys)] + [(k, keys[(times - 1) >> k & 1 == 1]) for k in range(int(times.max(initial=1) - 1).bit_length())]
        for plane, chosen in planes:
            pairs, count, bits = _bitmaps(chosen, plane)
            for s in range(0, len(pairs), 20_000):
                part = slice(s, s + 20_000)
                m = len(pairs[part])
                yield _batch(m, block=[self.number] * m, pair=pairs[part], plane=[plane] * m, n=count[part].astype(np.int32), bits=bits[part])


def _batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _CUT_SCHEMA], schema=_CUT_SCHEMA
    )


def _cutter(byte_tokenizer: str, piece_model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = loaded(byte_tokenizer, piece_model)
        made = TaskContext.get().partitionId() << 32
        block = _Block(made)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and upto - at < BATCH_DOCUMENTS and size < BATCH_CHARACTERS:
                    size += len(texts[upto].as_py() or "")
                    upto += 1
                found = link(tokenizers, [t or "" for t in texts[at:upto].to_pylist()])
                if block.documents and (len(block.documents) + upto - at > BLOCK_DOCUMENTS or block.links + len(found.a) > BLOCK_LINKS):
                    yield from block.rows()
                    block = _Block(block.number + 1)
                block.add(ids[at:upto].to_pylist(), found)
                at = upto
        if block.documents:
            yield from block.rows()

    return run


def _scored(documents: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block with what the postings of its pairs bring them."""
    documents = documents.sort_values("slot")
    out = np.zeros((2, BLOCK_DOCUMENTS), dtype=np.int64)
    dense = 2 * postings["n"].to_numpy() >= _DENSE_BYTES
    sparse = postings[~dense]
    slots = [np.frombuffer(b"".join(sparse["bits"]), "<u2").astype(np.int64)]
    row = [np.repeat(np.flatnonzero(~dense), sparse["n"])]
    for k in np.flatnonzero(dense).tolist():
        slots.append(bitmap_slots(postings["bits"].iat[k], int(postings["n"].iat[k])))
        row.append(np.full(len(slots[-1]), k))
    slots, row = np.concatenate(slots), np.concatenate(row).astype(np.int64)
    times = np.left_shift(1, np.maximum(postings["plane"].to_numpy(np.int64), 0))
    np.add.at(out[0], slots, (times * postings["best"].to_numpy(np.int64))[row])
    np.add.at(out[1], slots, (times * postings["n_docs"].to_numpy(np.int64))[row])
    at = documents["slot"].to_numpy()
    return documents.drop(columns=["block", "slot"]).assign(n_best=out[0, at], count_sum=out[1, at])


def alignment(
    docs: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_model: str = PIECE_MODEL,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their counts, and the pairs of linked ids with how many documents hold them and how many links there are.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored. A text that is null or empty, or that the tokens of either
    tokenizer do not spell byte for byte after a blank, has no tokens: zeros and an empty digest. Repeated rows are documents of their own.
    An empty table gives empty results. Both files must be there on every worker.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` and ``a, b, n_docs, n_links, best``; ``best`` pairs have the most
    documents of their ``a``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = stored(texts.mapInArrow(_cutter(byte_tokenizer, piece_model), _CUT), "cut")
    postings = cut.where("plane IS NOT NULL").select("block", *[f.split()[0] for f in _POSTING.split(", ")])
    held = F.when(F.col("plane") < 0, F.col("n"))
    times = F.col("n") * F.expr("shiftleft(1L, greatest(plane, 0))")
    counts = postings.groupBy("pair").agg(F.sum(held).alias("n_docs"), F.sum(times).alias("n_links"))
    counts = stored(counts.withColumn("a", F.expr("shiftright(pair, 16)")), "pairs")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # at most a row per id of the vocabulary
    pairs = counts.join(F.broadcast(most), "a").withColumn("best", F.col("n_docs") == F.col("most"))
    worth = lookup_join(postings, stored(pairs.select("pair", "n_docs", "best"), "worth"), "pair")
    documents = cut.where("slot IS NOT NULL").select("block", "slot", *[f.split()[0] for f in _DOCUMENT.split(", ")])
    worth = worth.select(F.col("block").alias("of_block"), "plane", "n", "bits", "n_docs", "best")
    scored = documents.groupBy("block").cogroup(worth.groupBy("of_block")).applyInPandas(_scored, f"{_DOCUMENT}, n_best long, count_sum long")
    pairs = pairs.select("a", F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("b"), "n_docs", "n_links", "best")
    return scored, pairs
