"""Word shingles of texts as 64-bit numbers, computed on whole Arrow columns with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SLICE = 1 << 22  # bytes handled at a time, cut at white space: bounds the temporaries, not the text
_BLOCK = 1 << 17  # bytes of short texts numbered together: their temporaries stay in a core's cache
_NO_BYTES, _BLANK = np.zeros(0, np.uint8), np.full(1, 32, np.uint8)
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> np.ndarray:
    return _words_at(data)[0]


def _words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per word of a stretch of bytes, with A-Z lower-cased, and where the words start.

    A word is a polynomial in its bytes, taken from running sums, so its number does not depend
    on where it stands.
    """
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[lower] * _powers(_P, n), dtype=np.uint64, out=sums[1:])
    back = _powers(pow(_P, -1, 1 << 64), n)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)), start


def text_words(data: np.ndarray) -> np.ndarray:
    """Numbers of all words of one text (its bytes)."""
    if len(data) <= _SLICE:
        return _words(data)
    parts, at = [], 0
    while at < len(data):
        to = min(at + _SLICE, len(data))
        while to < len(data) and not (data[to] == 32 or 9 <= data[to] <= 13):
            to += 1
        parts.append(_words(data[at:to]))
        at = to
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words; of fewer words, their whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, k if n < size else 0, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(_P) + words[i : n - k + 1 + i])
    return np.unique(out)


def column_bytes(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each text of an Arrow column, None for null; the data is not copied."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid[i] else None


def set_blocks(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingle sets of the texts of an Arrow column, block by block: the size of each, and all one after the other.

    A set is sorted and distinct; null and wordless texts have an empty one. Short texts are numbered together, as a call of NumPy
    costs more than the work on one of them; a text beyond ``_BLOCK`` bytes is a block of its own.
    """
    for block in _blocks(column):
        if len(block) == 1:
            found = shingle_set(text_words(block[0]), size)
            yield np.array([len(found)]), found
        else:
            yield _block_sets(block, size)


def _blocks(column: pa.Array) -> Iterator[list[np.ndarray]]:
    block, held = [], 0
    for data in column_bytes(column):
        data = _NO_BYTES if data is None else data
        if block and held + len(data) > _BLOCK:
            yield block
            block, held = [], 0
        block.append(data)
        held += len(data)
    if block:
        yield block


def _block_sets(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingle_set` of each text."""
    # A blank after each text ends its last word.
    lens = np.array([len(x) for x in texts])
    first = np.cumsum(lens + 1) - lens - 1
    words, start = _words_at(np.concatenate([x for text in texts for x in (text, _BLANK)]))
    at = np.searchsorted(start, np.append(first, first[-1] + lens[-1] + 1))
    n = np.diff(at)
    out = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(_P) + words[i : i + len(out)])
    # Places where a shingle of one text begins, in the order of the texts.
    sizes = np.maximum(n - size + 1, 0)
    flat = out[np.repeat(at[:-1], sizes) + places(sizes)]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        sets = np.split(flat, np.cumsum(sizes)[:-1])
        for i in short:
            sets[i] = shingle_set(words[at[i] : at[i + 1]], size)
        flat, sizes = np.concatenate(sets), np.where((n > 0) & (n < size), 1, sizes)
    ends = np.cumsum(sizes)
    for i, j in zip((ends - sizes).tolist(), ends.tolist()):
        flat[i:j].sort()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    return segment_sums(new.astype(np.int64), sizes), flat[new]


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … anew for each of the stretches of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each of the stretches of these sizes, modulo 2^64; that of an empty one is 0."""
    sums = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=sums[1:])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]
