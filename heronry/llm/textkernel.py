"""Vectorised word, shingle and byte hashing over Arrow text columns.

All arithmetic is modulo 2**64. Prefix polynomial hashes give the hash of any byte range
in two lookups: range(a, b) = (H[b] - H[a]) * BASE**-a.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes that one pass over a batch holds at once; the arrays of a pass take some 60 times that.
PASS_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = b" \t\n\x0b\x0c\r"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[list(SPACES)] = 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def trimmed() -> None:
    """Gives free memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def thrifty(f: Callable) -> Callable:
    """f, of one or two arguments as Spark tells them apart; what it took is given back behind each call."""

    def one(x):
        try:
            return f(x)
        finally:
            trimmed()

    def two(x, y):
        try:
            return f(x, y)
        finally:
            trimmed()

    return one if len(inspect.signature(f).parameters) == 1 else two


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix1(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for key, b in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data))[0], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), with its length mixed in."""
    down = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, a few at a time."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of about limit bytes; a longer document is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, word starts, word ends, document of each word). A word is a run of bytes other
    than space and 0x09-0x0D; A-Z count as a-z; words don't cross documents."""
    folded = FOLD[data]
    inside = folded != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts_at, ends_at = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[starts_at] = inside[starts_at]
    last[ends_at] = inside[ends_at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return folded, begin, end, np.searchsorted(offsets, begin, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, document of each word)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    folded, begin, end, doc = word_spans(data, offsets)
    return range_hashes(prefix_hashes(folded), begin, end), doc


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; the order counts."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(m, n, np.uint64)
    for j in range(n):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + words[j : j + m])
    return acc


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; a document of fewer words
    has its whole sequence as one; without words the set is empty."""
    n = len(offsets) - 1
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
    for a, b in passes(offsets):
        words, doc = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        bounds = np.searchsorted(doc, np.arange(b - a + 1))
        grams = gram_hashes(words, k)
        for i in range(b - a):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= k:
                out[a + i] = np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                out[a + i] = gram_hashes(words[lo:hi], hi - lo)
    return out
