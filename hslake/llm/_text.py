"""Vectorised helpers over the UTF-8 bytes of Arrow text columns: chunks, words, rolling hashes and shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BREAKS = np.zeros(256, bool)
WORD_BREAKS[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_symbols = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SYMBOLS = _symbols
FOLDED = _symbols.copy()
FOLDED[65:91] = _symbols[97:123]

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64), so that low bits are as good as high ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Rows of one Arrow batch whose texts lie next to each other in ``data``; null texts are empty."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers, and what they hold, from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 19) -> Iterator[Chunk]:
    """Split batches into chunks of about ``most`` bytes of text; a longer text stands alone, whole."""
    try:
        yield from _chunks(batches, column, most)
    finally:
        release()


def _chunks(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[Chunk]:
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column(batch.schema.get_field_index(column))
        valid = raw.is_valid().to_numpy(zero_copy_only=False)
        arr = pc.fill_null(raw.cast(pa.large_binary()), b"")
        _, at, body = arr.buffers()
        offsets = np.frombuffer(at, np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield Chunk(batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], valid[i:j])
            i = j


def prefix_hash(data: np.ndarray, table: np.ndarray = SYMBOLS) -> np.ndarray:
    """Sums of symbol times power; ``span_hash`` takes the hash of any byte range from them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, alike wherever equal bytes stand."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WORD_BREAKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes that aren't ``breaks``; none crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(chunk: Chunk, fold: bool = True, breaks: np.ndarray = WORD_BREAKS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word; ``fold`` reads A-Z as a-z."""
    starts, ends, rows = words(chunk.data, chunk.offsets, breaks)
    return span_hash(prefix_hash(chunk.data, FOLDED if fold else SYMBOLS), starts, ends), rows


def ngram_hashes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` words within a row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc = mixed(acc + np.uint64(k + 1)) + hashes[k : k + m]
    whole = rows[:m] == rows[n - 1 :]
    return mixed(acc[whole]), rows[:m][whole]


def shingle_sets(chunk: Chunk, n: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct ``n``-word shingle hashes; fewer words make one shingle, no word none."""
    hashes, rows = word_hashes(chunk)
    grams, owner = ngram_hashes(hashes, rows, n)
    cuts = np.searchsorted(owner, np.arange(len(chunk) + 1))
    at = np.searchsorted(rows, np.arange(len(chunk) + 1))
    for i in range(len(chunk)):
        k = at[i + 1] - at[i]
        if k >= n:
            s = np.sort(grams[cuts[i] : cuts[i + 1]])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif k:
            yield ngram_hashes(hashes[at[i] : at[i + 1]] + np.uint64(k), np.zeros(k, np.int64), k)[0]
        else:
            yield np.zeros(0, np.uint64)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
