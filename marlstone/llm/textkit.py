"""Vectorised text primitives: Arrow string columns as flat byte arrays.

A column is taken in chunks of about ``CHUNK_BYTES`` (one longer text is a
chunk of its own), so memory follows the chunk and not the batch. Words and
character n-grams are hashed with a polynomial over the flat bytes whose prefix
sums give the hash of any span in O(1); multiplication by the inverse power of
the base makes it independent of the position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1


def delimiters(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: True for the bytes in the inclusive ranges."""
    t = np.zeros(256, bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


#: Words are runs of anything but space and \x09-\x0D.
BLANKS = delimiters((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of 0-9, a-z and all beyond ASCII, after lower-casing A-Z.
NOT_ALNUM = delimiters((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & M64, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def power_tables(cache: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n of each; cache keeps them."""
    if cache.get("n", 0) < n:
        size = max(n, 2 * cache.get("n", 0), 1024)
        cache.update(n=size, pow=powers(size, BASE), inv=powers(size, pow(BASE, -1, 1 << 64)))
    return cache["pow"], cache["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(column, limit: int = CHUNK_BYTES, most_rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of about limit bytes each."""
    raw, at = flat(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = min(lo + most_rows, max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a chunk: start and end byte, text index; hash() gives 64 bits a word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, blank: np.ndarray, lower: bool):
        self.data, self.at, self.n_texts = (LOWER[data] if lower else data), at, len(at) - 1
        inside = ~blank[self.data]
        cuts = at[(at > 0) & (at < len(data))]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[cuts] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.counts = np.bincount(self.text, minlength=self.n_texts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def hash(self, cache: dict) -> np.ndarray:
        return span_hash(self.data, self.start, self.end, cache)

    def of(self, i: int) -> list[bytes]:
        lo, hi = self.first[i], self.first[i + 1]
        raw = self.data[self.at[i] : self.at[i + 1]].tobytes()
        return [raw[s:e] for s, e in zip((self.start[lo:hi] - self.at[i]).tolist(), (self.end[lo:hi] - self.at[i]).tolist(), strict=True)]


def prefix(data: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial, and the inverse powers."""
    up, down = power_tables(cache, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, cache: dict) -> np.ndarray:
    sums, down = prefix(data, cache)
    return mix((sums[end] - sums[start]) * down[start])


def windows(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and the index of each one's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(h) - n + 1
    out = np.zeros(last, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + h[k : k + last]
    at = np.flatnonzero(text[:last] == text[n - 1 :])
    return mix(out[at]), at


def one_hash(word: str | bytes) -> int:
    """What Words.hash gives for one word."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(span_hash(raw, np.array([0]), np.array([len(raw)]), {})[0])
