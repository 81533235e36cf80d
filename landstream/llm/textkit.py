"""Vectorised text kernels: whole Arrow batches of documents are hashed with numpy, without a Python loop per word.

Hashes are polynomials modulo 2**64 over an odd base, taken from prefix sums, so the hash of any byte range costs O(1).
They are mixed before use, because the low bits of such a polynomial are weak.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that a kernel handles at once; a longer text is handled alone, and whole.
GROUP_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, GROUP_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 * GROUP_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums for range_hash()."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(0x1F)) * powers(BASE, len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the ranges start..end of what prefix_hash() read; ranges of other lengths hash apart."""
    inverse = powers(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def groups(offsets: np.ndarray, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs of documents of about `size` bytes, one document at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word `[^\\x20\\x09-\\x0D]+`, and the number of the document it is in."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[raw]
    edge = np.ones(len(raw), bool)
    edge[1:] = solid[1:] != solid[:-1]
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True  # a word ends where its document ends
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], len(raw))
    keep = solid[at]
    start, end = at[keep], ends[keep]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(offsets: np.ndarray, raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 64-bit hash of each distinct word shingle, sorted by both.

    Letters A-Z are lower-cased. A document with fewer words than `width` has its whole sequence as one shingle;
    one without words has none.
    """
    start, end, doc = words(offsets, raw)
    word = range_hash(prefix_hash(_LOWER[raw]), start, end)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    many = np.maximum(counts - width + 1, np.minimum(counts, 1))
    total = int(many.sum())
    owner = np.repeat(np.arange(len(many)), many)
    begin = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(total)
    value = range_hash(prefix_hash(word), begin, np.minimum(begin + width, (first + counts)[owner]))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(total, bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]


def digest(values: np.ndarray) -> bytes:
    """16 bytes that stand for a sorted set of hashes."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
