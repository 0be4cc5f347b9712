"""Words and word hashes of whole texts, a block of Arrow bytes at a time.

Texts arrive as Arrow batches. A block is a run of documents of at most ``limit`` bytes (a longer document
is a block of its own, never cut). All work inside a block is on numpy arrays over its UTF-8 bytes, so no
Python string is made per word, and memory is a fixed multiple of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def separators(codes: list[int]) -> np.ndarray:
    """True for bytes that belong to words, given the separating ASCII codes."""
    word = np.ones(256, dtype=bool)
    word[codes] = False
    return word


#: Words are runs of anything but space and \\t..\\r
SPACED = separators([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and anything outside ASCII
ALNUM = separators([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
ALNUM[0x41:0x5B] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32  # A-Z read as a-z
_BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * _ODD) | np.uint64(1)
_FOLDED_BYTE = _BYTE[_FOLD]


class _Powers:
    """Powers of the base and of its inverse, extended as needed up to one block."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        up = np.full(n, _BASE, dtype=np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 4 * LIMIT:
            self.up, self.down = up, down
        return up, down


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of hashes, and of its inverse."""
    return _POWERS.of(n)


@dataclass
class Block:
    """Documents ``first`` to ``last`` of a batch. ``at``: byte offsets of documents inside ``data``."""

    first: int
    last: int
    data: np.ndarray
    at: np.ndarray

    @property
    def n(self) -> int:
        return self.last - self.first


@dataclass
class Words:
    """Words of a block in order; those of document d are ``doc[d]`` to ``doc[d + 1]``."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets.astype(np.int64)


def blocks(column: pa.Array, limit: int = LIMIT) -> Iterator[Block]:
    data, at = raw(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield Block(first, last, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def words(block: Block, word: np.ndarray) -> Words:
    """Maximal runs of word bytes that don't leave their document."""
    return runs(block, word[block.data])


def runs(block: Block, inside: np.ndarray) -> Words:
    """Maximal runs of marked bytes that don't leave their document."""
    n = len(inside)
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[block.at[:-1][block.at[:-1] < n]] = False
        after[-1] = False
        after[:-1] = inside[1:]
        after[block.at[1:][block.at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, block.at))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand; fold: A-Z read as a-z."""
    n = len(data)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.of(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED_BYTE if fold else _BYTE)[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start]) | np.uint64(1)


#: Factors of a run's words by place
PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def sequence_hashes(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside a document and the run's first word.

    A document of fewer words, but not none, has its whole sequence as the one run.
    """
    counts = np.diff(doc)
    n = len(hashes)
    if n >= k:
        of = np.repeat(np.arange(len(counts)), counts)
        first = np.flatnonzero(np.arange(n) + k <= doc[1:][of])
        total = hashes[first] * PLACES[0]
        for j in range(1, k):
            total += hashes[first + j] * PLACES[j]
    else:
        first, total = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        head, size = doc[short], counts[short]
        part = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            here = j < size
            part[here] += hashes[head[here] + j] * PLACES[j]
        first, total = np.concatenate([first, head]), np.concatenate([total, part])
        order = np.argsort(first, kind="stable")
        first, total = first[order], total[order]
    return mix(total), first


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each slice ``bounds[d]:bounds[d + 1]``, and the new bounds."""
    parts, sizes = [], np.zeros(len(bounds) - 1, dtype=np.int64)
    for d in range(len(bounds) - 1):
        a, b = bounds[d], bounds[d + 1]
        if b > a:
            x = np.sort(values[a:b])
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
            parts.append(x)
            sizes[d] = len(x)
    out = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), out


def shingle_sets(block: Block, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct hashes of k-word shingles (A-Z lower-cased), and bounds."""
    w = words(block, word)
    hashes = span_hashes(block.data, w.start, w.end, fold=True)
    shingles, first = sequence_hashes(hashes, w.doc, k)
    return distinct_sets(shingles, np.searchsorted(first, w.doc))


def code_points(data: np.ndarray) -> int:
    """Code points in UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def starts_of_code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position, one entry more than bytes."""
    out = np.empty(len(data) + 1, dtype=np.int64)
    out[0] = 0
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
