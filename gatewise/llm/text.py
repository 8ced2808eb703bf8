"""Texts of an Arrow batch as flat NumPy arrays: blocks, words, hashes of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK = 2 << 20

#: Odd multipliers of the two range hashes (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Block:
    """``data[offsets[i]:offsets[i + 1]]`` is the UTF-8 text of row ``start + i`` of its batch."""

    start: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Runs of rows with at most ``limit`` bytes, or one longer row. Null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _grown(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            all_x = np.full(max(n, BLOCK + 1024), x, np.uint64)
            all_x[0] = 1
            both.append(np.cumprod(all_x, dtype=np.uint64))
        _powers[base] = tuple(both)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (finalizer with fixed multipliers); a copy."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Hashes:
    """64-bit hashes of ranges of ``values`` in constant time each."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        self.up, self.down = _grown(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal ranges have equal hashes wherever they lie."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs outside ``[\\x20\\x09-\\x0D]``), and the index of the first word of each row."""
    data = block.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(block) + 1, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[block.offsets[:-1]] = True
    first[len(data)] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    inside = np.append(inside, False)
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return starts, ends, np.searchsorted(starts, block.offsets)


def rows_of(firsts: np.ndarray) -> np.ndarray:
    """Row of each item, given the index of the first item of each row."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def runs(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions ``firsts[i] .. firsts[i] + counts[i] - 1`` of all i, one after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - firsts, counts)


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each row, A-Z lower-cased, in ascending order within the row.

    The second array tells where each row begins. A row with fewer words is one shingle, without words none.
    """
    data = lower(block.data)
    starts, ends, firsts = words(Block(block.start, data, block.offsets))
    of_range = Hashes(Hashes(data)(starts, ends))
    n_words = np.diff(firsts)
    n = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    begins = np.concatenate([[0], np.cumsum(n)])
    at = runs(firsts[:-1], n)
    hashes = of_range(at, np.minimum(at + size, np.repeat(firsts[1:], n)))
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    return hashes, begins


def distinct(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted values of each row, where each row begins, and how often each value occurs."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begins[:-1][np.diff(begins) > 0]] = True
    at = np.flatnonzero(new)
    return hashes[at], np.concatenate([[0], np.cumsum(new)])[begins], np.diff(np.append(at, len(hashes)))
