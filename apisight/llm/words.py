"""Words, lines and shingles of Arrow text columns as numpy arrays, for use inside Spark tasks.

A text's bytes are UTF-8; white space (0x20, 0x09-0x0D) and the letters A-Z are single bytes there, so words can be cut and lower-cased
without decoding. Hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text, and texts, that are worked on at once; a longer text is taken alone.
CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 1 << 14

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(20250701).integers(1 << 32, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base or its inverse, modulo 2 ** 64."""
    had = _powers.get(kind)
    if had is None or len(had) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), _BASE if kind == "base" else _INVERSE, np.uint64)
        out[0] = 1
        had = _powers[kind] = np.multiply.accumulate(out)
    return had[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Chunk:
    """Some whole texts: data (bytes), offsets (of len(texts) + 1), first (the first text's place in its batch)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def spans(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that are no breaks; a run ends with its text."""
        inside = ~breaks
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1]))
        starts = np.flatnonzero(inside & (edge[:-1] | ~before))
        after = np.concatenate((inside[1:], [False]))
        ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(_IS_SPACE[self.data])

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """The text that each position lies in."""
        return np.searchsorted(self.offsets, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Of each span's bytes."""
        n = len(self.data)
        codes = _CODE[_LOWER[self.data] if lower else self.data] * _power("base", n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes, dtype=np.uint64)))
        h = (sums[ends] - sums[starts]) * _power("inverse", n + 1)[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def runs(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and the place of each one's first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    out = np.full(len(at), k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + h[at + i])
    return out, at


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """The texts of a string column in order; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, len(column), at + CHUNK_TEXTS)
        yield Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def shingles(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), sorted and distinct, of each text's k-word shingles, A-Z lower-cased; a text of fewer words has its whole sequence as one."""
    starts, ends = chunk.words()
    owner = chunk.owner(starts)
    h = chunk.hashes(starts, ends, lower=True)
    found, at = runs(h, owner, k)
    own = owner[at] if len(at) else np.zeros(0, np.int64)
    count = np.bincount(owner, minlength=chunk.n) if len(owner) else np.zeros(chunk.n, np.int64)
    for size in range(1, k):  # texts of so many words
        short, first = runs(h, owner, size)
        if len(short):
            whole = count[owner[first]] == size
            found, own = np.concatenate((found, short[whole])), np.concatenate((own, owner[first][whole]))
    order = np.lexsort((found, own))
    found, own = found[order], own[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
    return own[new], found[new]
