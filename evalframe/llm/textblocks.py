"""Vectorised helpers over Arrow string columns, shared by the text operators.

A block is a run of whole texts in one contiguous byte buffer. All work is
numpy over the buffer, so a task holds one block (a few MB, or one very long
text) at a time whatever the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LUT = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


class Block:
    """Whole texts as bytes: ``data``, with text i at ``start[i]:end[i]``; ``rows`` are their rows in the batch."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, rows: slice):
        self.data, self.start, self.end, self.rows = data, start, end, rows

    def __len__(self) -> int:
        return len(self.start)

    def total(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a mask (or of counts) per text."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.end] - c[self.start]

    def prefix_hash(self) -> np.ndarray:
        up, _ = powers(len(self.data))
        s = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_LUT[self.data] * up[: len(self.data)], out=s[1:])
        return s

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each run without white space, and the text that it belongs to."""
        if not len(self.data):
            z = np.zeros(0, np.int64)
            return z, z, z
        solid = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.start] = True
        edge[self.end] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid
        last[:-1] &= ~solid[1:] | edge[1:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        return a, b, np.searchsorted(self.end, a, side="right")


def span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes wherever they stand in the block."""
    _, down = powers(len(prefix))
    return mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield Block(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i], slice(i, j))
        i = j


def windows(owner: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices at which a window of k words of one text starts, and the window's hash."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = h * _BASE + hashes[at + j]
    return at, mix(h)


def repeated(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with an owner: whether its hash is found again in that owner, and whether it is a later find."""
    key = mix(hashes + mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    again, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    again[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return again, later
