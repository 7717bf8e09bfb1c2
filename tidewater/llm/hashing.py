"""Words and shingles of Arrow text columns as 64-bit hashes, computed over whole buffers with numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as lower case. No Python string is
made, so a pass over text costs a few numpy operations a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 20  # bytes of text handled at once; a longer text is a slice of its own
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def packed(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): whole texts, about ``most`` bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): word i is data[starts[i]:ends[i]]; text d has words bounds[d] to bounds[d + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[data]
    new = np.zeros(len(data) + 1, bool)  # a text starts here
    new[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | new[1:-1]
    last[:-1] &= ~solid[1:] | new[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTES[FOLD[data] if folded else data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + mix((ends - starts).astype(U)))


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles, sorted; with fewer words the whole sequence is one."""
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        m = min(n, int(b - a))
        if not m:
            yield h[:0]
            continue
        s = np.full(b - a - m + 1, U(m), U)
        for k in range(m):
            s = mix(s * U(0x9FB21C651E98DF25) + h[a + k : b - m + 1 + k])
        yield np.unique(s)
