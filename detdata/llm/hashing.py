"""Vectorised word and shingle hashes over Arrow text columns.

Everything here works on one Arrow batch inside a task, in slices of a few MB, so memory stays
bounded whatever the batch holds. Hashes are 64 bits wide.
"""

import numpy as np
import pyarrow as pa

SLICE = 1 << 17  # bytes of text hashed at once: the arrays stay in cache

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(SLICE * 2, _STEP, dtype=np.uint64))])
_INVERSES = np.concatenate([[np.uint64(1)], np.cumprod(np.full(SLICE * 2, np.uint64(_inverse(int(_STEP))), dtype=np.uint64))])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of about SLICE bytes, one row at least."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    inside = ~space
    start = inside.copy()
    start[1:] &= space[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= space[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash of each word, A-Z lower-cased if fold."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        at, to = int(starts[i]), int(ends[j - 1])
        if to - at > SLICE * 2:  # one huge word
            part = data[at:to]
            h = np.uint64(0)
            for k in range(0, len(part), SLICE):
                piece = _BYTE[_FOLD[part[k : k + SLICE]] if fold else part[k : k + SLICE]]
                h = mix(np.array([h + np.add.reduce(piece * _POWERS[: len(piece)])]), k)[0]
            out[i] = h
        else:
            part = data[at:to]
            run = np.empty(to - at + 1, dtype=np.uint64)
            run[0] = 0
            np.cumsum(_BYTE[_FOLD[part] if fold else part] * _POWERS[: to - at], out=run[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((run[e] - run[s]) * _INVERSES[s] + (e - s).astype(np.uint64) * _PLACE[63])
        i = j
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; of the whole text if it has fewer words."""
    n = len(hashes)
    if not n:
        return hashes
    if n < k:
        return mix(np.array([np.add.reduce(hashes * _PLACE[:n])], dtype=np.uint64), n)
    total = hashes[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        total = total + hashes[j : n - k + 1 + j] * _PLACE[j]
    return mix(total, k)


def texts(column: pa.Array):
    """For each row, in order: its index and the hashes of its words."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = word_bounds(part, at)
        hashes = word_hashes(part, starts, ends)
        first = np.searchsorted(starts, at)
        for row in range(j - i):
            yield i + row, hashes[first[row] : first[row + 1]]


def distinct(values: np.ndarray) -> np.ndarray:
    s = np.sort(values)
    if len(s) < 2:
        return s
    keep = np.empty(len(s), dtype=bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]
