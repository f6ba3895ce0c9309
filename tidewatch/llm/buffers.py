"""Words in the bytes of an Arrow column: their places, their hashes, and proof that two of them are equal."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: The five ASCII separators and the blank; all other bytes belong to words.
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes that are worked on at a time; longer words are hashed by themselves.
BLOCK = 1 << 15
BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser, on unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    both = (np.full(n, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(x[1:])]) for x in both)


def joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): an Arrow array's texts, each followed by a line feed, and where each one's line feed ends; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    data = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "\n")[0].as_buffer() if len(texts) else b""
    data = np.concatenate([np.frombuffer(data, np.uint8), np.full(min(1, len(texts)), 10, np.uint8)])
    return data, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word."""
    edges = np.flatnonzero(np.diff(BLANK[data], prepend=True, append=True))
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial in BASE from prefix sums over the bytes of a block."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    up, down = powers(2 * BLOCK)
    cuts = np.searchsorted(starts, np.arange(starts[0] // BLOCK, starts[-1] // BLOCK + 2) * BLOCK)
    sizes = ends - starts
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        if sizes[b - 1] > BLOCK:  # only a block's last word can be that long
            b -= 1
            out[b] = int.from_bytes(hashlib.blake2b(data[starts[b] : ends[b]].tobytes(), digest_size=8).digest(), "little")
        if a < b:
            low = starts[a]
            block = data[low : ends[b - 1]]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[block] * up[: len(block)])])
            first, last = starts[a:b] - low, ends[a:b] - low
            out[a:b] = mix((sums[last] - sums[first]) * down[first] + sizes[a:b].astype(np.uint64))
    return out


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of those pairs whose `sizes` bytes from a and from b aren't the same."""
    out = []
    before = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(before, before[at] + 8 * BLOCK, "right")) - 1)
        if end == at + 1:
            x, y = (data[p[at] : p[at] + sizes[at]] for p in (a, b))
            out.append(np.full(int(not np.array_equal(x, y)), at))
        else:
            n, from_ = sizes[at:end], before[at:end] - before[at]
            place = np.arange(before[end] - before[at])
            odd = np.flatnonzero(data[place + np.repeat(a[at:end] - from_, n)] != data[place + np.repeat(b[at:end] - from_, n)])
            out.append(at + np.searchsorted(before[at + 1 : end + 1] - before[at], np.unique(odd), "right"))
        at = end
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
