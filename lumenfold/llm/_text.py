"""Vectorised words and word hashes over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These bytes
never occur inside a longer UTF-8 character, so words can be cut on bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PART = 1 << 19  # bytes of text that are worked on together


def splitmix(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values from a seed."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) + U64(seed * 1000)) * U64(0x9E3779B97F4A7C15)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_GRAM = splitmix(2, 4096) | U64(1)


def string_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offs = np.frombuffer(offs, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PART) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives memory back after each batch, as Python workers live on for other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())

        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                _trim()

        yield from run(each())
        _trim()

    return wrapped


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class Words:
    """Words of several texts: byte ranges start/end, and at[d]:at[d + 1] for text d."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offs[(offs > 0) & (offs < len(data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.data = data
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def codes(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """(the number of each word, the distinct words by number): equal numbers are equal bytes; lower folds A-Z."""
        keep = filled(len(self.data), self.start, self.end)
        packed = self.data[keep]
        if lower:
            packed = _LOWER[packed]
        at = np.append(0, np.cumsum(self.end - self.start))
        words = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary

    def hashes(self, lower: bool = False, lanes: int = 1) -> np.ndarray:
        """64 bits of each word's BLAKE2b digest; with two lanes, two rows of 64 other bits each."""
        number, words = self.codes(lower)
        each = word_hashes(words, lanes)
        return each[number, 0] if lanes == 1 else each[number].T


def word_hashes(words: pa.Array, lanes: int = 1) -> np.ndarray:
    """64 bits of each word's BLAKE2b digest in each lane."""
    data, offs = string_bytes(words)
    raw, at = data.tobytes(), offs.tolist()
    digests = b"".join([blake2b(raw[a:b], digest_size=8 * lanes).digest() for a, b in zip(at, at[1:], strict=False)])
    return np.frombuffer(digests, U64).reshape(-1, lanes)


def light_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each of some words that aren't empty, without a loop; to deal out and to choose, not to tell words apart."""
    data, offs = string_bytes(words)
    if not len(offs) - 1:
        return np.zeros(0, U64)
    size = np.diff(offs)
    place = np.arange(len(data)) - np.repeat(offs[:-1], size)
    factor = _GRAM if size.max() <= len(_GRAM) else splitmix(2, int(size.max())) | U64(1)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat((data.astype(U64) + U64(1)) * factor[place], offs[:-1]))


def filled(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of `size` bytes are in one of the ranges, which don't overlap."""
    edge = np.zeros(size + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values, for each start that has k."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += h[i : i + n] * _GRAM[i]
    return mix(out)


def whole(h: np.ndarray) -> int:
    """A hash of a whole sequence; differs from grams() of the same words by its length."""
    with np.errstate(over="ignore"):
        x = np.array([(h * _GRAM[: len(h)]).sum(dtype=U64) + U64(len(h) * 0x51ED270B)], dtype=U64)
    return mix(x)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n values each, one range behind the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def sequences(code: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """A number from 0 for each of the k codes behind each start: equal numbers are equal codes, not equal hashes."""
    if not len(start):
        return np.zeros(0, np.int64)
    _, first, number = np.unique(grams(mix(code.astype(U64)), k)[start], return_index=True, return_inverse=True)
    if any((code[start + d] != code[start[first[number]] + d]).any() for d in range(k)):  # two sequences with one hash
        _, number = np.unique(np.stack([code[start + d] for d in range(k)], axis=1), axis=0, return_inverse=True)
    return number.reshape(-1)
