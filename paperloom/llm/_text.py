"""Whole-text word arithmetic in numpy, shared by the operators of this subpackage.

Texts arrive as Arrow string columns. Everything here works on the UTF-8 bytes of a run of
documents at once ("a block"), so the cost of a word is a few vector operations. Blocks are
bounded in bytes, except that one document is never divided.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 19
#: Bytes from which a word's value is its XXH64: sums of powers modulo 2**64 agree for some regular strings of a thousand letters.
LONG_WORD = 128

_U = np.uint64
_BASE_BYTE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_WORD = _U(0xD1342543DE82EF95 | 1)


def _inverse(odd: np.uint64) -> np.uint64:
    return _U(pow(int(odd), -1, 1 << 64))


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                one = np.full(size, self.base, _U)
                one[0] = 1
                back = np.full(size, _inverse(self.base), _U)
                back[0] = 1
                self.up, self.down = np.cumprod(one, dtype=_U), np.cumprod(back, dtype=_U)
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BASE_BYTE), _Powers(_BASE_WORD)
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: bytes of a word [^\x20\x09-\x0D]+
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, the other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES):
    """(first document, last document + 1, bytes, offsets) of blocks of about size bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a block, and the n + 1 word offsets of its documents."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value of each word's bytes, the same wherever the word stands."""
    up, down = _byte_powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUE[data] * up[:-1], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts])
    for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The block's words with single bytes between them (spaces, inside a document), and their bounds there."""
    inside = is_word[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # and the byte after each word
    place = np.cumsum(keep) - 1
    out = np.where(inside, data, np.uint8(0x20))[keep].tobytes()
    return out, place[starts], place[ends - 1] + 1


class SpanHash:
    """64-bit values of spans of some dozens of words, from the words' values."""

    def __init__(self, words: np.ndarray) -> None:
        up, self.down = _word_powers.get(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, _U)
        np.cumsum(words * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width], for every i that has as many."""
    n, span = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    low = values
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span : width - span + n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each of several ranges, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


def string_column(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string column of byte spans that follow one another without gaps."""
    offsets = np.append(starts, ends[-1] if len(ends) else 0).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
