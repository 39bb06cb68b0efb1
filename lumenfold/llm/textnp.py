"""Byte and word arithmetic on batches of texts, in numpy: words, window hashes and packed positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer text stands alone.
CHUNK = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Ranges of more bytes than this are digested by BLAKE2b instead of eight bytes a step.
LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit number for each byte value, by seed."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _STEP + np.uint64(seed * 2 + 1))


def range_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the bytes start to end - 1 of each range, equal for equal bytes wherever they lie.

    Both are chained over eight bytes a step by a bijection that is not linear, so that no words collide by
    structure as they do in sums of powers modulo 2**64; together they are 128 bits."""
    n = end - start
    a, b = np.full(len(n), _STEP), np.full(len(n), _MIX2)
    load = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))
    live, at = np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(live):
        left = n[live] - at
        x = load[start[live] + at]
        short = left < 8
        x[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        a[live] = mix(a[live] ^ x) + _STEP
        b[live] = mix(b[live] * _MIX1 + x)
        live, at = live[left > 8], at + 8
    a, b = mix(a + n.astype(np.uint64)), mix(b ^ n.astype(np.uint64))
    for i in np.flatnonzero(n > LONG).tolist():
        a[i], b[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
    return a, b


def text_chunks(column: pa.Array):
    """Yields (first row, data, offsets) of a string column: the bytes of some texts and where each starts;
    nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if len(column) else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (runs of anything but the six ASCII spaces, or the bytes that `between` has as true),
    and for each text its first word's number, with the number of words at the end."""
    space = between[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = True
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = True
    starts = np.flatnonzero(~space & before)
    return starts, np.flatnonzero(~space & after) + 1, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def window_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 entries are meaningless."""
    out = np.zeros(len(word_hash), np.uint64)
    for j in range(n):
        ahead = np.zeros_like(word_hash)
        ahead[: len(word_hash) - j] = word_hash[j:]
        out = (out ^ (out >> np.uint64(29))) * _MIX2 + ahead
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each start, lengths[i] numbers each, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return first + np.arange(total)


def cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Boolean array of n: what the ranges cover together."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0
