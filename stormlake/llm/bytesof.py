"""Words and shingles of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word's hash is a difference of prefix sums over powers of an odd number (modulo 2**64), so no Python
object is made for a word; a finaliser then spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about so many bytes; a longer text makes a group of its own.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _values() -> np.ndarray:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


VALUES = _values()
SPACE = [0x20, *range(0x09, 0x0E)]


def space_table() -> np.ndarray:
    """Words are runs of all bytes but the six separators."""
    table = VALUES.copy()
    table[SPACE] = 0
    return table


def lower_table() -> np.ndarray:
    """As space_table, with A-Z taken as a-z."""
    table = space_table()
    table[65:91] = table[97:123]
    return table


def letter_table() -> np.ndarray:
    """Words are runs of ASCII letters, digits and bytes from 0x80, A-Z taken as a-z; the rest separates."""
    table = np.zeros(256, np.uint64)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        table[a:b] = VALUES[a:b]
    table[65:91] = table[97:123]
    return table


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a new array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Words(NamedTuple):
    """starts, ends: byte places; doc: index of each word's text; hash: of each word; prefixes: for each asked
    length a hash of the word's first bytes, 0 for words that aren't longer."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    prefixes: tuple[np.ndarray, ...] = ()


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) for groups of rows; nulls count as empty texts."""
    row = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(part):
            continue
        part = part.fill_null("") if part.null_count else part
        wide = pa.types.is_large_string(part.type) or pa.types.is_large_binary(part.type)
        offsets = np.frombuffer(part.buffers()[1], np.int64 if wide else np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        body = part.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(part):
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), len(part))
            yield row + lo, row + hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
        row += len(part)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """The words of all texts of a group. table: a value for each byte, 0 for those that separate."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), (np.zeros(0, np.uint64),) * len(prefixes))
    value = table[data]
    inside = value != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    value *= up[:n]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(value, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    heads = []
    for size in prefixes:
        head = (sums[np.minimum(starts + size, n)] - sums[starts]) * down[starts] + _U(size << 32)
        heads.append(np.where(ends - starts > size, mix(head), _U(0)))
    return Words(starts, ends, doc, mix(hashes), tuple(heads))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each window of ``size`` words, in order. A text with fewer words has one of them all, one without words none."""
    n = len(found.doc)
    if not n:
        return found.doc, found.hash
    doc = found.doc
    total = found.hash.copy()
    whole = np.ones(n, bool)
    multiplier = 1
    for step in range(1, size):
        multiplier = multiplier * 0xD6E8FEB86659FD93 % (1 << 64)
        same = np.zeros(n, bool)
        same[: max(0, n - step)] = doc[step:] == doc[: max(0, n - step)]
        part = np.zeros(n, np.uint64)
        part[: max(0, n - step)] = found.hash[step:]
        part *= _U(multiplier)
        total += np.where(same, part, _U(0))
        whole = same
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    counts = np.bincount(doc)[doc]
    keep = whole if size > 1 else np.ones(n, bool)
    keep = keep | (first & (counts < size))
    return doc[keep], mix(total[keep])
