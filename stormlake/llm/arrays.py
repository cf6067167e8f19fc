"""Tables of sorted 64-bit hashes with values, one file for each range, mapped into memory by workers.

A file holds sorted hashes in cells: a cell's number is a hash's first bits and isn't stored, the 32 bits after them
are. Values take a byte each: a value under 255, or for rows of values the number of one of the range's 255 most frequent
rows; all others stand beside with their places. Hashes must be spread evenly. Two
hashes of a range that agree in cell and 32 bits are one; with some four hashes to a cell, a hash that isn't there is taken
for one that is with probability 1e-9.

The folder must be a mounted part of the shared one. A file is written under another name and then renamed, so a
task that runs twice leaves the same file. Every range has a file; a missing one is an error, never an empty range.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from typing import NamedTuple

import numpy as np

_U = np.uint64
#: Hashes of a cell, about; files that a worker holds open for one table, at most.
CELL, MOST_OPEN = 4, 4096


def range_of(top: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash: equal shares of its upper half."""
    return (((top >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)


def least_type(values: np.ndarray) -> np.ndarray:
    """The same values in the least unsigned type that holds them."""
    top = int(values.max()) if values.size else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _write(path: str, arrays: list[np.ndarray]) -> None:
    """Lengths and item sizes, then the arrays, each from a multiple of eight bytes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.size, a.itemsize))], np.uint64)
    held = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
    with open(held, "wb") as out:
        out.write(head.tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(bytes(-a.nbytes % 8))
    os.replace(held, path)


def _read(path: str) -> list[np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    head = raw[: 8 * (1 + 2 * int(raw[:8].view(np.uint64)[0]))].view(np.uint64)
    at, out = head.nbytes, []
    for size, width in head[1:].astype(np.int64).reshape(-1, 2):
        out.append(raw[at : at + size * width].view(f"u{width}"))
        at += size * width + -(size * width) % 8
    return out


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each row, the rows of the codes); 255 for rows that have none. Rows hold up to four values."""
    width = values.shape[1]
    small = np.flatnonzero(values.max(axis=1, initial=0) < 1 << 16)
    place = (np.arange(width) * 16).astype(np.uint64)
    often, of, count = np.unique((values[small].astype(np.uint64) << place).sum(axis=1, dtype=np.uint64), return_inverse=True, return_counts=True)
    top = np.argsort(-count, kind="stable")[:255]
    number = np.full(len(often), 255, np.uint8)
    number[top] = np.arange(len(top))
    code = np.full(len(values), 255, np.uint8)
    code[small] = number[of]
    return code, (often[top][:, None] >> place) & _U(0xFFFF)


def save(folder: str, part: int, key: np.ndarray, values: np.ndarray, ids: np.ndarray | None = None) -> None:
    """Write a range: sorted distinct hashes, a value or a row of values of each, and ids of any size."""
    os.makedirs(folder, exist_ok=True)
    bits = max(1, (len(key) // CELL).bit_length())
    cells = np.searchsorted(key >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    low = ((key << _U(bits)) >> _U(32)).astype(np.uint32)
    none = np.zeros(0, np.uint64)
    code, rows = _coded(values) if values.ndim > 1 else (np.minimum(values, 255).astype(np.uint8), none)
    at = np.flatnonzero(code == 255)
    _write(f"{folder}/{part}", [least_type(cells), low, code, rows.astype(np.uint64).reshape(-1), at.astype(np.uint64), values[at].astype(np.uint64).reshape(-1), least_type(ids if ids is not None else none)])


class Part(NamedTuple):
    cells: np.ndarray
    low: np.ndarray
    code: np.ndarray
    rows: np.ndarray
    more_at: np.ndarray
    more: np.ndarray
    ids: np.ndarray

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it isn't there."""
        n = len(self.low)
        if not n:
            return np.full(len(keys), -1)
        bits = (len(self.cells) - 1).bit_length() - 1
        cell = (keys >> _U(64 - bits)).astype(np.int64)
        want = ((keys << _U(bits)) >> _U(32)).astype(np.uint32)
        lo, end = self.cells[cell].astype(np.int64), self.cells[cell + 1].astype(np.int64)
        hi = end.copy()
        for _ in range(int((end - lo).max()).bit_length()):
            mid = (lo + hi) >> 1
            less = (self.low[np.minimum(mid, n - 1)] < want) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        return np.where((lo < end) & (self.low[np.minimum(lo, n - 1)] == want), lo, -1)

    def value(self, at: np.ndarray, width: int) -> np.ndarray:
        code = self.code[at]
        if width == 1:
            out = code.astype(np.int64)
        else:
            rows = np.append(self.rows, np.zeros(width, np.uint64)).reshape(-1, width).astype(np.int64)
            out = rows[np.minimum(code, len(rows) - 1)]
        often = np.flatnonzero(code == 255)
        if len(often):
            found = np.searchsorted(self.more_at, at[often].astype(np.uint64))
            out[often] = self.more[found] if width == 1 else self.more.reshape(-1, width)[found]
        return out


class Sorted:
    """A table opened for look-ups."""

    def __init__(self, folder: str, width: int = 1):
        self.folder, self.width = folder, width
        self.parts: OrderedDict[int, Part] = OrderedDict()

    def part(self, number: int) -> Part:
        if number in self.parts:
            self.parts.move_to_end(number)
        else:
            self.parts[number] = Part(*_read(f"{self.folder}/{number}"))
            if len(self.parts) > MOST_OPEN:
                self.parts.popitem(last=False)
        return self.parts[number]

    def find(self, part: np.ndarray, keys: np.ndarray, ids: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(values, ids) of hashes in given ranges: 0 and ``ids`` for those that aren't there. Values have a row for each hash
        if the table has several; ids are empty unless a default is given."""
        out = np.zeros((len(keys), self.width) if self.width > 1 else len(keys), np.int64)
        names = np.full(len(keys) if ids is not None else 0, ids or 0, np.uint64)
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        starts = np.flatnonzero(np.diff(ranked, prepend=-1))
        for i, j in zip(starts, np.append(starts, len(ranked))[1:], strict=True):
            held = self.part(int(ranked[i]))
            at = held.place(keys[order[i:j]])
            hit = at >= 0
            rows, at = order[i:j][hit], at[hit]
            out[rows] = held.value(at, self.width)
            if ids is not None:
                names[rows] = held.ids[at]
        return out, names
