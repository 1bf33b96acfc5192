"""Vectorised word and shingle hashing over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, or outside another
table of separators. Work is done on the
UTF-8 buffer with numpy, whole documents at a time, so cost is a few
nanoseconds a byte and memory is bounded by ``CHUNK`` or the longest text.
Hashes are 64 bits wide and depend only on the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK = 2_000_000
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift-multiply)."""
    x = x.astype(U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def _byte_table(fold: bool) -> np.ndarray:
    table = mix((np.arange(256, dtype=U) + U(1)) * U(_BASE))
    if fold:
        table[65:91] = table[97:123]
    return table




def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the ASCII bytes that words don't hold."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


_SEP = separators((0x20, 0x20), (0x09, 0x0D))
#: All ASCII but digits and letters; all ASCII but letters. Other characters belong to words.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
NOT_ALPHA = separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_TABLES = {fold: _byte_table(fold) for fold in (False, True)}
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1024)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(m, base, dtype=U)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=U)
    return _POWERS["up"][:n], _POWERS["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    cut = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[cut[0] : cut[-1]], cut - cut[0]


class Words:
    """Words of consecutive rows: byte bounds, row number and hash of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, fold: bool, sep: np.ndarray = _SEP):
        self.raw, self.offsets, self.rows, self.fold, self.sep = raw, offsets, len(offsets) - 1, fold, sep
        solid = ~sep[raw] if len(raw) else np.zeros(0, bool)
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(len(raw), dtype=bool)
        before[1:] = ~solid[:-1]
        after = np.ones(len(raw), dtype=bool)
        after[:-1] = ~solid[1:]
        self.start = np.flatnonzero(solid & (before | edge[:-1]))
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        first = np.searchsorted(self.start, offsets)
        self.first, self.count = first[:-1], np.diff(first)
        self.row = np.repeat(np.arange(self.rows), self.count)

    @cached_property
    def hash(self) -> np.ndarray:
        raw = self.raw
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=U)
        with np.errstate(over="ignore"):
            np.cumsum(_TABLES[self.fold][raw] * up[: len(raw)], out=total[1:])
            own = (total[self.end] - total[self.start]) * down[self.start]
            return mix(own + (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93))

    def strings(self) -> pa.Array:
        """The words themselves, folded if the hashes are."""
        letters = np.arange(256, dtype=np.uint8)
        if self.fold:
            letters[65:91] += 32
        body = letters[self.raw[~self.sep[self.raw]]]
        offsets = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        return pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(offsets), pa.py_buffer(body))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n words in one row, and the index of its first word."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        acc = np.full(len(at), n, dtype=U)
        with np.errstate(over="ignore"):
            for j in range(n):
                acc = acc * U(0xC2B2AE3D27D4EB4F) + self.hash[at + j]
        return mix(acc), at

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of each n-word shingle; a shorter row's whole sequence is its one shingle."""
        value, at = self.grams(n)
        row = self.row[at]
        parts_row, parts = [row], [value]
        for short in range(1, n):
            which = np.flatnonzero(self.count == short)
            acc = np.full(len(which), short, dtype=U)
            with np.errstate(over="ignore"):
                for j in range(short):
                    acc = acc * U(0xC2B2AE3D27D4EB4F) + self.hash[self.first[which] + j]
            parts_row.append(which)
            parts.append(mix(acc))
        return np.concatenate(parts_row), np.concatenate(parts)


def chunks(texts: pa.Array, fold: bool = True, sep: np.ndarray = _SEP, size: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, row past the last, words) of runs of rows of about ``size`` bytes."""
    raw, offsets = buffers(texts)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(rows, max(hi, lo + 1))
        yield lo, hi, Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], fold, sep)
        lo = hi


def sets(words: Words, n: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then rank of the hash's bucket, then hash."""
    row, value = words.shingles(n)
    if rank is None:
        order = np.lexsort((value, row))
    else:
        order = np.lexsort((value, rank[(value & U(len(rank) - 1)).astype(np.int64)], row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
