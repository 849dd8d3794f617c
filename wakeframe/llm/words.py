"""Words of whole Arrow text columns as arrays: 64-bit hashes and byte places, without a Python loop over words.

A word is a maximal run of word bytes. Its hash is ``sum T[b_j] * P^j`` modulo 2^64, read off a prefix
sum over the text bytes, then mixed; T is a random table in which A-Z share the entries of a-z, so that
words compare without case. All helpers take documents in blocks of a few megabytes, a longer document
alone, so memory follows the longest document and not the batch.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 2 << 20
HASH_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection, so equal before is equal after)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(_ODD) + U(seed & 0xFFFFFFFFFFFFFFFF))


def per_process(key, make: Callable):
    """One object per Python worker: tasks that reuse the worker share it."""
    store = sys.modules.setdefault("_wakeframe_worker", types.ModuleType("_wakeframe_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def _spaced() -> np.ndarray:
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def _alphanumeric() -> np.ndarray:
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


# Word bytes: all but ASCII white space; or ASCII letters and digits with all of a non-ASCII character.
SPACED = _spaced()
ALPHANUMERIC = _alphanumeric()


def _folded() -> np.ndarray:
    t = stream(7, 256)
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


_TABLE = _folded()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, n of each at least."""

    def make(size):
        steps = [np.full(size, b, U) for b in (_ODD, _INVERSE)]
        for s in steps:
            s[0] = 1
        return tuple(np.cumprod(s, dtype=U) for s in steps)

    if n <= HASH_BYTES + 1:
        return per_process("powers", lambda: make(HASH_BYTES + 1))
    return make(n)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """A hash for each byte range; the ranges ascend and do not overlap. ``table`` gives a byte's value."""
    out, i = np.empty(len(starts), U), 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + HASH_BYTES, "right")))
            part = data[base : ends[j - 1]]
            up, down = _powers(len(part) + 1)
            total = np.zeros(len(part) + 1, U)
            np.cumsum(table[part] * up[: len(part)], out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (total[e] - total[s]) * down[s]
            i = j
        return mix(out)


class Words:
    """Words of consecutive documents: ``hash``, byte ``start`` and ``end``, and ``first`` word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, table: np.ndarray = _TABLE):
        inside = is_word[data]
        n = len(data)
        edges = offsets[(offsets > 0) & (offsets < n)]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edges] = False
        after[edges - 1] = False
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.hash = hashes(data, self.start, self.end, table)
        self.first = np.searchsorted(self.start, offsets)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for blocks of whole documents of about ``limit`` bytes."""
    data, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def shingles(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each document, in order, and the first of each document.

    A document of fewer words, but not none, has its whole sequence as one shingle.
    """
    lengths = np.diff(first)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(at[-1], U)
    with np.errstate(over="ignore"):
        n = len(word)
        rolled = np.zeros(max(0, n - width + 1), U)
        base = U(_INVERSE)
        for k in range(width):
            rolled = rolled * base + word[k : k + len(rolled)]
        full = np.repeat(lengths >= width, counts)
        place = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], counts)
        out[full] = rolled[place[full]]
        for d in np.flatnonzero((lengths > 0) & (lengths < width)):
            value = U(lengths[d])
            for x in word[first[d] : first[d + 1]]:
                value = value * base + x
            out[at[d]] = value
        return mix(out), at
