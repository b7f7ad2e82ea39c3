"""Words of UTF-8 text as numpy arrays: boundaries and 64-bit hashes without a Python object per word.

A word is a maximal run of bytes of a class. All bytes from 0x80 up belong to every class used here, so a run
never cuts a character. Hashes mix eight bytes at a time; two equal words always have equal hashes.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa


def by_value(name: str) -> None:
    """Ship the functions of a module inside the tasks that use them, so that executors need no copy of this package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[name])


def restored(kind: type, state: dict):
    """The object of a state, vars(object). A broadcast names classes by their module, so what is sent is the state, of arrays and lists."""
    out = object.__new__(kind)
    vars(out).update(state)
    return out


by_value(__name__)


def byte_class(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: After LOWER: digits, a-z and everything outside ASCII.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: After LOWER: a-z and everything outside ASCII.
ALPHA = byte_class(lambda b: 97 <= b <= 122 or b >= 128)
#: Anything but space, tab, newline, vertical tab, form feed and carriage return.
NONSPACE = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))

_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3, a bijection of 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(column: pa.Array, most: int):
    """(first row, buffer, offsets) of runs of rows with about `most` bytes; a longer single text comes alone. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def classes(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[buf], by the much faster translation of bytes."""
    return np.frombuffer(buf.tobytes().translate(table.astype(np.uint8).tobytes()), np.uint8)


def boundaries(buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in buf, and the index of each text's first word (one more than there are texts)."""
    inside = classes(buf, keep).view(bool)
    edge = np.zeros(len(buf) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    if len(buf):
        edge[0], edge[-1] = inside[0], inside[-1]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(buf))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # a word that ends one text, right before a word that begins the next
    marks = np.flatnonzero(edge)
    if len(cuts):
        marks = np.sort(np.concatenate([marks, cuts, cuts]))
    starts, ends = marks[0::2], marks[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(np.uint64) + np.uint64(seed * 2 + 1))
    at, rows = starts, None
    while True:
        part = words[at] & _MASK[np.minimum(left, 8)]
        if rows is None:
            h = mix(h ^ part)
        else:
            h[rows] = mix(h[rows] ^ part)
        more = left > 8
        if not more.any():
            return h
        rows = np.flatnonzero(more) if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `size` numbers, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or int(starts.max()) + total < 2**31) else np.int64
    out = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def first_use(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct hash, and for each hash the number of its distinct one."""
    codes, distinct = pd.factorize(h)
    at = np.empty(len(distinct), np.int64)
    at[codes] = np.arange(len(h))
    return at, codes


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
