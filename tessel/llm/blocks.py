"""Binary blocks of arrays: how tasks hand numbers to one another without a row for each."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def documents(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple]:
    """Rows as tuples, a few converted at a time."""
    for whole in batches:
        for k in range(0, whole.num_rows, size):
            yield from zip(*(c.to_pylist() for c in whole.slice(k, size).columns), strict=True)


def pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<3sq", a.dtype.str.encode(), len(a)) for a in arrays)
    return head + b"".join(a.tobytes() for a in arrays)


def unpack(data: bytes | memoryview) -> list[np.ndarray]:
    out, at = [], 1 + 11 * data[0]
    for k in range(data[0]):
        kind, n = struct.unpack_from("<3sq", data, 1 + 11 * k)
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


def blobs(table: pa.Table | pa.RecordBatch, name: str = "data") -> list[memoryview]:
    """The values of a binary column, without copies."""
    return [memoryview(v.as_buffer()) for v in table.column(name)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of unsigned 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _GOLDEN
    return x ^ (x >> np.uint64(31))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values of a sorted array begins, and how long it is."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return first, np.diff(np.r_[first, len(keys)])


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all spans in a row."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(total)


def cut(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run."""
    first, size = runs(sorted_keys)
    for a, n in zip(first.tolist(), size.tolist(), strict=True):
        yield int(sorted_keys[a]), a, a + n
