"""Integer arrays packed into one binary value, each in the fewest bytes that hold it from its minimum on, and dealt to buckets."""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

#: (bucket, tag, blob): arrays on their way to the task of a bucket; the tag tells what they are.
DEALT = "bucket int, tag int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; unsigned 64-bit hashes stay as they are, a constant takes no room."""
    n = len(arrays[0])
    out = [struct.pack("<qi", n, len(arrays))]
    for x in arrays:
        plain = x.dtype == np.uint64
        low = 0 if plain or not n else int(x.min())
        top = 0 if not n else int(x.max()) - low
        width = 8 if plain and n else (top.bit_length() + 7) // 8
        out.append(struct.pack("<qB?", low, width, plain))
        if width == 8:
            out.append((x if plain else x.astype(np.int64).view(np.uint64) - np.uint64(low & (1 << 64) - 1)).tobytes())
        elif width:
            out.append((x - low).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes())
    return b"".join(out)


def unpack(blob: bytes | pa.Buffer, first: int | None = None) -> list[np.ndarray]:
    """The arrays of a blob, or the ``first`` of them."""
    (n, k), at, out = struct.unpack_from("<qi", blob), 12, []
    for _ in range(min(k, k if first is None else first)):
        low, width, plain = struct.unpack_from("<qB?", blob, at)
        at += 10
        if width == 8:
            x = np.frombuffer(blob, "<u8", n, at)
            out.append(x if plain else (x + np.uint64(low & (1 << 64) - 1)).view(np.int64))
        else:
            wide = np.zeros((n, 8), np.uint8)
            if width:
                wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
            x = wide.view("<i8")[:, 0]
            out.append(x.view(np.uint64) if plain else x + low)
        at += n * width
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of 64-bit hashes, all as wide."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def often(key: np.ndarray, least: int) -> np.ndarray:
    """Whether a row's key comes ``least`` times or more."""
    out = np.zeros(len(key), bool)
    if len(key) >= least:
        order = np.argsort(key, kind="stable")
        x = key[order]
        runs = np.zeros(len(key) + 1, np.int32)
        begin = np.flatnonzero(x[least - 1 :] == x[: len(x) - least + 1])
        runs[begin] += 1
        runs[begin + least] -= 1
        out[order] = np.cumsum(runs[:-1]) > 0
    return out


def shared(blobs: list[bytes | pa.Buffer]) -> list[np.ndarray]:
    """All columns of the rows whose first column comes twice or more among ``blobs``. The other rows are never gathered, only
    their first column."""
    keep = often(np.concatenate([unpack(b, 1)[0] for b in blobs]), 2)
    out, at = [], 0
    for b in blobs:
        x = unpack(b)
        own = np.flatnonzero(keep[at : at + len(x[0])])
        out.append([c[own] for c in x])
        at += len(x[0])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def deal(bucket: np.ndarray, columns: list[np.ndarray | tuple[np.ndarray, np.ndarray]], tag: int) -> Iterator[tuple]:
    """A (bucket, tag, blob) row for each bucket that has rows. A column is an array, or (values, each row's place in them)."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(bucket[part[0]]), tag, pack(*(c[0][c[1][part]] if isinstance(c, tuple) else c[part] for c in columns))


def batches(rows: Iterable[tuple], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """(bucket, tag, blob) rows as batches of about ``size`` bytes, so that one of them at a time is copied."""
    held, count = [], 0
    for row in rows:
        held.append(row)
        count += len(row[2])
        if count >= size:
            yield batch(held)
            held, count = [], 0
    if held:
        yield batch(held)


def trim() -> None:
    """Give freed memory back to the system: a Python worker stays for its next tasks, beside others on its executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "tag", "blob"])
