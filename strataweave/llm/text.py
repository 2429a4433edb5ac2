"""Array code over Arrow string columns: whole batches of texts are handled as one byte buffer with offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in chunks of about this many bytes; a longer single text is a chunk by itself.
CHUNK = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240229)
_odd = lambda n: _rng.integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)
#: A random 64-bit value for each byte, and the same with A-Z read as a-z.
BYTE = _odd(256)
LOWER_BYTE = BYTE.copy()
LOWER_BYTE[65:91] = BYTE[97:123]
BASE = int(_odd(1)[0]) | 3
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1024)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of successive chunks of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    limit, at = limit or CHUNK, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def prefix(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """H with H[j] - H[i] = sum of table[data[k]] * BASE**k over i <= k < j."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data) + 1)[0][: len(data)], out=h[1:])
    return h


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same wherever the bytes stand."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """:func:`spans` of ordered spans that don't overlap, block by block, so that a long text needs no long table."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + CHUNK, side="right"))
        if j > i:
            h = prefix(data[base : ends[j - 1]], table)
            out[i:j] = spans(h, starts[i:j] - base, ends[i:j] - base)
        else:  # one span longer than a block
            j, total = i + 1, 0
            for at in range(base, int(ends[i]), CHUNK):
                total += int(prefix(data[at : min(at + CHUNK, ends[i])], table)[-1]) * pow(BASE, at - base, 1 << 64)
            out[i] = mix(np.array([(total + int(ends[i]) - base) % (1 << 64)], np.uint64))[0]
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the text's index of every run of bytes outside ``gaps`` (white space); none crosses two texts."""
    ink = ~gaps[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = ink
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = ink
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text index, words of each text): every run of ``size`` words, with A-Z read as a-z.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    starts, ends, owner = words(data, offsets)
    n = np.bincount(owner, minlength=len(offsets) - 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n
    w = hashed(data, starts, ends, LOWER_BYTE)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    mult = [U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(size)]
    out, who = [], []
    if len(w) >= size:
        whole = np.flatnonzero(owner[size - 1 :] == owner[: len(w) - size + 1])
        acc = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            acc += w[k : len(w) - size + 1 + k] * mult[k]
        out.append(mix(acc[whole]))
        who.append(owner[whole])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        acc = n[short].astype(np.uint64) * U(0xD6E8FEB86659FD93)
        for k in range(size - 1):
            has = n[short] > k
            acc[has] += w[first[short[has]] + k] * mult[k]
        out.append(mix(acc + U(1)))
        who.append(short)
    return (np.concatenate(out), np.concatenate(who), n) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), n)


def sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, who, n = shingles(data, offsets, size)
    if len(who) and (np.diff(who) < 0).any():
        order = np.argsort(who, kind="stable")
        h, who = h[order], who[order]
    bounds = np.searchsorted(who, np.arange(len(n) + 1))
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
