"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for every length, the polynomial of its first code points modulo two primes below 2**31. They
give the hash of any span with one subtraction and one product, wherever it stands, and a binary search over them finds
the longest common extension from any two places. Texts are worked through in blocks of ``BLOCK`` code points.

The fingerprint is the length, both full hashes and the ``KEPT`` smallest hashes of spans of ``GRAM`` code points (a shorter
text is one span): a sample chosen by content, the same in every copy. Two fingerprints alone tell how alike their texts
are: with J the share of the smallest values of both together that both have, the likeness is 2 J / (1 + J), which is
the share of spans that two texts of one length have in common. A small edit anywhere touches ``GRAM`` spans only.

The next document is found without a global sort. Splitters on doc_id cut the order into buckets, and one doc_id (or none)
that many rows share is cut further by the hashes of their texts. A first pass finds each bucket's first row, a second
one deals the rows and sends each first row to the end of the bucket before it too, so a bucket's rows stand in order
in one partition and no partition has to know another.

Defined cases. Null text: as an empty one; two empty texts have likeness 1. Rows that share a doc_id follow each other by the
hashes of their texts. Null doc_id: after all others. A single row is its own next. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

PRIMES = (2147483647, 2147483629)
BASES = (1_103_515_245, 1_664_525_123)
#: Code points of a span and of a block, and spans of a fingerprint.
GRAM, BLOCK, KEPT = 16, 1 << 20, 64
#: Documents of a bucket, about, and splitters that the driver holds at most.
BUCKET, SPLITTERS = 1024, 20_000

_powers: dict[int, np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**i modulo prime for i < n at least, by doubling."""
    x = _powers.get(base, np.ones(1, np.uint64))
    while len(x) < n:
        x = np.concatenate([x, x * np.uint64(pow(base, len(x), prime)) % np.uint64(prime)])
    _powers[base] = x
    return x


class Prefix:
    """The prefix arrays of a text of one block."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, self.h = len(points), []
        for base, p in zip(BASES, PRIMES, strict=True):
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * powers(base, p, self.n)[: self.n] % np.uint64(p), out=h[1:])
            self.h.append(h % np.uint64(p))

    def spans(self, n: int) -> np.ndarray:
        """A 62-bit hash, spread over 64, of each span of ``n`` code points; equal spans have equal hashes in every text."""
        out = np.zeros(self.n - n + 1, np.uint64)
        for base, p, h in zip(BASES, PRIMES, self.h, strict=True):
            back = powers(pow(base, -1, p), p, len(out))[: len(out)]
            out = (out << np.uint64(31)) + (h[n:] + np.uint64(p) - h[: len(out)]) % np.uint64(p) * back % np.uint64(p)
        return tx.mix(out)

    def same(self, i: int, other: Prefix, j: int, n: int) -> bool:
        """Whether this text's span [i, i + n) equals the other's [j, j + n)."""
        for k, p in enumerate(PRIMES):
            x = (int(self.h[k][i + n]) - int(self.h[k][i])) % p
            y = (int(other.h[k][j + n]) - int(other.h[k][j])) % p
            a, b = (1, pow(BASES[k], i - j, p)) if i >= j else (pow(BASES[k], j - i, p), 1)
            if x * a % p != y * b % p:
                return False
        return True

    def extension(self, i: int, other: Prefix, j: int) -> int:
        """The longest n with equal spans from i and j on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if self.same(i, other, j, n) else (low, n - 1)
        return low


def least(values: np.ndarray) -> np.ndarray:
    """The ``KEPT`` smallest different values, in order."""
    few = np.unique(np.partition(values, 4 * KEPT)[: 4 * KEPT]) if len(values) > 4 * KEPT else np.unique(values)
    return (few if len(few) >= KEPT or len(values) <= 4 * KEPT else np.unique(values))[:KEPT]


class Print:
    """A text's fingerprint, with the prefix arrays of its first block."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        full, found = [0] * len(PRIMES), np.zeros(0, np.uint64)
        for at in range(0, max(1, self.n), BLOCK):
            block = Prefix(text[at : at + BLOCK + GRAM - 1])
            for k, p in enumerate(PRIMES):
                full[k] = (full[k] + int(block.h[k][min(BLOCK, block.n)]) * pow(BASES[k], at, p)) % p
            if block.n >= GRAM or not at and block.n:
                found = least(np.concatenate([found, block.spans(min(GRAM, block.n))]))
            if not at:
                self.head = block
        self.values = found >> np.uint64(24)
        self.told = f"{self.n:x}-{''.join(f'{x:08x}' for x in full)}-{self.values.astype('>u8').view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()}"

    def common_start(self, other: Print) -> int:
        """The longest common extension from both starts."""
        if min(self.n, other.n) <= BLOCK:
            return self.head.extension(0, other.head, 0)
        total = 0
        for at in range(0, min(self.n, other.n), BLOCK):
            x, y = Prefix(self.text[at : at + BLOCK]), Prefix(other.text[at : at + BLOCK])
            n = x.extension(0, y, 0)
            total += n
            if n < BLOCK:
                break
        return total


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    every = np.union1d(x, y)
    if not len(every):
        return 0.0
    if max(len(x), len(y)) >= KEPT:
        every = every[:KEPT]
    both = np.intersect1d(x, y, assume_unique=True)
    j = float((both <= every[-1]).sum()) / len(every)
    return 2 * j / (1 + j)


def likeness(one: str, two: str) -> float:
    """Of two fingerprints, 0 to 1; equal ones have 1."""
    if one == two:
        return 1.0
    values = []
    for told in (one, two):
        bytes_ = np.frombuffer(bytes.fromhex(told.rpartition("-")[2]), np.uint8).reshape(-1, 5)
        values.append(np.concatenate([np.zeros((len(bytes_), 3), np.uint8), bytes_], 1).view(">u8")[:, 0].astype(np.uint64))
    return _alike(*values)


def _near(one: Print, two: Print) -> float:
    return 1.0 if one.told == two.told else _alike(one.values, two.values)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many of the first code points of ``following``, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _sorted_with_next(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, h, text, closing): each bucket's rows, descending, then the first row of the next bucket."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n, known = slim.agg(F.count("*"), F.count("doc_id")).first()
    size = max(BUCKET, n // SPLITTERS)
    heavy = {r["doc_id"]: r["count"] for r in slim.groupBy("doc_id").count().filter(F.col("count") >= 2 * size).collect()}  # at most SPLITTERS / 2 rows
    parts = max(1, known // size)
    found = slim.filter("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts)], 100_000), F.max("doc_id")).first() if known else None
    ids = {*found[0], found[1]} if known else set()
    ids |= {x - k for x in heavy if x is not None for k in (0, 1) if x - k >= -(1 << 63)}
    heads = np.array(sorted(ids), np.int64)  # ascending; a bucket holds the ids up to its head and above the head before
    cuts = np.array([-(-heavy.get(int(x), 1) // size) for x in heads[::-1]] + [-(-heavy.get(None, 1) // size)], np.int64)
    base = np.concatenate(([0], np.cumsum(cuts)))
    shared = spark.sparkContext.broadcast((heads, cuts, base))

    def bucket(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        up, cut, zero = shared.value
        none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        d, h = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("h").to_numpy()
        at = np.where(none, len(up), len(up) - 1 - np.searchsorted(up, d))
        return zero[at] + (((h >> 32) + (1 << 31)) * cut[at] >> 32), none, d, h

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, none, d, h = bucket(batch)
            order = np.lexsort((h, ~d, none, b))
            new = np.ones(len(order), bool)
            new[1:] = b[order][1:] != b[order][:-1]
            i = order[new]
            yield pa.record_batch([pa.array(b[i]), pa.array(none[i].astype(np.int64)), pa.array(~d[i]), pa.array(h[i])], ["bucket", "none", "d", "h"])

    first = slim.select("doc_id", "h").mapInArrow(firsts, "bucket long, none long, d long, h long").groupBy("bucket").agg(F.min(F.struct("none", "d", "h")).alias("f"))
    rows = sorted((r["bucket"], r["f"]["none"], ~r["f"]["d"], r["f"]["h"]) for r in first.collect())  # a row for each bucket
    top = np.full((4, int(base[-1])), -1, np.int64)  # of each bucket's first row: whether it has no id, its id, its hash; the bucket before
    for k, (b, none, d, h) in enumerate(rows):
        top[:, b] = none, d, h, rows[k - 1][0]
    tops = spark.sparkContext.broadcast(top)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "doc_id", "h", "text", "closing"]
        for batch in batches:
            b, none, d, h = bucket(batch)
            own = [batch.column(c) for c in names[1:4]]
            yield pa.record_batch([pa.array(b), *own, pa.array(np.zeros(len(d), bool))], names)
            t = tops.value[:, b]
            lead = np.flatnonzero((t[0] == none) & (t[1] == d) & (t[2] == h))
            lead = lead[np.unique(b[lead], return_index=True)[1]]
            if len(lead):
                again = [c.take(pa.array(lead)) for c in own]
                yield pa.record_batch([pa.array(t[3][lead]), *again, pa.array(np.ones(len(lead), bool))], names)

    return slim.select("doc_id", "h", "text").mapInArrow(deal, "bucket long, doc_id long, h long, text string, closing boolean")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and common_start (code points
    that the text and the next one share from their starts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, doc_id, print)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_start"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            out = []
            for bucket, doc, text, closing in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "closing")), strict=True):
                if closing and (last is None or last[0] != bucket):
                    continue  # another copy of the row that closes the bucket
                now = Print(text)
                if last is not None and last[0] == bucket:
                    _, before, own = last
                    changed = edited(own.text, text)
                    e = Print(changed)
                    out.append((before, own.n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.told, e.told, _near(own, e), _near(own, now), own.common_start(now)))
                last = None if closing else (bucket, doc, now)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = _sorted_with_next(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "closing", F.col("doc_id").desc_nulls_last(), "h", "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long")


def op7_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
