"""Exact repeated substrings by a sparse suffix sort.

A byte goes if a string of ``length`` bytes covers it that also starts earlier. Suffixes are sampled where a window's
content puts them: of each window of ``length`` bytes, the one that starts with its smallest ``GRAM``-byte hash (the
leftmost of equals). Equal windows so choose the same suffix at the same offset, and every window belongs to one suffix.

1. Each task finds its sampled suffixes and, for each, the context that its windows span. Of suffixes with equal
   contexts it keeps the first and marks the others' windows right there, so no context leaves a task twice.
2. Sampled splitters deal the rest by range of their leading bytes (ties by the hash of the gram); a gram that many sampled
   documents hold is dealt by its contexts instead, all of which go on to step 3. A bucket sorts its
   suffixes by multikey quicksort: by gram, ties by context, ties by place. Equal keys never lie in two buckets. All but the
   first of a context are marked; where one gram has several contexts, the first of each is left to step 3.
3. The windows of these few suffixes are compared one by one in the same way, by two hashes each.
4. The marked intervals of each document are merged, and the rest of its bytes is digested.

Defined cases. Null text: as an empty one, which loses nothing. Rows that share a doc_id count as parts of one document
in order of their texts; a match never crosses rows, and each row has its own result. Null doc_id: after all others, as one
document's parts. No rows: no rows. Extra columns are ignored by :func:`repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as tx
from .blobs import DEALT, bucket_of, pack, unpack
from .blobs import batch as _batch
from .blobs import deal
from .store import table

GRAM = 34
#: Suffixes that a task gathers before it sends them on, the documents whose suffixes make the splitters, the times that a
#: gram must stand in these to be dealt by its contexts, and bytes of text for which there is a bucket (of 20,000 at most).
GATHERED, SAMPLED, HEAVY, BUCKET_BYTES, MOST_BUCKETS = 400_000, 2000, 40, 1 << 22, 20_000
#: Tags of blobs: suffixes, marks, suffixes of heavy grams.
LIGHT, MARKED, SPREAD = range(3)
#: A row's place in its document: the rows of one doc_id stand this many bytes apart.
ROW = 1 << 40
LAST = (1 << 63) - 1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from the minima of blocks to both sides."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def sampled_suffixes(data: np.ndarray, offsets: np.ndarray, length: int = 100, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Of each sampled suffix: its place, first and last window, hashes of its gram and context, leading bytes, text index."""
    size = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if not len(data) or size.max() < length:
        return dict.fromkeys(("at", "first", "last", "owner"), none) | dict.fromkeys(("gram", "context", "lead"), none.astype(np.uint64))
    h = tx.prefix(data)
    places = np.arange(len(data) - gram + 1)
    grams = tx.spans(h, places, places + gram)
    bits = np.uint64(max(24, len(data).bit_length()))
    least = sliding_least((grams >> bits << bits) | places.astype(np.uint64), length - gram + 1)
    inside = np.zeros(len(data) + 1, np.int32)
    long_ = size >= length
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(least)])
    at = (least[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    starts = np.flatnonzero(new)
    first, last, at = windows[starts], windows[np.append(starts[1:], len(windows)) - 1], at[starts]
    lead = np.zeros(len(at), np.uint64)
    for k in range(5):
        lead = lead << np.uint64(8) | data[at + k]
    context = tx.mix(tx.spans(h, first, last + length) ^ (at - first).astype(np.uint64))
    return {"at": at, "first": first, "last": last, "owner": np.searchsorted(offsets, at, side="right") - 1, "gram": grams[at], "context": context, "lead": lead << np.uint64(24) | grams[at] >> np.uint64(40)}


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets) of a chunk, or of the pieces of a long text: each window of ``length`` bytes lies in one of them."""
    if len(offsets) > 2 or len(data) <= 2 * tx.CHUNK:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - length + 1, tx.CHUNK):
        part = data[at : at + tx.CHUNK + length - 1]
        yield at, part, np.array([0, len(part)])


def window_hashes(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The hash of the window at each place, block by block."""
    if len(data) <= 2 * tx.CHUNK:
        return tx.spans(tx.prefix(data), places, places + length)
    out, order = np.empty(len(places), np.uint64), np.argsort(places, kind="stable")
    sorted_ = places[order]
    for at in range(0, len(data), tx.CHUNK):
        own = order[np.searchsorted(sorted_, at) : np.searchsorted(sorted_, at + tx.CHUNK)]
        if len(own):
            out[own] = tx.spans(tx.prefix(data[at : at + tx.CHUNK + length]), places[own] - at, places[own] - at + length)
    return out


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, ties by the second, and so on; only what is tied is sorted again."""
    order = np.argsort(keys[0], kind="stable")
    tied = np.zeros(len(order), bool)  # equal to the one before in all keys so far
    tied[1:] = keys[0][order][1:] == keys[0][order][:-1]
    for key in keys[1:]:
        touched = tied.copy()
        touched[:-1] |= tied[1:]
        where = np.flatnonzero(touched)
        if not len(where):
            break
        group = np.cumsum(~tied)[where]
        own = order[where]
        order[where] = own[np.lexsort((key[own], group))]
        x = key[order]
        tied[1:] &= x[1:] == x[:-1]
    return order


def _rows(batch: pa.RecordBatch, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc").slice(at, n).to_numpy(), batch.column("part").slice(at, n).to_numpy().astype(np.int64) * ROW


MARKS = "doc long, start long, stop long"


def _marks(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Intervals, those that meet within a document merged."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if len(doc):
        reach = stop.copy()
        new = np.ones(len(doc), bool)
        # intervals are short and of nearly one length: a start beyond the stop before it begins another run
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
        first = np.flatnonzero(new)
        doc, start, stop = doc[first], start[first], np.maximum.reduceat(reach, first)
    return pa.record_batch([pa.array(doc), pa.array(start), pa.array(stop)], ["doc", "start", "stop"])


def _sampled(docs: DataFrame, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(splitters: quantiles of leading bytes; heavy grams) of the suffixes of a bounded sample of documents; they shape the
    balance, never the result."""
    total = docs.count()
    sample = docs.sample(min(1.0, SAMPLED / max(1, total)), seed=5).limit(2 * SAMPLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tx.chunks(batch.column("text")):
                s = sampled_suffixes(data, offsets, length)
                yield pa.record_batch([pa.array(s[c].view(np.int64)) for c in ("lead", "gram")], ["lead", "gram"])

    found = sample.select("text").mapInArrow(run, "lead long, gram long")
    keys = np.sort(found.filter(F.pmod(F.xxhash64("lead"), F.lit(8)) == 0).select("lead").toArrow()["lead"].to_numpy().view(np.uint64))
    heavy = found.groupBy("gram").count().filter(F.col("count") >= HEAVY).select("gram").toArrow()["gram"].to_numpy().view(np.uint64)
    return (np.unique(keys[(np.arange(1, buckets) * len(keys)) // buckets]) if len(keys) else np.zeros(0, np.uint64)), heavy


def first_pass(docs: DataFrame, splitters: np.ndarray, heavy: np.ndarray, length: int = 100) -> DataFrame:
    """Step 1 for ``docs(doc, part, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast((splitters, heavy))  # 20,000 of the first, a few of the second

    def flush(held: list[list[np.ndarray]]) -> list[tuple]:
        doc, at, before, after, gram, context, lead = (np.concatenate(x) for x in zip(*held, strict=True))
        order = multikey_order(gram, context, doc, at)
        gram, context = gram[order], context[order]
        later = np.zeros(len(order), bool)
        later[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])
        doc, at, before, after, lead = (x[order] for x in (doc, at, before, after, lead))
        m = _marks(doc[later], (at - before)[later], (at + after)[later])
        splitters, heavy = shared.value
        out = [(int(doc[later][0]) % (len(splitters) + 1), MARKED, pack(*(c.to_numpy() for c in m.columns)))] if m.num_rows else []
        spread = np.isin(gram, heavy)
        light, spread = np.flatnonzero(~later & ~spread), np.flatnonzero(~later & spread)
        rows = lambda i: [c[i] for c in (gram, context, doc, at, before, after)]
        out += deal(np.searchsorted(splitters, lead[light], side="right"), rows(light), LIGHT)
        out += deal(bucket_of(tx.mix(gram[spread] ^ context[spread]), len(splitters) + 1), rows(spread), SPREAD)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for at, n, data, offsets in tx.chunks(batch.column("text")):
                doc, base = _rows(batch, at, n)
                for zero, part, cuts in pieces(data, offsets, length):
                    s = sampled_suffixes(part, cuts, length)
                    place = s["at"] + zero - cuts[s["owner"]] + base[s["owner"]]
                    held.append([doc[s["owner"]], place, s["at"] - s["first"], s["last"] + length - s["at"], s["gram"], s["context"], s["lead"]])
                    count += len(place)
                    if count >= GATHERED:
                        yield _batch(flush(held))
                        held, count = [], 0
        if held:
            yield _batch(flush(held))

    return docs.mapInArrow(run, DEALT)


def buckets(dealt: DataFrame, whole: bool, length: int) -> DataFrame:
    """Marks of every bucket, without a gram. With ``whole`` the keys are contexts, and suffixes of which one gram has
    several contexts, or may have, come out too, with gram, place and reach."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(held: list[list[np.ndarray]], heavy: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        gram, second, doc, at, *reach = (np.concatenate(x) for x in zip(*held, strict=True))
        order = multikey_order(gram, second, doc, at)
        gram, second, doc, at = gram[order], second[order], doc[order], at[order]
        reach = [r[order] for r in reach]
        later = np.zeros(len(order), bool)
        later[1:] = (gram[1:] == gram[:-1]) & (second[1:] == second[:-1])
        start, stop = (at - reach[0], at + reach[1]) if whole else (at, at + length)
        yield told(_marks(doc[later], start[later], stop[later]))
        if whole:
            head = np.flatnonzero(~later)
            g = gram[head]
            several = np.full(len(head), heavy)
            several[1:] |= g[1:] == g[:-1]
            several[:-1] |= g[1:] == g[:-1]
            i = head[several]
            yield pa.record_batch([pa.array(doc[i]), pa.array(start[i]), pa.array(stop[i]), pa.array(gram[i].view(np.int64)), pa.array(at[i])], names)

    names = ["doc", "start", "stop", "gram", "at"]

    def told(m: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(m.num_rows, pa.int64())
        return pa.record_batch([*m.columns, none, none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = {LIGHT: [], SPREAD: []}, None
        for batch in batches:
            for b, tag, blob in zip(*(batch.column(c) for c in ("bucket", "tag", "blob")), strict=True):
                if tag.as_py() == MARKED:
                    yield told(pa.record_batch([pa.array(x) for x in unpack(blob.as_py())], ["doc", "start", "stop"]))
                    continue
                if b.as_py() != bucket:
                    for kind, rows in held.items():
                        yield from solve(rows, kind == SPREAD)
                    held, bucket = {LIGHT: [], SPREAD: []}, b.as_py()
                held[tag.as_py()].append(unpack(blob.as_py()))
        for kind, rows in held.items():
            yield from solve(rows, kind == SPREAD)

    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{MARKS}, gram long, at long")


def _second_pass(docs: DataFrame, asked: DataFrame, length: int, buckets: int) -> DataFrame:
    """The windows of the suffixes that are asked for, dealt by gram and their place around it."""
    lists = asked.withColumn("part", F.shiftright("start", 40).cast("int")).groupBy("doc", "part").agg(F.collect_list(F.struct("start", "stop", "gram", "at")).alias("asks"))
    joined = docs.join(lists, ["doc", "part"])

    def flush(held: list[list[np.ndarray]]) -> list[tuple]:
        gram, window, doc, place, offset = (np.concatenate(x) for x in zip(*held, strict=True))
        order = multikey_order(gram, window, doc, place)
        gram, window, doc, place, offset = (x[order] for x in (gram, window, doc, place, offset))
        later = np.zeros(len(order), bool)
        later[1:] = (gram[1:] == gram[:-1]) & (window[1:] == window[:-1])
        m = _marks(doc[later], place[later], place[later] + length)
        out = [(int(doc[0]) % buckets, MARKED, pack(*(c.to_numpy() for c in m.columns)))] if m.num_rows else []
        keep = ~later
        # gram and window together tell the window: 128 bits. Equal windows meet, and eight neighbours share a bucket: their
        # columns take little room, and a task sends few blobs
        key = tx.mix(gram[keep] ^ (offset[keep] >> 3).astype(np.uint64))
        return out + list(deal(bucket_of(key, buckets), [gram[keep], window[keep], doc[keep], place[keep]], LIGHT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            asks = batch.column("asks")
            for at, n, data, offsets in tx.chunks(batch.column("text")):
                doc, base = _rows(batch, at, n)
                part = asks.slice(at, n)
                owner = np.repeat(np.arange(n), np.diff(np.asarray(part.offsets)))
                flat = part.flatten()
                start, stop, gram, place = (flat.field(k).to_numpy() for k in range(4))
                many = stop - start - length + 1
                each = np.repeat(np.arange(len(start)), many)
                p = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                o = owner[each]
                local = p - base[o] + offsets[o]
                held.append([gram[each].view(np.uint64), window_hashes(data, local, length), doc[o], p, place[each] - p])
                count += len(p)
                if count >= 2 * GATHERED:
                    yield _batch(flush(held))
                    held, count = [], 0
        if count:
            yield _batch(flush(held))

    return joined.select("doc", "part", "text", "asks").mapInArrow(run, DEALT)


def marked(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): the rows as (doc, part, doc_id, text), and intervals (doc, start, stop) of their repeated bytes, that may overlap."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    if rows.groupBy("doc").count().filter("count > 1").take(1):
        rows = rows.withColumn("part", F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1)
    else:
        rows = rows.withColumn("part", F.lit(0))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    splitters, heavy = _sampled(rows, length, n)
    slim = rows.select("doc", "part", "text")
    found = table(buckets(first_pass(slim, splitters, heavy, length), True, length), "suffixes")
    asked = found.filter("gram IS NOT NULL")
    more = table(buckets(_second_pass(slim, asked, length, n), False, length), "windows")
    return rows, found.filter("gram IS NULL").select("doc", "start", "stop").union(more.select("doc", "start", "stop"))


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs(doc_id, text)``."""
    rows, marks = marked(docs, length)
    lists = marks.withColumn("part", F.shiftright("start", 40).cast("int")).groupBy("doc", "part").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            base = batch.column("part").to_numpy().astype(np.int64) * ROW
            texts = batch.column("text").cast(pa.large_binary())
            for doc, body, found, zero in zip(batch.column("doc_id").to_pylist(), texts, batch.column("marks"), base, strict=True):
                data = np.frombuffer(body.as_py(), np.uint8)
                if not found.is_valid:
                    out.append((doc, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, found.values.field("start").to_numpy() - zero, 1)
                np.add.at(step, found.values.field("stop").to_numpy() - zero, -1)
                gone = np.cumsum(step, out=step)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    joined = rows.join(lists, ["doc", "part"], "left").select("doc_id", "part", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_sampled_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL for the same rows: every window of every text, the first of equal ones stays, and the rest by gaps and islands.
OP5_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i, i + 99) AS s FROM (SELECT doc_id, unnest(range(1, octet_length(b) - 98)) AS i, b FROM b WHERE octet_length(b) >= 100)),
f AS (SELECT s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
h AS (SELECT doc_id, i, 2 AS r FROM w JOIN f ON w.s = f.s WHERE (doc_id, i) <> first),
m AS (SELECT doc_id, i AS a, i + 100 AS z, lag(i + 100) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM h WHERE r > 1),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM m),
s AS (SELECT doc_id, k, min(a) AS a, max(z) AS z FROM g GROUP BY ALL),
e AS (SELECT doc_id, a AS upto, z AS next FROM s UNION ALL SELECT doc_id, octet_length(b) + 1, NULL FROM b),
q AS (SELECT e.doc_id, upto, coalesce(lag(next) OVER (PARTITION BY e.doc_id ORDER BY upto, next NULLS LAST), 1) AS since FROM e),
t AS (SELECT q.doc_id, string_agg(hex(array_slice(b, since, upto - 1)), '' ORDER BY since, upto) FILTER (upto > since) AS kept FROM q JOIN b ON q.doc_id = b.doc_id GROUP BY 1),
c AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY 1)
SELECT b.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b JOIN t ON b.doc_id = t.doc_id LEFT JOIN c ON b.doc_id = c.doc_id
"""
