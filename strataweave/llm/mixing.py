"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets are water-filled: a source's target stops at ``most`` times its size, and the excess is shared by weight among
the others. The words of a source stand on one line, shard by shard, and are cut into blocks of ``block`` words. Seats are
words, so that a source smaller than a block meets its target too: a source has a seat for each quotient
target / (2 s + 1) of at least a half (Sainte-Lague with the divisor of one word), and its shards share these seats by the
highest quotients of their sizes, which gives every shard an integer quota. A shard takes each of its blocks
quota // size times, and then blocks in an order fixed by the seed until the quota is reached, the last one cut, so nothing
is drawn twice before all is drawn once.

Sources are told apart, ranked and filled in distributed tables, however many they are; the driver sees a row for each of
their partitions. The order within a shard depends on the row and the seed alone, so reruns agree.

Defined cases. Null source: a source of its own, the last. Null or blank text: size 0, nothing taken. If every source is
full, less than the asked share is taken. Rows that share a doc_id, or have none, are laid out each by itself, in the
order of their texts' hashes; equal rows are interchangeable. No rows: no rows. Extra columns are ignored by :func:`mix`
and kept by :func:`drawn`, whose rows are those that :func:`mix` counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from heapq import heapify, heapreplace
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as tx
from .store import table

#: Documents that share a shard, about, and the most shards of a source.
SHARD_DOCS, MOST_SHARDS = 512, 1 << 16


def fill(sizes: Sequence[float], weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Targets that sum to ``share`` of all sizes, by weight, none above ``most`` times its size (less if all are full)."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 s + 1), ties to the earlier; none beyond its limit.

    Bisection finds the seats whose quotients lie clearly above the last one's, so the work doesn't grow with the seats;
    the few others are dealt one by one by exact fractions.
    """
    v = np.asarray(votes, float)
    cap = np.full(len(v), seats, np.int64) if limits is None else np.minimum(np.asarray(limits, np.int64), seats)
    seats = min(seats, sum(cap[v > 0].tolist()))
    if seats <= 0:
        return [0] * len(v)
    held = lambda q: np.minimum(np.floor((v / q + 1) / 2).astype(np.int64), cap)  # noqa: E731  quotients of at least q, but for rounding
    high, low = v.max() * 2, v.max()
    while held(low).sum() < seats:
        low /= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if held(middle).sum() >= seats else (low, middle)
    got = held(high * (1 + 1e-9)).tolist()
    exact = [Fraction(x) for x in votes]
    heap = [(-exact[i] / (2 * got[i] + 1), i) for i in range(len(v)) if v[i] > 0 and got[i] < cap[i]]
    heapify(heap)
    for _ in range(seats - sum(got)):
        i = heap[0][1]
        got[i] += 1
        heapreplace(heap, (-exact[i] / (2 * got[i] + 1) if got[i] < cap[i] else Fraction(0), i))
    return got


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_mix_size`` (words of the whole text) and ``_mix_hash`` of every row."""
    hashed = docs.withColumn("_mix_hash", F.xxhash64(F.col("text").cast("string")))
    text, schema = hashed.columns.index("text"), hashed.withColumn("_mix_size", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.bincount(tx.words(data, offsets)[2], minlength=n)[:n] for _, n, data, offsets in tx.chunks(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], [*batch.schema.names, "_mix_size"])

    return hashed.mapInArrow(run, schema)


def slim(docs: DataFrame) -> DataFrame:
    """_mix_doc, _mix_source (no null: its order is the code points', null last), _mix_size and _mix_hash of every row."""
    named = docs.select(F.col("doc_id").cast("long").alias("_mix_doc"), _key(docs).alias("_mix_source"), F.col("text").cast("string").alias("text"))
    return sized(named).drop("text")


def _key(docs: DataFrame) -> F.Column:
    return F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """_mix_source, _mix_source_size, _mix_target and _mix_docs (those with words) of every source of ``sizes(_mix_source, _mix_size)``.

    Each round of the filling is one small aggregate; it ends when no source above its limit is left.
    """
    spark = sizes.sparkSession
    found = sizes.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_source_size"), F.sum((F.col("_mix_size") > 0).cast("long")).alias("_mix_docs"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row's partition and place in it, in the order of the sources
    ordered = table(found.repartitionByRange(parts, "_mix_source").sortWithinPartitions("_mix_source").withColumn("_at", F.monotonically_increasing_id()), "sources")
    before, starts = 0, []
    for r in ordered.groupBy(F.shiftright("_at", 33).alias("p")).count().orderBy("p").collect():  # a row for each partition
        starts.append((r["p"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_p long, _before long"))
    numbered = ordered.join(offsets, F.shiftright("_at", 33) == F.col("_p")).withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_before", "_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = table(numbered.filter("_mix_source_size > 0").withColumn("_weight", weight), "weights")
    total = share * (rows.agg(F.sum("_mix_source_size")).first()[0] or 0)
    limit, unit = most * F.col("_mix_source_size"), 0.0
    while True:  # the unit only rises, and with it the sources that it fills
        full = F.col("_weight") * unit > limit
        left, free = rows.agg(F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))).first()
        if not free or total <= left:
            break
        now = (total - left) / free
        if now <= unit:
            break
        unit = now
    target = F.when(F.col("_weight") * unit > limit, limit.cast("double")).otherwise(F.col("_weight") * unit) if free else limit.cast("double")
    none = ordered.filter("_mix_source_size = 0").select("_mix_source", "_mix_source_size", F.lit(0.0).alias("_mix_target"), "_mix_docs")
    return rows.select("_mix_source", "_mix_source_size", target.alias("_mix_target"), "_mix_docs").union(none)


def plan(rows: DataFrame, told: DataFrame, block: int = 32, most: int = 3, seed: int = 1) -> DataFrame:
    """``rows`` of size above 0 with _mix_source_size, _mix_target, the place ``_mix_at`` on the shard's line, and how the shard draws its blocks.

    ``_mix_full`` rounds take every block; of the block at place k = (mul * b + add) mod blocks of the order, all is drawn
    once more if k < ``_mix_whole``, and its first ``_mix_cut`` words if k = ``_mix_whole``.
    """
    known = told.withColumn("_mix_shards", F.least(F.lit(MOST_SHARDS), F.ceil(F.col("_mix_docs") / SHARD_DOCS)).cast("int")).withColumn("_mix_seats", F.floor(F.col("_mix_target") + 0.5)).drop("_mix_docs")
    out = rows.filter("_mix_size > 0").join(known, "_mix_source")
    out = out.withColumn("_mix_order", F.xxhash64("_mix_doc", "_mix_hash", F.lit(seed))).withColumn("_mix_shard", F.pmod(F.xxhash64("_mix_doc", "_mix_hash", F.lit(seed + 1)), F.col("_mix_shards")).cast("int"))
    line = Window.partitionBy("_mix_source", "_mix_shard").orderBy("_mix_order", "_mix_doc", "_mix_hash", "_mix_size")
    out = out.withColumn("_mix_at", F.coalesce(F.sum("_mix_size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_mix_order", "_mix_seats", "_mix_shards")


def quotas(rows: DataFrame, told: DataFrame, block: int = 32, most: int = 3, seed: int = 1) -> DataFrame:
    """(_mix_source, _mix_shard, blocks, full, whole, cut, mul, add) of every shard with words."""
    known = told.select("_mix_source", F.least(F.lit(MOST_SHARDS), F.ceil(F.col("_mix_docs") / SHARD_DOCS)).cast("int").alias("_n"), F.floor(F.col("_mix_target") + 0.5).alias("_seats"))
    each = rows.filter("_mix_size > 0").join(known, "_mix_source").withColumn("_mix_shard", F.pmod(F.xxhash64("_mix_doc", "_mix_hash", F.lit(seed + 1)), F.col("_n")).cast("int"))
    shards = each.groupBy("_mix_source", "_mix_shard").agg(F.sum("_mix_size").alias("_size"), F.first("_seats").alias("_seats"))
    names = {"_mix_source": pa.string(), "_mix_shard": pa.int32(), **dict.fromkeys(("_mix_blocks", "_mix_full", "_mix_whole", "_mix_cut", "_mix_mul", "_mix_add"), pa.int64())}

    def solve(keys: tuple, rows: pa.Table) -> pa.Table:
        # one source: at most MOST_SHARDS rows
        own = sorted(zip(rows["_mix_shard"].to_pylist(), rows["_size"].to_pylist(), strict=True))
        sizes = [s for _, s in own]
        got = sainte_lague(sizes, rows["_seats"][0].as_py(), [most * s for s in sizes])
        out = []
        for (shard, size), quota in zip(own, got, strict=True):
            n = -(-size // block)
            mul = next(k for k in range(max(1, int(n * 0.618)), n + 2) if gcd(k, n) == 1)
            add = (seed * 7919 + shard * 104729) % n
            full, rest = divmod(quota, size)
            short, last = block * n - size, (mul * (n - 1) + add) % n  # the last block's missing words, and its place in the order
            if rest >= block * (last + 1) - short:
                rest += short  # it is among the whole ones
            elif rest > block * last:
                out.append((keys[0].as_py(), shard, n, full, last, rest - block * last, mul, add))
                continue
            out.append((keys[0].as_py(), shard, n, full, *divmod(rest, block), mul, add))
        return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(names.items())})

    return shards.groupBy("_mix_source").applyInArrow(solve, "_mix_source string, _mix_shard int, " + ", ".join(f"{k} long" for k in list(names)[2:]))


def _planned(rows: DataFrame, sizes: DataFrame, told: DataFrame, most: int, block: int, seed: int) -> DataFrame:
    return plan(rows, told, block, most, seed).join(quotas(sizes, told, block, most, seed), ["_mix_source", "_mix_shard"])


def _extra(block: int) -> F.Column:
    """[(first, end)]: the words of the document in blocks that are drawn once more."""
    size, at, whole, cut = (F.col(f"_mix_{c}") for c in ("size", "at", "whole", "cut"))
    place = lambda b: F.pmod(F.col("_mix_mul") * b + F.col("_mix_add"), F.col("_mix_blocks"))
    drawn = F.filter(F.sequence(F.floor(at / block), F.floor((at + size - 1) / block)), lambda b: place(b) <= whole)
    spans = F.transform(drawn, lambda b: F.struct(F.greatest(b * block - at, F.lit(0)).cast("long").alias("first"), F.least(b * block - at + F.when(place(b) < whole, block).otherwise(cut), size).cast("long").alias("end")))
    return F.when((whole > 0) | (cut > 0), F.filter(spans, lambda x: x["end"] > x["first"])).otherwise(F.array().cast("array<struct<first:bigint,end:bigint>>"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3, block: int = 32, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) for every row of ``docs(doc_id, source, text)``."""
    sizes = table(slim(docs), "sizes")
    told = table(targets(sizes, weights, share, most), "targets")
    planned = _planned(sizes, sizes, told, most, block, seed)
    more = F.aggregate(_extra(block), F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    taken = (F.col("_mix_full") * F.col("_mix_size") + more).cast("long")
    none = sizes.filter("_mix_size = 0").join(told, "_mix_source")
    source = F.when(F.col("_mix_source") == "1", F.lit(None).cast("string")).otherwise(F.substring("_mix_source", 2, 1 << 30)).alias("source")
    columns = lambda taken: (F.col("_mix_doc").alias("doc_id"), source, F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), taken.alias("taken"))
    return planned.select(*columns(taken)).union(none.select(*columns(F.lit(0).cast("long"))))


def drawn(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3, block: int = 32, seed: int = 1) -> DataFrame:
    """The mix itself: ``docs``' rows as often as their words are drawn, the last time cut to the drawn blocks' words.

    A whole text stays as it is; a cut one holds its drawn words, in order, with one space between them. The texts are laid
    out on their lines themselves, in one shuffle, so no key has to lead from a plan back to its row.
    """
    sizes = table(slim(docs), "sizes")
    rows = sized(docs).withColumn("_mix_doc", F.col("doc_id").cast("long")).withColumn("_mix_source", _key(docs))
    told = table(targets(sizes, weights, share, most), "targets")
    rows = _planned(rows, sizes, told, most, block, seed).withColumn("_mix_extra", _extra(block))
    # words are split behind the shuffle, as they are larger than the text, and only where a part is drawn
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    total = F.aggregate("_mix_extra", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    part = lambda w: F.concat_ws(" ", F.flatten(F.transform("_mix_extra", lambda x: F.slice(w, (x["first"] + 1).cast("int"), (x["end"] - x["first"]).cast("int")))))
    rows = rows.withColumn("_mix_total", total).withColumn("_mix_words", F.when((F.col("_mix_total") > 0) & (F.col("_mix_total") < F.col("_mix_size")), words))
    last = F.when(F.col("_mix_total") == F.col("_mix_size"), F.array("text")).when(F.col("_mix_total") > 0, F.array(part(F.col("_mix_words")))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumn("text", F.explode(F.concat(F.array_repeat("text", F.col("_mix_full").cast("int")), last)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
