"""Near-duplicate documents: SetSketch registers, banded, filtered by joint likelihood, then confirmed on full sets.

Every document's set is its distinct word shingles. Register ``i`` holds the exponentially spaced, truncated minimum
``K_i = clamp(floor(1 - log_b(min_x e_i(x))), 0, q + 1)`` over exponential variates ``e_i(x)`` of rate ``a``: registers of
a union are the larger of both, and equal registers grow likelier with the Jaccard similarity. Rows of registers form
bands; documents that share a band meet first around one member of the band. Where that left several components in a band,
their members are joined on prefixes of their full sets, rarest shingles first, which finds every further link without
making all pairs of a group. A pair goes on if its jointly estimated similarity may reach the threshold, and is linked
only by its full sets.

Defined cases. Null or blank text: empty set, linked with nothing, its own component. Rows that share a doc_id are one
node of the graph, and each has its own n_shingles. Null doc_id: component null, kept false, links with nothing.
No rows: no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .store import drop, table


@dataclass(frozen=True)
class Sketch:
    """Registers, their base and rate, and the rows of a band.

    With 96 registers in 24 bands of 4, two sets of similarity 0.85 (0.8) miss every band with probability 2e-8 (5e-7).
    """

    registers: int = 96
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65534
    words: int = 5

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(7)
        return rng.integers(0, 1 << 63, self.registers, dtype=np.uint64) * tx.U(2) + tx.U(1), rng.integers(0, 1 << 63, self.registers, dtype=np.uint64)

    def of_minima(self, minima: np.ndarray) -> np.ndarray:
        """Registers of uniform minima, as uint16; merging two sketches is their elementwise maximum."""
        u = (minima.astype(np.float64) + 1.0) / 2.0**64
        e = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / self.rate
        return np.clip(np.floor(1 - np.log(e) / np.log(self.base)), 0, self.limit + 1).astype(np.uint16)

    def of_sets(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sets, registers) for sets that stand one after the other in ``hashes``; none is empty."""
        minima = np.empty((len(starts), self.registers), np.uint64)
        step = 1 << 15
        cuts = [0]
        while cuts[-1] < len(starts):  # blocks that stay in the cache
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + step, side="right")) - 1))
            cuts[-1] = len(starts) if cuts[-1] >= len(starts) - 1 and starts[-1] - starts[cuts[-2]] < step else cuts[-1]
        mul, add = self.factors()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            block = hashes[starts[a] : starts[b] if b < len(starts) else len(hashes)]
            at = starts[a:b] - starts[a]
            tmp = np.empty_like(block)
            for i in range(self.registers):
                np.bitwise_xor(block, add[i], out=tmp)
                np.multiply(tmp, mul[i], out=tmp)
                minima[a:b, i] = np.minimum.reduceat(tmp, at)
        return self.of_minima(minima)

    def bands(self, registers: np.ndarray) -> np.ndarray:
        """(sets, bands) of 64-bit keys; a key tells its band too."""
        n = self.registers // self.rows
        grouped = registers[:, : n * self.rows].reshape(len(registers), n, self.rows).astype(np.uint64)
        key = tx.mix(np.arange(1, n + 1, dtype=np.uint64))[None, :].repeat(len(registers), 0)
        for k in range(self.rows):
            key = tx.mix(key ^ grouped[:, :, k] * tx.U(0x9E3779B97F4A7C15))
        return key

    def estimate(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
        """Maximum-likelihood similarity of pairs, from which registers are larger, smaller and equal, and the set sizes."""
        more, less = (x > y).sum(1), (x < y).sum(1)
        same = x.shape[1] - more - less
        u, v = nx / (nx + ny), ny / (nx + ny)
        top = np.minimum(u / v, v / u)
        grid = np.linspace(0, 1, 101)[None, :] * top[:, None]
        b = self.base
        p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (b - 1) / b) / np.log(b)
        above, below = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
        log = lambda z: np.log(np.maximum(z, 1e-12))
        score = more[:, None] * log(above) + less[:, None] * log(below) + same[:, None] * log(1 - above - below)
        return np.take_along_axis(grid, score.argmax(1)[:, None], 1)[:, 0]


#: Buckets of the table that orders shingles by rarity.
COUNTER_BITS = 20
COUNTERS = 1 << COUNTER_BITS

SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, registers binary"


def signatures(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """One row a document: its set's size, a 128-bit digest of the set, band keys and registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in tx.chunks(batch.column("text")):
                found = tx.sets(data, offsets, sketch.words)
                size = np.array([len(s) for s in found], np.int64)
                has = np.flatnonzero(size)
                h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                bands: list = [None] * n
                registers: list = [None] * n
                if len(has):
                    every = np.concatenate([found[i] for i in has])
                    starts = np.concatenate(([0], np.cumsum(size[has])))[:-1]
                    h1[has] = np.add.reduceat(tx.mix(every ^ tx.U(0x5851F42D4C957F2D)), starts)
                    h2[has] = np.add.reduceat(tx.mix(every * tx.U(0xDA942042E4DD58B5)), starts)
                    k = sketch.of_sets(every, starts)
                    for i, keys, row in zip(has, sketch.bands(k).view(np.int64), k, strict=True):
                        bands[i], registers[i] = keys, row.tobytes()
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, n).cast(pa.int64()), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(registers, pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "bands", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNED)


def _likely(pairs: DataFrame, signed: DataFrame, sketch: Sketch, share: float) -> DataFrame:
    """Pairs (a, b) whose estimate lies within six standard errors of the threshold or above it."""
    least = share - 6 * float(np.sqrt(share * (1 - share) / sketch.registers))
    side = lambda k: signed.select(F.col("node").alias(k), F.col("registers").alias(f"r{k}"), F.col("n_shingles").alias(f"n{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") >= share * F.greatest("na", "nb") - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, sketch.registers) for c in ("ra", "rb"))
            j = sketch.estimate(x, y, *(batch.column(c).to_numpy().astype(float) for c in ("na", "nb")))
            keep = pa.array(j >= least)
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return joined.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= percent * |A or B| on their full sets."""
    side = lambda k: full.select(F.col("node").alias(k), F.col("set").alias(f"s{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, set): the sorted shingle hashes of the documents whose sets stand in ``nodes(node, n_shingles, h1, h2)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in tx.chunks(batch.column("text")):
                found = tx.sets(data, offsets, words)
                yield pa.record_batch([batch.column("doc_id").slice(at, n).cast(pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "set"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(run, "node long, set binary").filter("length(set) > 0")


def _rare_first(full: DataFrame) -> np.ndarray:
    """How many of the sets hold a shingle of each of ``COUNTERS`` hash buckets: a fixed-size table for the order of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column("set").to_pylist()), np.uint64)
            total += np.bincount((every >> tx.U(64 - COUNTER_BITS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    summed = full.select("set").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def by_prefix(full: DataFrame, unsettled: DataFrame, percent: int) -> DataFrame:
    """Every pair of ``unsettled(node, component, minor)`` in different components, one of them minor, that may reach ``percent``.

    Sets that similar share a shingle among the first |x| - ceil(percent * |x|) + 1 of each, in any order of shingles. With the
    rarest first, near copies offer what sets them apart, and what is left behind the first shared shingle must suffice for
    the overlap asked for. What the smaller set of a pair has left must suffice for a partner of its own size already, so
    only such rows are offered on its side: pages that share a template just below the threshold offer none of its
    shingles, and their pairs are never made.
    """
    own = full.join(unsettled, "node")
    counters = full.sparkSession.sparkContext.broadcast(_rare_first(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counters.value
        for batch in batches:
            if not batch.num_rows:
                continue
            first, size = [], []
            for x in batch.column("set"):
                x = np.frombuffer(x.as_py(), np.uint64)
                keep = len(x) - -(-percent * len(x) // 100) + 1
                first.append(x[np.lexsort((x, often[(x >> tx.U(64 - COUNTER_BITS)).astype(np.int64)]))[:keep]])
                size.append(len(x))
            rows = np.repeat(np.arange(batch.num_rows), [len(f) for f in first])
            at = pa.array(rows)
            left = np.array(size)[rows] - np.concatenate([np.arange(len(f)) for f in first])
            yield pa.record_batch(
                [pa.array(np.concatenate(first).view(np.int64)), *(batch.column(c).take(at) for c in ("node", "component", "minor")), pa.array(np.array(size)[rows]), pa.array(left)],
                ["shingle", "node", "component", "minor", "size", "left"],
            )

    rows = table(own.select("node", "set", "component", "minor").mapInArrow(run, "shingle long, node long, component long, minor boolean, size long, left long"), "prefixes")
    small = rows.filter((100 + percent) * F.col("left") >= 2 * percent * F.col("size"))
    x = lambda df: df.select("shingle", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("size").alias("sx"), F.col("left").alias("lx"))
    y = lambda df: df.select("shingle", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("size").alias("sy"), F.col("left").alias("ly"))
    # from the first shingle that a pair shares on, both must hold enough for the overlap that the threshold asks for
    enough = (100 + percent) * F.least("lx", "ly") >= percent * (F.col("sx") + F.col("sy"))
    once = (F.col("cx") != F.col("cy")) & ((F.col("sx") < F.col("sy")) | (F.col("sx") == F.col("sy")) & (F.col("x") < F.col("y"))) & enough
    found = x(small.filter("minor")).join(y(rows), "shingle").filter(once).union(x(small.filter("NOT minor")).join(y(rows.filter("minor")), "shingle").filter(once))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def unsettled(met: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component, minor) of the members of bands ``met(band, node)`` that lie in several components of ``found(node, component)``.

    All but a band's largest component are minor. In a band of two, the only pair has been looked at.
    """
    labelled = met.select("band", "node").distinct().join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    counted = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = counted.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("members")).filter("parts > 1 AND members > 2").select("band", "main")
    return table(labelled.join(main, "band").groupBy("node", "component").agg(F.max(F.col("component") != F.col("main")).alias("minor")), "unsettled")


def by_hub(full: DataFrame, met: DataFrame, due: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of an unsettled band with the band's hub: the member whose shingles are the commonest.

    Of many copies with an edit each, the text without edits is near all the others, which are not near one another.
    """
    own = full.select("node", "set").join(due, "node")
    counters = full.sparkSession.sparkContext.broadcast(_rare_first(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.log2(1.0 + counters.value)
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("set")]
            central = [weight[(x >> tx.U(64 - COUNTER_BITS)).astype(np.int64)].mean() for x in sets]
            yield pa.record_batch([batch.column("node"), pa.array(central, pa.float64())], ["node", "central"])

    central = own.select("node", "set").mapInArrow(run, "node long, central double").withColumnRenamed("node", "_node")
    known = due.join(central, F.col("node") == F.col("_node")).select("node", "component", "central")
    members = table(met.select("band", "node").distinct().join(known, "node"), "members")
    hub = members.groupBy("band").agg(F.max_by(F.struct("node", "component"), F.struct("central", "node")).alias("hub"), F.countDistinct("component").alias("parts"), F.count("*").alias("n")).filter("parts > 1 AND n > 2")
    pairs = members.join(hub, "band").filter(F.col("component") != F.col("hub.component"))
    return pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def by_minima(full: DataFrame, met: DataFrame, due: DataFrame, minima: int = 4) -> DataFrame:
    """Pairs (a, b) of the members of an unsettled band that share one further minimum, each with one of them for each minimum:
    work in proportion to the members, where a band holds many that are nearly as alike as asked for."""
    rng = np.random.default_rng(23)
    add, mul = rng.integers(0, 1 << 63, minima, dtype=np.uint64), rng.integers(0, 1 << 63, minima, dtype=np.uint64) * tx.U(2) + tx.U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("set")]
            least = [np.array([((x ^ a) * m).min() for a, m in zip(add, mul, strict=True)]).view(np.int64) for x in sets]
            yield pa.record_batch([batch.column("node"), pa.array(least, pa.list_(pa.int64()))], ["_node", "minima"])

    own = full.select("node", "set").join(due.select("node"), "node", "left_semi").mapInArrow(run, "_node long, minima array<long>")
    known = due.join(own, F.col("node") == F.col("_node")).select("node", "component", F.posexplode("minima").alias("nth", "least"))
    members = table(met.select("band", "node").distinct().join(known, "node"), "members")
    first = members.groupBy("band", "nth", "least").agg(F.min_by(F.struct("node", "component"), F.struct(F.xxhash64("node", "nth"), "node")).alias("p"), F.count("*").alias("n")).filter("n > 1")
    pairs = members.join(first, ["band", "nth", "least"]).filter(F.col("component") != F.col("p.component"))
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def settled(met: DataFrame, found: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``found(node, component)`` after further links within the bands ``met(band, node)``: each step proposes pairs of what is
    :func:`unsettled`, and ``check`` keeps the links among them."""
    for pairs in steps:
        due = unsettled(met, found)
        if not due.take(1):
            return found
        more = table(check(pairs(due)), "more-links")
        if more.take(1):
            stars = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
            found = table(components(stars.union(more)), "components")
        drop(due, more)
    return found


def near_duplicates(docs: DataFrame, percent: int = 85, sketch: Sketch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``.

    ``percent`` is the least Jaccard similarity of a link, in hundredths.
    """
    sketch = sketch or Sketch()
    share = percent / 100
    signed = table(signatures(docs, sketch), "signed")
    key = ["n_shingles", "h1", "h2"]
    # documents of equal sets are one class, whose smallest doc_id stands for it
    real = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = table(real.groupBy(*key).agg(F.min("doc_id").alias("node")), "classes")
    on_key = [*key, "node"]
    nodes = table(real.withColumnRenamed("doc_id", "node").join(classes, on_key, "left_semi").dropDuplicates(on_key), "nodes")
    # a doc_id that comes with several sets links their classes
    twice = real.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("n > 1 AND lo <> hi").select("doc_id")
    if twice.take(1):
        same_id = real.join(twice, "doc_id", "left_semi").join(classes, key).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    else:
        same_id = signed.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)

    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = table(banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("band", "pivot"), "bands")
    met = table(banded.join(shared, "band").select("band", "pivot", "node"), "met")
    meeting = table(met.select("node").distinct(), "meeting")
    held = table(nodes.join(meeting, "node", "left_semi").select("node", "n_shingles", "registers"), "registers")
    full = table(_full_sets(docs, meeting, sketch.words).dropDuplicates(["node", "set"]), "full")

    # first each member of a band against its smallest
    pairs = met.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = table(confirmed(_likely(pairs, held, sketch, share), full, percent).union(same_id), "links")
    found = table(components(links), "components")
    found = settled(met, found, [lambda due: by_prefix(full, due, percent)], lambda pairs: confirmed(_likely(pairs, held, sketch, share), full, percent))

    of_class = table(classes.join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("component")), "labels")
    out = signed.select("doc_id", *key).join(of_class, key, "left")
    component = F.coalesce("component", "doc_id")
    drop(nodes, shared, met, meeting, held, full, links)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op4_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL for the same rows: all pairs that share a shingle, and reachability.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)),
link AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, k.b FROM reach r JOIN link k ON r.seen = k.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = node
"""
