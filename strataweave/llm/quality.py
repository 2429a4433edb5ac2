"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the whole text. Trees are grown on a bounded sample of labelled rows, on at most 64 quantile
bins a statistic, with the logistic loss; a fitted model is five flat arrays, and a batch of documents walks all trees
level by level in numpy.

Defined cases. Null or empty text: statistics of an empty text, scored like any other. Null doc_id: no label, held_out
false. Several labels of one document: different ones count each. Several rows of one doc_id: one of them is learnt from. No labelled rows: every score is ``PRIOR``. No rows: no rows.
Extra columns are ignored by :func:`scored` and kept by :func:`accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

#: Labelled rows that a model is fitted on at most (chosen by hash), and the score where there are none.
SAMPLE, PRIOR = 40_000, 0.5
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "punct", "symbol", "pipe", "bang", "high", "control",
    "white", "line_length", "short_lines", "repeated_lines", "repeated_words", "repeated_triples", "word_spread", "all_upper_words",
    "symbol_words", "digit_words", "sentence_ends", "commas", "repeated_bytes", "byte_entropy", "top_word",
)

_CLASS = np.zeros((256, 9), bool)
for _k, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"?()-", b"#$%&*@^~<>{}[]\\/=+_`", b"|", b"!", range(128, 256), [*range(0, 9), *range(14, 32), 127])):
    _CLASS[list(_members), _k] = True


def _share_repeated(hashes: np.ndarray, owner: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of items that aren't the first of their kind in their text, share of the commonest kind)."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(new)
    run = np.diff(np.append(starts, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[starts], run)
    kinds = np.bincount(o[starts], minlength=n)
    some = np.maximum(total, 1)
    return np.where(total > 0, 1 - kinds / some, 0), top / some


def _blocks(data: np.ndarray, size: int = tx.CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(data), size):
        yield at, data[at : at + size]


def _within(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: tuple[int, ...]) -> np.ndarray:
    """(kinds, words): how many bytes of each kind a word has, block by block."""
    out, i = np.zeros((len(kinds), len(starts)), np.int64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + tx.CHUNK, side="right")))
        for at, part in _blocks(data[base : ends[j - 1]]):
            a, b = (np.clip(x[i:j] - base - at, 0, len(part)) for x in (starts, ends))
            for n, k in enumerate(kinds):
                c = np.concatenate(([0], np.cumsum(_CLASS[part, k], dtype=np.int32)))
                out[n, i:j] += c[b] - c[a]
        i = j
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, statistics) of texts that stand one after the other in ``data``. Tables of a few bytes a byte are made for a
    block at a time only, so a long text needs little more than its words."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    counts, same_byte = np.zeros(n * 256, np.int64), np.zeros(n)
    for at, part in _blocks(data):
        inside = np.clip(offsets, at, at + len(part))
        owner = np.repeat(np.arange(n), np.diff(inside))
        counts += np.bincount(owner * 256 + part, minlength=n * 256)
        if at:
            same_byte[owner[0]] += data[at] == data[at - 1]
        same_byte += np.bincount(owner[1:], part[1:] == part[:-1], n)
    counts = counts.reshape(n, 256)
    share = (counts @ _CLASS) / some[:, None]
    white = counts[:, tx.WHITE].sum(1) / some
    p = counts / some[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    starts, ends, who = tx.words(data, offsets)
    words = np.bincount(who, minlength=n)
    w = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(who, length, n) / w
    spread = np.sqrt(np.maximum(np.bincount(who, length**2, n) / w - mean**2, 0))
    hashes = tx.hashed(data, starts, ends)
    repeated, top = _share_repeated(hashes, who, n, words)
    if len(hashes) > 2:
        same = np.flatnonzero(who[2:] == who[:-2])
        triple = tx.mix(hashes[same] * tx.U(3) + hashes[same + 1] * tx.U(5) + hashes[same + 2] * tx.U(7))
        triples, _ = _share_repeated(triple, who[same], n, np.maximum(words - 2, 0))
    else:
        triples = np.zeros(n)
    upper, lower, digit, symbol, pipe, bang = _within(data, starts, ends, (0, 1, 2, 4, 5, 6))
    shouted = np.bincount(who, (upper > 1) & (lower == 0), n) / w
    symbols = np.bincount(who, (symbol + pipe + bang) > 0, n) / w
    digits = np.bincount(who, digit > 0, n) / w

    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets[:-1], breaks + 1, offsets[1:]]))
    a, b = edges[:-1], edges[1:]
    line_of = np.searchsorted(offsets, a, side="right") - 1
    lines = np.bincount(line_of, minlength=n)
    long_ = np.maximum(lines, 1)
    line_length = (b - a).astype(float)
    stop = b - (data[np.maximum(b - 1, 0)] == 10) if len(b) else b
    again, _ = _share_repeated(tx.hashed(data, a, np.maximum(stop, a)), line_of, n, lines) if len(a) else (np.zeros(n), None)
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, share, white, np.bincount(line_of, line_length, n) / long_, np.bincount(line_of, line_length < 30, n) / long_,
        again, repeated, triples, spread, shouted, symbols, digits, (counts[:, 46] + counts[:, 63]) / w, counts[:, 44] / w, same_byte / some, entropy, top,
    ])


@dataclass(frozen=True)
class Model:
    """Trees of ``depth`` levels: node i of tree t has children 2 i + 1 and 2 i + 2, and its leaves stand in ``leaves[t]``."""

    depth: int
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.features.shape[1]
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Model:
    """Boosted trees on histograms of gradients and curvatures. Ties of a split's gain go to the earlier statistic and bin."""
    if not len(y):
        return Model(0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), float(np.log(PRIOR / (1 - PRIOR))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    share = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    inner, n_features = 2**depth - 1, x.shape[1]
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            sums = np.empty((2, n_features, wide, bins))
            for f in range(n_features):
                at = local * bins + binned[:, f]
                sums[0, f] = np.bincount(at, g, wide * bins).reshape(wide, bins)
                sums[1, f] = np.bincount(at, h, wide * bins).reshape(wide, bins)
            left = sums.cumsum(3)
            whole = left[:, :, :, -1:]
            right = whole - left
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            gain[(left[1] < least) | (right[1] < least)] = 0
            flat = gain.transpose(1, 0, 2).reshape(wide, -1)
            best = flat.argmax(1)
            for k in range(wide):
                f, b = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-9 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        score += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Model(depth, np.array(features), np.array(thresholds), np.array(leaves), start)


def _measured(docs: DataFrame, columns: list[str], schema: str, model: Model | None) -> DataFrame:
    """``columns`` of ``docs`` and, at the end, the statistics (without a model) or the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the trees alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for at, n, data, offsets in tx.chunks(batch.column("text")):
                x = statistics(data, offsets)
                made = pa.array(list(x), pa.list_(pa.float64())) if fitted is None else pa.array(fitted.scores(x))
                yield pa.record_batch([*(batch.column(c).slice(at, n) for c in columns), made], [*columns, "made"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.quality``, from the labelled documents that aren't held out; of more than ``sample``, those with the smallest hashes."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    known = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # at most ``sample`` rows of two numbers, so the texts stay where they are
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    made = _measured(rows.withColumn("hash", F.xxhash64("text")), ["doc_id", "quality", "hash"], "doc_id long, quality double, hash long, made array<double>", None)
    # of rows that share a doc_id one is learnt from, so no more than ``sample`` rows are gathered
    got = made.groupBy("doc_id", "quality").agg(F.min(F.struct("hash", "made")).alias("m")).select("doc_id", "quality", "m.made").toArrow()
    x = np.array(got["made"].to_pylist(), float).reshape(-1, len(STATISTICS))
    y = got["quality"].to_numpy()
    order = np.lexsort((*x.T[::-1], y, got["doc_id"].to_numpy()))  # rows arrive in any order
    return grow(x[order], (y[order] > 0.5).astype(float))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _measured(slim, ["doc_id"], "doc_id long, made double", model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("made").alias("score"), (F.col("made") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    text = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in tx.chunks(batch.column(text)):
                keep = shared.value.scores(statistics(data, offsets)) >= threshold
                yield batch.slice(at, n).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op2_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
