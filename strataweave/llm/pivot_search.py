"""Exact top-k inner products through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. The index is dealt by range of that key, so a
partition holds whole runs of annuli and equal vectors may spread over several; each is packed into blocks that know their distance
range and their longest vector. Neighbouring partitions form at most ``SLABS`` slabs, and the blocks of a slab and a pivot
a group. The driver holds the groups' bounds (``SLABS + PIVOTS`` rows at most) and neither vectors nor queries.

Queries are rows. Each first visits the groups of the best bounds until these hold enough vectors, which gives it a
threshold; then it visits the groups that ``score <= (|q|^2 + |v|^2 - d(q, v)^2) / 2`` with
``d(q, v) >= |d(q, p) - d(v, p)|`` and ``score <= |q| |v|`` don't rule out, and of their blocks those that the same
bounds leave. Queries travel in blocks too, one for each group that some of its queries visit, so a visit is a product of
two matrices, and what travels grows with the queries times a constant. Vectors travel as the narrowest integers that
hold all of them.

Defined cases. Vectors that are null, empty, or hold a null or non-finite component take no part, as query or candidate;
neither do those with a null id or (against a query) another length. Rows that share the query's id aren't its
candidates; repeated candidate rows each count, repeated query rows count once for each different vector. No rows: no rows. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import drop, table

#: Pivots, slabs of the index at most, vectors of a block, and queries of one.
PIVOTS, SLABS, BLOCK, QUERIES = 64, 128, 2048, 2048


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """(id, v, dim): floor(scale * x) of each component, for the vectors that take part. Sums of their products are exact
    in double precision as long as they stay below 2**53."""
    x = F.col(vector_column)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"), F.size(x).alias("dim"))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T), 0))


def _kinds(top: float, dim: int) -> tuple[type, type]:
    """(what holds components of up to ``top``, what holds every sum of ``dim`` of their products) without rounding."""
    return np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64, np.float32 if dim * top * top <= 1 << 24 else np.float64


def index(rows: DataFrame, pivots: np.ndarray, held: type) -> DataFrame:
    """Blocks (group, pivot, low, high, norm, n, ids, matrix) of up to ``BLOCK`` vectors of one pivot, near in distance, by id."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"), batch.num_rows)
                d = _distances(m, pivots)
                near = d.argmin(1)
                yield pa.record_batch([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), batch.column("id"), pa.array([x.tobytes() for x in m.astype(held)], pa.binary())], ["pivot", "dist", "id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = TaskContext.get().partitionId() * SLABS // parts if parts > SLABS else TaskContext.get().partitionId()
        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), batch.num_rows]
            out: list[tuple] = []
            m, ids, dist = np.frombuffer(b"".join(batch.column("v").to_pylist()), held).reshape(batch.num_rows, -1), batch.column("id").to_numpy(), batch.column("dist").to_numpy()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for i in range(a, b, BLOCK):
                    j = min(b, i + BLOCK)
                    by_id = i + np.argsort(ids[i:j], kind="stable")
                    norm = float((m[i:j].astype(np.float64) ** 2).sum(1).max() ** 0.5)
                    out.append((slab * PIVOTS + int(pivot[i]), int(pivot[i]), float(dist[i:j].min()), float(dist[i:j].max()), norm, j - i, ids[by_id].tobytes(), m[by_id].tobytes()))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["group", "pivot", "low", "high", "norm", "n", "ids", "matrix"])

    key = table(rows.select("id", "v").mapInArrow(keyed, "pivot int, dist double, id long, v binary"), "keyed")
    dealt = key.repartitionByRange(parts, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    return dealt.mapInArrow(packed, "group long, pivot int, low double, high double, norm double, n int, ids binary, matrix binary")


def _bounds(d: np.ndarray, qn: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(queries, annuli): the highest inner product that a vector of an annulus may have, with room for rounding, for
    queries of distances ``d`` to the pivots and lengths ``qn``."""
    d, qn = d[:, pivot], qn[:, None]
    gap = np.maximum(np.maximum(low[None, :] - d, d - high[None, :]), 0)
    return np.minimum((qn**2 + norm[None, :] ** 2 - gap**2) / 2, qn * norm[None, :]) + 1e-6 * (1 + qn * norm[None, :])


Groups = tuple[np.ndarray, ...]


def _sent(due: DataFrame, pivots: np.ndarray, groups: Groups, held: type, k: int, again: bool) -> DataFrame:
    """Blocks (group, nth, qid, least, q) of the queries ``due(nth, id, v, least)`` for every group that they visit first, or then."""
    shared = due.sparkSession.sparkContext.broadcast((pivots, groups))
    names = ["group", "nth", "qid", "least", "q"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, (group, pivot, low, high, norm, count) = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                m = _matrix(some.column("v"), some.num_rows)
                bound = _bounds(_distances(m, p), np.sqrt((m * m).sum(1)), pivot, low, high, norm)
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(count[order], axis=1) - count[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before <= k, 1)  # the query itself may be among them
                least = some.column("least").fill_null(-np.inf).to_numpy()
                goes = ~first & (bound >= least[:, None]) if again else first
                columns = [some.column("nth").to_numpy(), some.column("id").to_numpy(), least, m.astype(held)]
                visited = np.flatnonzero(goes.any(0))
                for i in range(0, len(visited), 16):
                    cut = visited[i : i + 16]
                    yield pa.record_batch([pa.array(group[cut], pa.int64()), *(pa.array([c[goes[:, g]].tobytes() for g in cut], pa.binary()) for c in columns)], names)

    return due.select("nth", "id", "least", "v").mapInArrow(send, "group long, nth binary, qid binary, least binary, q binary")


def _top(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each row, ties to the smaller id, as (row, score, id, place in the row)."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], score[order][keep], ids[order][keep], place[keep]


def _visited(sent: DataFrame, blocks: DataFrame, pivots: np.ndarray, held: type, summed: type, k: int) -> DataFrame:
    """(nth, query_id, vec_id, score): of each block of queries and group that meet, the best ``k`` that reach a query's threshold."""
    shared = blocks.sparkSession.sparkContext.broadcast(pivots)
    # both sides hold matrices, whose sizes Spark can't guess: neither may be gathered on the driver for a broadcast
    joined = sent.join(blocks.hint("merge"), "group").select("group", "nth", "qid", "least", "q", "pivot", "low", "high", "norm", "ids", "matrix")
    names = ["nth", "query_id", "vec_id", "score"]

    def told(nth: np.ndarray, qid: np.ndarray, best: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        at, col = np.nonzero(best > -np.inf)
        return pa.record_batch([pa.array(nth[at]), pa.array(qid[at]), pa.array(ids[at, col]), pa.array(best[at, col].astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda c, kind, r=r, batch=batch: np.frombuffer(batch.column(c)[r].as_buffer(), kind)
                key = (batch.column("group")[r].as_py(), batch.column("nth")[r].as_buffer().to_pybytes())
                if key != now:  # the rows of one block of queries follow each other
                    if now is not None:
                        yield told(nth, qid, best, ids)
                    now, nth, qid, least = key, np.frombuffer(key[1], np.int64), cell("qid", np.int64).copy(), cell("least", np.float64).copy()
                    q = cell("q", held).reshape(len(nth), -1).astype(np.float64)
                    d, qn = _distances(q, shared.value), np.sqrt((q * q).sum(1))
                    q = q.astype(summed)
                    best, ids = np.full((len(nth), k), -np.inf), np.zeros((len(nth), k), np.int64)
                live = np.flatnonzero(_bounds(d, qn, *(np.array([batch.column(c)[r].as_py()]) for c in ("pivot", "low", "high", "norm")))[:, 0] >= least)
                if not len(live):
                    continue
                cand = cell("ids", np.int64)
                score = q[live] @ cell("matrix", held).reshape(len(cand), -1).astype(summed).T
                for i in np.flatnonzero(np.isin(qid[live], cand)):
                    score[i, cand == qid[live[i]]] = -np.inf
                high = score.max(1)
                some = np.flatnonzero((high >= least[live]) & (high > -np.inf))
                if not len(some):
                    continue
                score, live = score[some], live[some]
                cut = np.maximum(least[live], np.partition(score, -k, axis=1)[:, -k] if k < len(cand) else -np.inf)
                at, col = np.nonzero((score >= cut[:, None]) & (score > -np.inf))
                s = score[at, col].astype(np.float64)
                # of those at the cut itself the first k by id are enough
                tie = s == cut[at]
                nth_tie = np.cumsum(tie)
                before = np.concatenate(([0], nth_tie))[np.searchsorted(at, at)]
                few = ~tie | (nth_tie - before <= k)
                old, place = np.nonzero(best[live] > -np.inf)
                row, s, c, place = _top(np.concatenate([at[few], old]), np.concatenate([s[few], best[live[old], place]]), np.concatenate([cand[col[few]], ids[live[old], place]]), k)
                best[live[row], place], ids[live[row], place] = s, c
                least[live] = np.maximum(least[live], best[live, -1])
        if now is not None:
            yield told(nth, qid, best, ids)

    return joined.mapInArrow(run, "nth long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    of_query = Window.partitionBy("nth", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of every row that ``queries`` holds for, against all rows."""
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = quantised(vectors, id_column, vector_column, scale)
    asked = quantised(vectors.filter(queries), id_column, vector_column, scale).distinct()
    tops = rows.groupBy("dim").agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("top"))
    for dim, top in asked.select("dim").distinct().join(tops, "dim").orderBy("dim").collect():  # vectors of one length at a time
        held, summed = _kinds(top, dim)
        own = rows.filter(F.col("dim") == dim)
        # a bounded sample by hash: the pivots shape the speed, never the result
        pivots = np.array([r.v for r in own.orderBy(F.xxhash64("id", "v"), "id").select("v").limit(PIVOTS).collect()])
        blocks = table(index(own, pivots, held), "blocks")
        bounds = blocks.groupBy("group").agg(F.min("pivot"), F.min("low"), F.max("high"), F.max("norm"), F.sum("n")).orderBy("group").collect()
        groups = tuple(np.array(c) for c in zip(*bounds, strict=True))
        due = table(asked.filter(F.col("dim") == dim).select("id", "v").withColumn("nth", F.monotonically_increasing_id()), "queries")
        visited = lambda due, again, own=(pivots, groups, held, summed, blocks): _best(_visited(_sent(due, own[0], own[1], own[2], k, again), own[4], own[0], own[2], own[3], k), k).drop("rank")
        first = table(visited(due.withColumn("least", F.lit(None).cast("double")), False), "first")
        known = first.groupBy("nth").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).filter(F.col("n") == k).select("nth", "least")
        then = visited(due.join(known, "nth", "left"), True)
        out = out.union(table(_best(first.union(then), k).select("query_id", "rank", "vec_id", "score"), "found"))
        drop(blocks, due, first)
    return out


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: DuckDB SQL for the same rows: every pair, by brute force.
OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
