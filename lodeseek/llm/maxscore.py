"""Exact top-k by integer inner product, with MaxScore over dimensions as query terms.

The table is read where it lies, in shards of at most `shard_rows` vectors, and is never shuffled. Query rows are packed into
blocks of about `block_rows`; one block at a time is broadcast, and a job of its own takes it over all shards, so the largest objects
in a task are a shard and a block, at any input size. A query begins with a threshold: its k-th best score among the
block's own vectors, which are candidates like any others. A task carries its queries' thresholds from shard to shard,
and a query skips a shard whose upper bound stays under its threshold. For a query and a shard
each dimension j has a posting array (the shard's column) and bounds lo_j <= q_j * x_j <= hi_j from the column's
extremes. Dimensions are ordered by hi - lo. Those whose ranges, summed from the end, cannot lift a candidate over the
current threshold are non-essential: the essential columns are traversed for the whole shard, the others are probed
step by step for candidates that can still reach the threshold. Tasks give their best k + 1 (the query's own row may
be among them), and these are merged by query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import col, cut

_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id long, v array<double>): floor(scale * x) of the rows that take part (id and vector non-null, all components finite)."""
    x = col(vec_col)
    whole = col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.filter(whole).select(col(id_col).cast("long").alias("id"), x.alias("x"))
    return kept.select("id", F.transform("x", lambda e: _floor(e.cast("double") * scale)).alias("v"))


def _floor(x):
    """floor as a double: beyond 2**53 a double is whole already, and F.floor would give a bounded long."""
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as a matrix, short ones ended in zeros) of at most `rows` rows."""
    for batch in batches:
        ids, vectors = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
        for at in range(0, len(ids), rows):
            some = vectors.slice(at, rows).to_numpy(zero_copy_only=False).tolist()
            matrix = np.zeros((len(some), max(map(len, some))))
            for row, v in zip(matrix, some):
                row[: len(v)] = v
            yield ids[at : at + rows], matrix


def _packed(frame: DataFrame, rows: int, k: int) -> DataFrame:
    """(part, blob): blocks of queries with their first thresholds, each the k-th best score among the block's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for ids, q in _chunks(_joined(batches, rows), rows):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps((ids, q, first_floors(q, k)), 5)], pa.binary())], names=["part", "blob"])
            part += 1

    return frame.mapInArrow(run, "part long, blob binary")


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def first_floors(q: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th best inner product with all rows, -inf where there are fewer, or where sums may be inexact."""
    if len(q) < k or float(np.abs(q).max(initial=0)) ** 2 * q.shape[1] >= _EXACT:
        return np.full(len(q), -np.inf)
    return np.concatenate([np.partition(q[at : at + 256] @ q.T, len(q) - k, axis=1)[:, len(q) - k] for at in range(0, len(q), 256)])


def _dot(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles: in float64 where no sum can pass 2**53, else in Python's integers."""
    if a.size == 0 or float(np.abs(a).max()) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < _EXACT:
        return a @ q
    whole = [int(y) for y in q]
    return np.array([sum(int(x) * y for x, y in zip(r, whole)) for r in a.tolist()], object)


def best(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, floor: float = -np.inf, step: int = 8, shard: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a shard for one query (score falling, id rising), all that reach floor among them."""
    width = min(len(q), x.shape[1])
    q, x = q[:width], x[:, :width]
    low, high, top = shard or bounds(x)
    if not width or top * float(np.abs(q).max(initial=0)) * width >= _EXACT:
        return _first(ids, _dot(x, q), k)
    a, b = q * low[:width], q * high[:width]
    lo, span = np.minimum(a, b), np.abs(b - a)
    order = np.argsort(-span, kind="stable")
    left = np.concatenate((np.cumsum(span[order][::-1])[::-1], [0.0]))  # what the dimensions from here on can add to their lower bounds
    base, n = lo.sum(), len(ids)
    essential = int(np.searchsorted(-left, -(floor - base), side="left")) if floor > -np.inf else max(1, width // 2)
    essential = min(width, max(1, essential))
    got = x[:, order[:essential]] @ q[order[:essential]] + lo[order[essential:]].sum()
    if floor == -np.inf and n > k:  # a threshold from the rows that lead so far
        lead = np.argpartition(-got, k - 1)[:k]
        floor = (x[lead] @ q).min()
    alive = np.flatnonzero(got + left[essential] >= floor)
    got = got[alive]
    for at in range(essential, width, step):
        if not len(alive):
            break
        some = order[at : at + step]
        got = got + x[np.ix_(alive, some)] @ q[some] - lo[some].sum()
        if len(got) > k:
            floor = max(floor, -np.partition(-got, k - 1)[k - 1])  # got is a lower bound of each score
        keep = got + left[min(width, at + step)] >= floor
        alive, got = alive[keep], got[keep]
    return _first(ids[alive], got, k)


def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    if not x.size:
        return np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0
    return x.min(axis=0), x.max(axis=0), float(np.abs(x).max())


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k and score.dtype != object:
        near = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
        ids, score = ids[near], score[near]
    order = np.lexsort((ids, -score)) if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])), np.int64)
    order = order[:k]
    return ids[order], score[order]


class Running:
    """The k best candidates so far of each query of a block, and the thresholds that they set."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.q, self.floors, self.k = ids, q, floors.copy(), k
        self.got: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(ids)

    def take(self, ids: np.ndarray, x: np.ndarray) -> int:
        """Takes a shard over all queries that may find something there; gives their number."""
        low, high, top = known = bounds(x)
        width = min(x.shape[1], self.q.shape[1])
        q = self.q[:, :width]
        reach = np.full(len(q), np.inf)
        if top * float(np.abs(q).max(initial=0)) * max(1, width) < _EXACT:
            reach = np.maximum(q, 0) @ high[:width] + np.minimum(q, 0) @ low[:width]
        some = np.flatnonzero(reach >= self.floors)
        for at in some.tolist():
            near, score = best(ids, x, self.q[at], self.k, self.floors[at], shard=known)
            if len(near):
                before, scores = self.got[at]
                near, score = np.concatenate((before, near)), np.concatenate((scores.astype(score.dtype), score))
                self.got[at] = near, score = _first(near, score, self.k)
                if len(near) == self.k and score.dtype != object:
                    self.floors[at] = max(self.floors[at], score[-1])
        return len(some)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, shard_rows: int = 2048, block_rows: int = 4096) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: the k best other rows of each row whose id is divisible by `every`.

    Rows with a null id, or a vector that is null or holds a null or non-finite component, take no part. Vectors of
    unlike length are compared as if the shorter ended in zeros (an empty vector scores 0). Ties go to the smaller id.
    Of repeated rows each is a query, and a candidate for all but itself. Fewer candidates than k: all. No rows: no rows.
    """
    frame = quantised(vectors, id_col, vec_col, scale)
    asked = frame.filter(F.pmod("id", F.lit(every)) == 0)
    asked = asked.repartition(max(1, -(-asked.count() // block_rows)))  # in turn, so of even sizes whatever ids repeat
    blocks = cut(_packed(asked, 2 * block_rows, k + 1))
    parts = [r["part"] for r in blocks.select("part").orderBy("part").collect()]  # one number for each block_rows queries
    out = "part long, at int, query_id long, vec_id long, score long, self double"
    found = vectors.sparkSession.createDataFrame([], out)
    for n, part in enumerate(parts):
        block = vectors.sparkSession.sparkContext.broadcast(bytes(blocks.filter(F.col("part") == part).select("blob").first()["blob"]))
        one = frame.mapInArrow(_over_shards(block, part, k + 1, shard_rows), out)
        found = found.unionByName(one if len(parts) == 1 else cut(one))
    query = Window.partitionBy("part", "at").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(query)).filter(F.col("r") <= k + 1)
    # One row is the query's own: its id, and its score with itself. Exactly one such row goes.
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score").cast("double") == F.col("self"))
    first = F.min(F.when(own, F.col("r"))).over(Window.partitionBy("part", "at"))
    found = found.withColumn("own", F.coalesce(first, F.lit(k + 2))).filter(F.col("r") != F.col("own"))
    rank = F.col("r") - F.when(F.col("r") > F.col("own"), 1).otherwise(0)
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _over_shards(block, part: int, k: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, floors = pickle.loads(block.value)
        running = Running(own, q, floors, k)
        for ids, x in _chunks(_joined(batches, shard_rows), shard_rows):
            running.take(ids, x)
        whole = lambda s: min(2**63 - 1, max(-(2**63), int(s)))
        rows = [(part, at, own[at], i, whole(s), min(2.0**63, float(q[at] @ q[at]))) for at, (ids, score) in enumerate(running.got) for i, s in zip(ids.tolist(), score.tolist())]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=["part", "at", "query_id", "vec_id", "score", "self"])

    return run
