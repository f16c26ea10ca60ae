"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are packed, where they are scanned, into blocks of at most ``BLOCK``
rows. A block's index keeps, per dimension, its postings sorted by value and cut
into segments of equal quantised value. For a query a segment's impact is the
largest contribution it can make above the dimension's smallest one; segments
are processed by descending impact over all dimensions. Between rounds two
bounds hold for each vector: what it has, and that plus the impacts still open.
Processing stops once some vectors are proved out and scoring all others in full
costs less than the postings left; exactly these are scored in full, so the result
never depends on where it stops.

Before any posting is read, the k-th score of the longest vectors is a threshold
that the bounds are held against; segments are then read in ``STEPS`` portions,
with a look at the bounds after each.

Queries come in blocks of at most ``QUERIES`` rows; ``QUERY_ROUND`` blocks at a
time (a bounded size) are broadcast against all vector blocks. Each round is a job
that appends to one table, so no plan grows with the number of queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import materialize, shared_dir, table

BLOCK = 8192
QUERIES = 256
QUERY_ROUND = 16
LEVELS = 32
STEPS = 8
READ_COST = 8  # components scored in full at the cost of one posting
SEEDS = 256  # longest vectors that give the first threshold
PACKED = "dim int, ids binary, vectors binary"


def integer_vectors(df: DataFrame, vector: str, scale: float = 1024.0) -> DataFrame:
    """Replace ``vector`` by floor(scale * x); rows that are null or hold null or non-finite components are dropped."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).withColumn(
        vector, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int, ids: list, vectors: list) -> pa.RecordBatch:
            values = [np.array(ids, "<i8").tobytes(), np.array(vectors, "<i8").tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], names=["dim", "ids", "vectors"])

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(key)
                vectors.append(vector)
                if len(ids) == rows:
                    yield out(len(vector), *held.pop(len(vector)))
        for dim, (ids, vectors) in held.items():
            yield out(dim, ids, vectors)

    return run


class ImpactIndex:
    """The impact-ordered index of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if np.unique(ids).size < ids.size:  # a repeated row counts once
            both = np.unique(np.column_stack([ids, vectors]), axis=0)
            ids, vectors = both[:, 0], both[:, 1:]
        self.ids, self.x = ids, vectors
        self.n, self.dim = vectors.shape
        self.peak = int(np.abs(vectors).max(initial=0))
        self.read = self.postings = 0  # by all searches, and what they could have read
        if not self.dim:
            return
        self.longest = np.argsort(-np.square(vectors.astype(float)).sum(1), kind="stable")[:SEEDS]
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int64)
        self.value = np.take_along_axis(vectors.T, self.order, 1)
        low, high = self.value[:, :1], self.value[:, -1:]
        self.above, self.below = (self.value - low).astype(np.float64), (self.value - high).astype(np.float64)
        step = np.maximum((high - low) // LEVELS + 1, 1)
        level = (self.value - low) // step
        # starts[d, l]: first posting of dimension d with level >= l
        self.starts = np.stack([np.searchsorted(row, np.arange(LEVELS + 1)) for row in level])

    def _segments(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Impacts (descending along each dimension) and postings up to and with each segment."""
        first, last = self.starts[:, :-1], np.maximum(self.starts[:, 1:] - 1, 0)
        top, bottom = np.take_along_axis(self.value, last, 1), np.take_along_axis(self.value, np.minimum(first, self.n - 1), 1)
        up = (q > 0)[:, None]
        impact = np.where(up, (q[:, None] * (top - self.value[:, :1]))[:, ::-1], q[:, None] * (bottom - self.value[:, -1:]))
        ends = np.where(up, (self.n - first)[:, ::-1], self.starts[:, 1:])
        sizes = np.diff(ends, axis=1, prepend=0)
        # an empty segment has the impact of the next one
        impact = np.where(sizes > 0, impact, -1)
        impact = np.maximum.accumulate(impact[:, ::-1], axis=1)[:, ::-1]
        return np.maximum(impact, 0), ends

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k highest other than ``own``."""
        others = self.ids != own
        if self.dim == 0 or self.n <= 4 * k or self.peak * int(np.abs(q).max(initial=0)) * self.dim >= 1 << 52:
            possible = np.flatnonzero(others)
        else:
            possible = self._possible(q, others, k)
        x = self.x[possible]
        if self.peak * int(np.abs(q).max(initial=0)) * max(1, self.dim) >= 1 << 62:
            scores = x.astype(object) @ q.astype(object)
        else:
            scores = x @ q
        best = np.lexsort((self.ids[possible], -scores))[:k] if scores.dtype != object else np.array(
            sorted(range(len(scores)), key=lambda i: (-scores[i], self.ids[possible[i]]))[:k], int)
        return self.ids[possible[best]], scores[best]

    def _possible(self, q: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
        impact, ends = self._segments(q)
        flat = np.sort(impact, axis=None)[::-1]
        done, acc = np.zeros(self.dim, np.int64), np.zeros(self.n)
        # accumulators begin at what a vector has at least: every component at its dimension's worst end
        least = float(np.where(q > 0, q * self.value[:, 0], q * self.value[:, -1]).sum())
        seeds = self.longest[others[self.longest]]
        floor = np.partition(self.x[seeds] @ q, -k)[-k] - least if seeds.size >= k else -np.inf
        possible = np.flatnonzero(others)
        candidates = possible.size
        for step in range(1, STEPS + 1):
            limit = flat[min(flat.size - 1, step * flat.size // STEPS)] if step < STEPS else -1
            segments = (impact > limit).sum(1)
            upto = np.where(segments > 0, np.take_along_axis(ends, np.maximum(segments - 1, 0)[:, None], 1)[:, 0], 0)
            ids, gains = [], []
            for d in np.flatnonzero(upto > done):
                a, b = done[d], upto[d]
                part = slice(self.n - b, self.n - a) if q[d] > 0 else slice(a, b)
                ids.append(self.order[d, part])
                gains.append(float(q[d]) * (self.above if q[d] > 0 else self.below)[d, part])
            if ids:
                acc += np.bincount(np.concatenate(ids), np.concatenate(gains), self.n)
            self.read += int(np.maximum(upto - done, 0).sum())
            done = np.maximum(done, upto)
            left = np.where(segments < impact.shape[1], np.take_along_axis(impact, np.minimum(segments, impact.shape[1] - 1)[:, None], 1)[:, 0], 0).sum()
            have = np.where(others, acc, -1.0)
            kth = max(floor, np.partition(have, -k)[-k])
            possible = np.flatnonzero(others & (acc + left >= kth))
            left = self.n * self.dim - int(done.sum())
            if possible.size < candidates and possible.size * self.dim <= READ_COST * left:
                break
        self.postings += self.n * self.dim
        return possible


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for dim, ids, vectors, query_ids, queries in zip(*(c.to_pylist() for c in batch.columns)):
                if last != (ids, vectors):
                    last, index = (ids, vectors), ImpactIndex(np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1 if dim else len(ids) // 8, dim))
                found: list[list] = [[], [], []]
                for query_id, q in zip(np.frombuffer(query_ids, "<i8").tolist(), np.frombuffer(queries, "<i8").reshape(-1 if dim else len(query_ids) // 8, dim)):
                    got, scores = index.search(q, query_id, k)
                    found[0] += [query_id] * len(got)
                    found[1] += got.tolist()
                    found[2] += [int(s) for s in scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Each query's k highest inner products over ``vectors`` (all, if fewer), ties to the smaller key.

    Both hold a bigint ``key`` and an array<bigint> ``vector``; rows with a null
    key are left out. A query's candidates are the rows of its own vector
    length with another key. Repeated rows (equal key and vector) count once;
    rows of one key with different vectors are candidates each. Other columns
    are not read. Empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    wanted = queries.select(key, vector).filter(F.col(key).isNotNull()).distinct()
    wanted = materialize(wanted, "topk-queries")
    n_blocks = -(-wanted.count() // QUERIES)
    if n_blocks == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rounds = -(-n_blocks // QUERY_ROUND)
    packed_queries = wanted.repartition(n_blocks, key).mapInArrow(_pack(QUERIES), PACKED)
    packed_queries = materialize(packed_queries.select(
        "dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"),
        F.pmod(F.xxhash64("ids"), F.lit(rounds)).cast("int").alias("round")), "topk-query-blocks")
    blocks = vectors.select(key, vector).filter(F.col(key).isNotNull()).mapInArrow(_pack(BLOCK), PACKED)
    if rounds > 1:
        blocks = materialize(blocks, "topk-blocks")
    path = f"{shared_dir(spark)}/topk-found-{uuid.uuid4().hex}"
    schema = "query_id long, vec_id long, score long"
    for r in range(rounds):
        some = packed_queries.filter(F.col("round") == r).drop("round")
        # at most about QUERY_ROUND * QUERIES vectors
        found = blocks.join(F.broadcast(some), "dim").select("dim", "ids", "vectors", "query_ids", "queries").mapInArrow(_search(k), schema)
        if rounds > 1:
            found.write.mode("append").parquet(path)
    if rounds > 1:
        found = spark.read.schema(schema).parquet(path)
    ranked = found.distinct().withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every vector whose id is divisible by 100."""
    rows = integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10)

