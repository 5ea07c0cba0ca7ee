"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets of similar length.  A first
pass over the bucket of the longest vectors gives each query a score that its
k-th best has at least.  With it a bucket's local threshold is a cosine: above 1
the bucket is skipped; otherwise the bucket is pruned by length (the vectors long
enough) or by the query's strongest coordinate (the range that a vector's unit
coordinate must lie in), whichever leaves fewer, and what is left is verified by
exact products.

The buckets stay where they are.  Queries travel to them in blocks, in batches of
a bounded size; a task skips the blocks that its bucket can't answer, raises a
query's threshold with what it has found, and sends on its best k per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, session_defaults

#: Vectors in a bucket and queries in a block, at most; vectors per range of lengths; bytes of queries that travel at once, about.
BUCKET, QUERIES, RANGE, QUERY_BYTES = 4096, 256, 8192, 64 << 20
SCALE = 256
#: Products of integers below this are exact in doubles.
EXACT = 2.0**53


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (as it is), norm of its integers, for the rows that take part."""
    kind = dict(df.dtypes)[vector_col]
    v = F.col(vector_col).cast("array<float>" if kind == "array<float>" else "array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate(integers("v"), F.lit(0.0), lambda a, x: a + x * x)))


def integers(column: str):
    """Components x as floor(SCALE x), in doubles."""
    return F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(x * SCALE).cast("double"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """block, dim, longest, ids, vectors: up to ``size`` vectors of one dimension, longest first, packed as doubles.  Blocks are numbered in the order of the partitions."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim, most):
            nonlocal number
            ids, v = (np.concatenate(x) for x in zip(*held[dim], strict=True))
            held[dim] = [(ids[most:], v[most:])]
            ids, v = ids[:most], v[:most]
            norm = np.sqrt((v * v).sum(1))
            by = np.lexsort((ids, -norm))
            row = [[part << 24 | number], [dim], [float(norm.max())], [ids[by].tobytes()], [v[by].tobytes()]]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["block", "dim", "longest", "ids", "vectors"])

        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[own], flat[starts[own][:, None] + np.arange(dim)]))
                while sum(len(x) for x, _ in held[dim]) >= size:
                    yield flush(dim, size)
        for dim, own in held.items():
            if sum(len(x) for x, _ in own):
                yield flush(dim, size)

    return rows.select("vec_id", "v").mapInArrow(run, "block long, dim int, longest double, ids binary, vectors binary")


class Bucket:
    """A block of vectors, longest first."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.v = np.frombuffer(vectors, float).reshape(len(self.ids), dim)
        self.norm = np.sqrt((self.v * self.v).sum(1))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit coordinates in order, and the order."""
        if f not in self.lists:
            x = self.v[:, f] / np.where(self.norm > 0, self.norm, 1.0)
            by = np.argsort(x)
            self.lists[f] = (x[by], by)
        return self.lists[f]

    def products(self, rows, q: np.ndarray) -> np.ndarray:
        v = self.v[rows]
        if self.norm[0] * np.sqrt((q * q).sum()) < EXACT:
            return (v @ q).astype(np.int64)
        own = [int(x) for x in q]
        return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(row, own, strict=True)))) for row in v], np.int64)

    def search(self, query: int, q: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the best k of the block that are at least ``least``, best first, ties to the smaller id."""
        own = float(np.sqrt((q * q).sum()))
        rows: slice | np.ndarray = slice(None)
        slack = 1 - 1e-9
        if least > 0 and own > 0 and len(self.ids):
            cosine = least / (own * self.norm[0]) * slack if self.norm[0] > 0 else 2.0
            if cosine > 1:
                return self.ids[:0], np.zeros(0, np.int64)
            long = int(np.searchsorted(-self.norm, -(least / own) * slack, "right"))
            rows = slice(0, long)
            f = int(np.argmax(np.abs(q)))
            unit = q[f] / own
            spread = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - unit * unit)))
            low, high = cosine * unit - spread, cosine * unit + spread
            if unit >= cosine:
                high = 1.0
            if unit <= -cosine:
                low = -1.0
            x, by = self.by_coordinate(f)
            a, b = np.searchsorted(x, low - 1e-9, "left"), np.searchsorted(x, high + 1e-9, "right")
            if 2 * (b - a) < long:
                rows = by[a:b]
        ids, score = self.ids[rows], self.products(rows, q)
        good = (score >= least) & (ids != query)
        ids, score = ids[good], score[good]
        if len(ids) > k:
            top = score >= np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[top], score[top]
        by = np.lexsort((ids, -score))[:k]
        return ids[by], score[by]


def unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vectors, float).reshape(len(own), dim)


def bounds(asked: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """block, dim, ids, vectors, least, reach: query blocks with what each query's k-th best has at least, from the longest bucket, and the length that a bucket must have to answer any."""
    longest = buckets.join(buckets.groupBy("dim").agg(F.min("block").alias("block")), ["dim", "block"], "left_semi").select("dim", F.col("ids").alias("b_ids"), F.col("vectors").alias("b_vectors"))
    size = longest.agg(F.sum(F.length("b_vectors"))).first()[0] or 0

    def run(batches):
        for batch in batches:
            out = []
            for dim, ids, vectors, b_ids, b_vectors in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "vectors", "b_ids", "b_vectors")), strict=True):
                own, q = unpacked(ids, vectors, dim)
                bucket, least = Bucket(b_ids, b_vectors, dim), np.full(len(own), -np.inf)
                for i in range(len(own)):
                    score = bucket.search(int(own[i]), q[i], -np.inf, k)[1]
                    if len(score) == k:
                        least[i] = score[-1]
                norm = np.sqrt((q * q).sum(1))
                need = np.where((least > 0) & (norm > 0), least / np.where(norm > 0, norm, 1.0) * (1 - 1e-9), -1.0)
                out.append((least.tobytes(), float(need.min())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "dim", "ids", "vectors")), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.float64())], ["block", "dim", "ids", "vectors", "least", "reach"])

    # every query is a candidate of others, so there is a bucket for its dimension
    both = asked.join(F.broadcast(longest) if size <= QUERY_BYTES else longest, "dim")
    return both.mapInArrow(run, "block long, dim int, ids binary, vectors binary, least binary, reach double")


def verified(buckets: DataFrame, queries, k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of a task's buckets for each query.  ``queries``: a broadcast list of (dim, ids, vectors, least, reach)."""

    def run(batches):
        asked = [(dim, *unpacked(ids, vectors, dim), np.frombuffer(least, float).copy(), reach) for dim, ids, vectors, least, reach in queries.value]
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, length, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("dim", "longest", "ids", "vectors")), strict=True):
                bucket = None
                for n, (own_dim, own, q, least, reach) in enumerate(asked):
                    if own_dim != dim or length < reach:
                        continue
                    bucket = bucket or Bucket(ids, vectors, dim)
                    for i in range(len(own)):
                        found, score = bucket.search(int(own[i]), q[i], least[i], k)
                        if not len(found):
                            continue
                        if (n, i) in best:
                            found, score = np.r_[best[n, i][0], found], np.r_[best[n, i][1], score]
                            by = np.lexsort((found, -score))[:k]
                            found, score = found[by], score[by]
                        best[n, i] = found, score
                        if len(score) == k:
                            least[i] = max(least[i], score[-1])
        rows = [(int(asked[n][1][i]), f, s) for (n, i), both in best.items() for f, s in zip(*(x.tolist() for x in both), strict=True)]
        for at in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + 100_000], strict=True)], ["query_id", "vec_id", "score"])

    return buckets.select("dim", "longest", "ids", "vectors").mapInArrow(run, "query_id long, vec_id long, score long")


def top_products(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the ``k`` best other rows, ties to the smaller id.

    Components x count as floor(256 x).  Rows with a null id, and vectors that
    are null or hold null or non-finite components, take no part; vectors of
    different dimension have no product.  Rows that repeat an id are separate
    candidates of others, and one query each with the same answers removed.
    Products beyond 64 bits are held at the bound.  An empty table gives no rows;
    other columns than the two are not read.
    """
    spark = df.sparkSession
    session_defaults(spark)
    rows = usable(df, id_col, vector_col)
    # ids break ties of length, so that a common length does not fall into one range
    ranged = rows.repartitionByRange(max(4, -(-rows.count() // RANGE)), F.desc("norm"), F.col("vec_id"))
    buckets = materialize(blocks(ranged.sortWithinPartitions(F.desc("norm"), "vec_id"), BUCKET))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("own", integers("v")).dropDuplicates(["vec_id", "own"])
    asked = materialize(bounds(blocks(queries.select("vec_id", "v"), QUERIES), buckets, k))
    size = asked.agg(F.sum(F.length("vectors") + F.length("ids"))).first()[0] or 0
    batches = max(1, -(-size // QUERY_BYTES))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for n in range(batches):
        part = asked.where(F.pmod(F.xxhash64("block"), F.lit(batches)) == n).select("dim", "ids", "vectors", "least", "reach")
        travelling = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about QUERY_BYTES
        found = verified(buckets, travelling, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if batches > 1:  # a query is in one batch only, so these are its final rows
            found = materialize(found)
            travelling.destroy()
        out = found if out is None else out.unionByName(found)
    discard(asked)
    return out


def op4_topk(spark, sf_dir) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.c::DOUBLE[], d.c::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.c) = len(d.c)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
