"""Exact dense retrieval, and embeddings without a model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of query vectors that travel to every task; more are searched in several such blocks.
QUERY_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column, dimensions: int | None = None) -> Column:
    """The first ``dimensions`` components as doubles, divided by their length; a zero vector stays zero."""
    v = vector.cast("array<double>")
    v = F.slice(v, 1, dimensions) if dimensions else v
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def usable(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """The rows with a vector that has no null component."""
    return rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull()))


def vectors_for(rows: DataFrame, store: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, vector (of length 1) of the chunks that ``rows`` names, each once; a chunk that the store lacks has none."""
    return store.join(rows.select(key).distinct(), key, "left_semi").select(key, unit(F.col("vector")).alias("vector"))


def cosine_top(queries: DataFrame, store: DataFrame, k: int, dimensions: int | None = None, key: str = "chunk_id") -> DataFrame:
    """question_id, key, score, rank by cosine; ties in the order of ``key``.

    ``queries``: question_id, vector.  ``store``: key, vector.  The queries travel
    packed to the tasks that read the store (in blocks of about QUERY_BYTES), a
    task multiplies each batch with them and sends on its k best per query, so
    the store is never shuffled.  Rows without a vector, or with a null in it, take
    no part; vectors of another dimension than the queries' are an error.
    """
    spark = store.sparkSession
    asked = usable(queries, "question_id").select("question_id", unit(F.col("vector"), dimensions).alias("v"))
    rows = usable(store, key).select(F.col(key), unit(F.col("vector"), dimensions).alias("v"))
    kind = dict(queries.dtypes)["question_id"]
    ids_type = to_arrow_type(queries.schema["question_id"].dataType)
    schema = f"question_id {kind}, {key} {dict(store.dtypes)[key]}, score double"
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("widest"), F.min(F.size("v")).alias("least")).first()
    if not size["n"]:
        return spark.createDataFrame([], f"{schema}, rank int")
    if size["widest"] != size["least"]:
        raise ValueError(f"queries have from {size['least']} to {size['widest']} dimensions")
    blocks = -(-size["n"] * 8 * max(1, size["widest"]) // QUERY_BYTES)
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), key)
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block).collect()  # about QUERY_BYTES
        travelling = spark.sparkContext.broadcast(([r[0] for r in own], np.array([r[1] for r in own], float).reshape(len(own), size["widest"])))
        found = rows.mapInArrow(_multiplier(travelling, k, key, ids_type), schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = found if out is None else out.unionByName(found)  # a question is in one block only
    return out


def _multiplier(queries, k: int, key: str, ids_type):
    def run(batches):
        ids, q = queries.value
        if not ids:
            return
        kept = [[] for _ in ids]
        keys = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).type
            names = batch.column(0).to_pylist()
            sizes = set(pc.list_value_length(batch.column(1)).to_pylist())
            if sizes != {q.shape[1]}:
                raise ValueError(f"the store has vectors of {sorted(sizes)} dimensions, the queries of {q.shape[1]}")
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            product = np.round(q @ v.T, 12)
            for i, row in enumerate(product):
                if len(row) > k:
                    limit = round(np.partition(row, len(row) - k)[len(row) - k], 9) - 1e-9
                    near = np.flatnonzero(row >= limit)
                else:
                    near = np.arange(len(row))
                kept[i] += [(-round(float(row[j]), 9), names[j], float(row[j])) for j in near]
                if len(kept[i]) > 4 * k:
                    kept[i] = sorted(kept[i])[:k]
        if keys is not None:
            out = [(ids[i], name, score) for i, own in enumerate(kept) for _, name, score in sorted(own)[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], ids_type), pa.array([x[1] for x in out], keys), pa.array([x[2] for x in out], pa.float64())], ["question_id", key, "score"])

    return run


def hashed(rows: DataFrame, key: str, text: Column, dimensions: int = 512) -> DataFrame:
    """key, bucket, weight: counts of words by crc32 modulo ``dimensions``, one row per bucket that is not empty."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    long = rows.select(key, F.explode(words).alias("word"))
    return long.groupBy(key, (F.crc32(F.col("word").cast("binary")) % dimensions).cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("weight"))
