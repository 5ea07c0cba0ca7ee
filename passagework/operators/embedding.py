"""Embedders as an interface, with prefixes, batches, a cache and cut dimensions.

An embedder's ``call`` maps a list of texts to a matrix.  Each distinct text that
the cache lacks is embedded once, at full width; cutting comes after the cache.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import dense
from .chunking import hashed_vectors

KINDS = ("query", "document")


@dataclass(frozen=True)
class Embedder:
    """``cut``: leading dimensions that are kept; ``longest``: characters that the model reads, if it cuts its input."""

    model: str
    dimensions: int
    call: Callable[[list[str]], np.ndarray]
    query_prefix: str = ""
    document_prefix: str = ""
    cut: int | None = None
    batch: int = 100
    longest: int | None = None

    def __post_init__(self):
        if self.cut is not None and not 0 < self.cut <= self.dimensions:
            raise ValueError(f"cut is {self.cut}; the model has {self.dimensions} dimensions")

    def settings(self) -> dict:
        return {k: v for k, v in asdict(replace(self, call=None)).items() if k not in ("call", "batch")}

    def prefixed(self, text: Column, kind: str) -> Column:
        if kind not in KINDS:
            raise ValueError(f"{kind}: known are {', '.join(KINDS)}")
        return F.concat(F.lit(self.query_prefix if kind == "query" else self.document_prefix), F.coalesce(text, F.lit("")))


def hashing(dimensions: int = 256, **settings) -> Embedder:
    """Counts of words by checksum; needs no model."""
    return Embedder("hashing", dimensions, lambda texts: hashed_vectors(texts, dimensions), **settings)


def ordered(answer: list[tuple[int, list[float]]], n: int) -> np.ndarray:
    """Vectors of a client's reply, (index, vector) in any order, in the order of what was asked."""
    found = dict(answer)
    if sorted(found) != list(range(n)):
        raise ValueError(f"asked for {n} vectors, got {len(answer)}")
    return np.array([found[i] for i in range(n)])


def pick_device() -> str:
    """Where a worker's model should run: what ``PASSAGEWORK_DEVICE`` says, else a GPU if torch is there and sees one."""
    if os.environ.get("PASSAGEWORK_DEVICE"):
        return os.environ["PASSAGEWORK_DEVICE"]
    try:
        import torch
    except ImportError:
        return "cpu"
    if torch.backends.mps.is_available():
        return "mps"
    return "cuda" if torch.cuda.is_available() else "cpu"


def cache_rows(rows: DataFrame, embedder: Embedder, text: Column, kind: str) -> DataFrame:
    """``rows`` with key (of model and prefixed text) and input."""
    own = rows.withColumn("input", embedder.prefixed(text, kind))
    return own.withColumn("key", tables.cache_key(F.lit(embedder.model), F.lit(str(embedder.dimensions)), F.col("input")))


def embedded(rows: DataFrame, id_col: str, text: Column, embedder: Embedder, kind: str = "document", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, vector for every row; the cache's new rows: key, vector).  A null text is embedded as the empty one."""
    call, batch, width = embedder.call, embedder.batch, embedder.dimensions

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        asked = texts.tolist()
        made = [np.asarray(call(asked[i : i + batch]), float) for i in range(0, len(asked), batch)]
        if any(m.shape[1] != width for m in made):
            raise ValueError(f"the model gave {made[0].shape[1]} dimensions, not {width}")
        return pd.Series([v.tolist() for m in made for v in m])

    keyed = cache_rows(rows.select(id_col, text.alias("_text")), embedder, F.col("_text"), kind)
    compute = lambda missing: missing.select("key", vector("input").alias("vector"))
    if cache is None:
        fresh = compute(keyed.dropDuplicates(["key"]))
        found = keyed.join(fresh, "key")
    else:
        found, fresh = tables.through_cache(keyed, cache.select("key", "vector"), compute)
    own = dense.unit(F.col("vector"), embedder.cut) if embedder.cut else F.col("vector")
    return found.select(id_col, own.alias("vector")), fresh


def truncated_inputs(rows: DataFrame, embedder: Embedder, text: Column, kind: str = "document") -> DataFrame:
    """One row: inputs, truncated (those that are longer than the model reads)."""
    long = F.length(embedder.prefixed(text, kind)) > (embedder.longest if embedder.longest is not None else 2**31 - 1)
    return rows.agg(F.count("*").alias("inputs"), F.count_if(long).alias("truncated"))


def seeded_cache(index: DataFrame, embedder: Embedder, kind: str = "document") -> DataFrame:
    """Cache rows (key, vector) from an index (text, vector) of the same model; one of cut vectors is refused."""
    if embedder.cut is not None:
        raise ValueError("cut vectors can't be cached: the cache holds whole ones")
    rows = cache_rows(index, embedder, F.col("text"), kind).dropDuplicates(["key"])
    return checked(rows, embedder.dimensions).select("key", "vector")


def checked(rows: DataFrame, dimensions: int) -> DataFrame:
    """``rows`` with a vector of just ``dimensions``; any other one is an error when the row is read."""
    wrong = F.raise_error(F.concat(F.lit("a vector has "), F.size("vector").cast("string"), F.lit(f" dimensions, not {dimensions}")))
    return rows.withColumn("vector", F.when(F.size("vector") == dimensions, F.col("vector")).otherwise(wrong.cast(dict(rows.dtypes)["vector"])))


def added(store: DataFrame | None, chunks: DataFrame, vectors: DataFrame, dimensions: int, key: str = "chunk_id") -> DataFrame:
    """The store with new chunks and their unit vectors; as many vectors as chunks, all of ``dimensions``, or it is an error."""
    n, m = chunks.count(), vectors.count()
    both = chunks.join(vectors.select(key, "vector"), key)
    if n != m or both.count() != n:
        raise ValueError(f"{n} chunks and {m} vectors don't belong together")
    fresh = checked(both, dimensions).withColumn("vector", dense.unit(F.col("vector")))
    return fresh if store is None else store.unionByName(fresh)
