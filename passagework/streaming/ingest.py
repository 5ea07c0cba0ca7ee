"""A file stream of documents that keeps an index of chunks up to date.

Each micro-batch skips the documents that are indexed already, cuts the others
and appends their chunks; a batch that is replayed after a failure finds its own
documents indexed and appends nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..sources import tables


def index_batch(documents: DataFrame, index_path: str, chunk: Callable[[DataFrame], DataFrame]) -> None:
    spark = documents.sparkSession
    documents = documents.dropDuplicates(["doc_id"])
    try:
        documents = tables.new_documents(documents, spark.read.parquet(index_path))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    tables.checkpointed(chunk(documents)).write.mode("append").parquet(index_path)


def ingest(spark: SparkSession, source: str, schema: str, index_path: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000):
    """Start the stream over what is there and return its query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, _: index_batch(batch, index_path, chunk))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
