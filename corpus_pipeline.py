"""From raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all that
the one before kept; ``run`` writes what a stage returns as Parquet and reads it
again as the next one's ``docs``.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import minhash, packing, quality, substring, toxicity
from passagework.llm.common import materialize, session_defaults

#: Column that tells rows apart while near-duplicates are looked for.
ROW = "_passagework_row"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go.

    A null or empty text has no evidence, and so stays unless the training rows
    are nearly all toxic; null ids and repeated rows are judged like any other.
    """
    session_defaults(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.training())
    return toxicity.drop_toxic(docs, model)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, and with them null, empty and very short texts; null ids and repeated rows are judged like any other."""
    session_defaults(spark)
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest doc_id (a null one is the last).

    Rows are told apart by a 64-bit hash of id and text, not by their id: of rows
    that repeat both, one stays, rows with a null id are compared like all others,
    and a doc_id with two texts is decided for each.  Rows without words all stay.
    """
    session_defaults(spark)
    rows = docs.withColumn(ROW, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    twice = materialize(rows.where(F.col("text").rlike(r"[^ \t\n\r\x0B\f]")).groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1").select(ROW))
    if not twice.isEmpty():
        first = rows.join(twice, ROW, "left_semi").groupBy(ROW).agg(F.min(F.struct(*docs.columns)).alias("first")).select("first.*", ROW)
        rows = materialize(rows.join(twice, ROW, "left_anti").unionByName(first))
    found = minhash.near_duplicates(rows, ROW).withColumnRenamed("doc_id", ROW)
    linked = found.where("n_shingles > 0").join(rows.select(ROW, "doc_id"), ROW)
    best = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("best")).select(f"best.{ROW}")
    stay = best.union(found.where("n_shingles = 0").select(ROW))
    return rows.join(stay, ROW, "left_semi").select(docs.columns)


def own_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice go from the texts; ``n_chars`` follows.

    All rows stay, null texts as they are.  A row that is there twice would lose
    its text; the stage before keeps one of such rows.
    """
    session_defaults(spark)
    out = substring.without_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences; a null or empty text is its end id alone, and null ids and repeated rows are packed like any other."""
    session_defaults(spark)
    return packing.pack(docs)


STAGES = [("toxicity", without_toxic), ("quality", of_quality), ("near_duplicates", one_of_each), ("passages", own_passages), ("packing", packed)]
#: No stage can be said in SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
