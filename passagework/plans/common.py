"""Pieces that the plans and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a scan from which it is worth dealing its rows out to idle cores.
SPREAD_BYTES = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than cores (one file with one row group, say) dealt out to all; other scans as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size >= SPREAD_BYTES and rows.rdd.getNumPartitions() < cores else rows


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asks with all terms of its text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), T.terms(F.col("text")).alias("terms"))


def terms_sql(column: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower(coalesce({column}, '')), '[''’]s\b', '', 'g'), '[\p{{L}}\p{{N}}]+')"


#: CTEs: d (doc_id, terms), q (question_id, terms), p (doc_id, term, tf, length), size, hits, scored.
BM25_CTES = f"""
d AS (SELECT doc_id, {terms_sql('text')} AS terms FROM documents),
q AS (SELECT item_id AS question_id, list_distinct({terms_sql('text')}) AS terms FROM benchmark),
long AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM long GROUP BY doc_id, term),
size AS (SELECT count(*) AS n, avg(len(terms)) AS avg_length FROM d),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term),
asked AS (SELECT question_id, unnest(terms) AS term FROM q)
"""


def bm25_sql(k1: str = "1.2", b: str = "0.75") -> str:
    return f"ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {k1} * (1 - {b} + {b} * length / avg_length))"


#: CTEs: v (vec_id, label, full unit vector u, unit vector s of the first 16 components), lists (question_id, list_no, chunk_id, score, rank).
def unit_sql(v: str) -> str:
    return f"(CASE WHEN sqrt(list_sum(list_transform({v}, lambda x: x * x))) > 0 THEN list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y)))) ELSE {v} END)"


LIST_CTES = f"""
v AS (SELECT vec_id, label, {unit_sql('embedding::DOUBLE[]')} AS u, {unit_sql('(embedding::DOUBLE[])[1:16]')} AS s FROM embeddings),
pairs AS (
  SELECT a.vec_id AS question_id, 0 AS list_no, b.vec_id AS chunk_id, list_inner_product(a.u, b.u) AS score FROM v a, v b WHERE a.vec_id % 100 = 0
  UNION ALL
  SELECT a.vec_id, 1, b.vec_id, list_inner_product(a.s, b.s) FROM v a, v b WHERE a.vec_id % 100 = 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY question_id, list_no ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM pairs),
lists AS (SELECT * FROM ordered WHERE rank <= 20)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 asks; all rows are searched."""
    return vectors(spark, sf_dir).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("question_id"), "vector")


#: CTEs: chunk (doc_id, chunk_id, start_char, end_char, text, n_tokens) as fixed windows of {size} tokens and {overlap} overlap.
def chunk_ctes(size: int, overlap: int = 0) -> str:
    step = size - overlap
    return rf"""
tok AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\s*\S+(?:\s+\z)?') AS t FROM documents),
win AS (SELECT doc_id, t, unnest(list_filter(range(0, len(t), {step}), lambda i: i = 0 OR i + {overlap} < len(t))) AS i FROM tok WHERE len(t) > 0),
chunk AS (SELECT doc_id, doc_id::VARCHAR || ':' || lpad((i // {step})::VARCHAR, greatest(4, length((i // {step})::VARCHAR))::INTEGER, '0') AS chunk_id,
  length(array_to_string(t[1:i], '')) AS start_char,
  length(array_to_string(t[1:i], '')) + length(array_to_string(t[i + 1:i + {size}], '')) AS end_char,
  array_to_string(t[i + 1:i + {size}], '') AS text, least(len(t) - i, {size}) AS n_tokens FROM win)
"""
