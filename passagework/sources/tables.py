"""Corpora, indexes, runs and caches as files that Spark reads and writes."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = ("title", "source", "author", "category", "published_at", "url")
DOCUMENT = "doc_id STRING, text STRING, metadata STRUCT<" + ", ".join(f"{m}: STRING" for m in METADATA) + ">"
SPAN = "STRUCT<doc_id: STRING, start_char: INT, end_char: INT>"
QUESTION = f"question_id STRING, text STRING, answer STRING, question_type STRING, evidence ARRAY<{SPAN}>, cluster STRING, answer_subset BOOLEAN"
RAW_ARTICLE = "body STRING, " + ", ".join(f"{m} STRING" for m in METADATA)
RAW_QUESTION = "query STRING, answer STRING, question_type STRING, evidence_list ARRAY<STRUCT<url: STRING, title: STRING, fact: STRING>>"


_folders: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share and read again, so that an iteration's lineage ends there.

    The folder is ``spark.checkpoint.dir``; only a local session may go without.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not folder:
        folder = _folders.setdefault(application, "") or f"file://{tempfile.mkdtemp(prefix='passagework-')}"
        _folders[application] = folder
    path = f"{folder.rstrip('/')}/passagework/{application}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._passagework_path = path
    return out


def dropped(*written: DataFrame | None) -> None:
    """Delete tables that ``checkpointed`` wrote and that no result reads any more."""
    for df in written:
        path = getattr(df, "_passagework_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = 2048, size: int = 32 << 20) -> None:
    """Bound the session's Arrow batches, so that a batch of long texts fits in a worker; smaller bounds stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        own = spark.conf.get(key)
        if not (own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(key, str(most))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines or Parquet, by the path's ending."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(DOCUMENT).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path)


def evidence(questions: DataFrame) -> DataFrame:
    """question_id, span_no, doc_id, start_char, end_char."""
    rows = questions.select("question_id", F.posexplode("evidence").alias("span_no", "s"))
    return rows.select("question_id", "span_no", "s.doc_id", "s.start_char", "s.end_char")


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of articles -> documents numbered in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in RAW_ARTICLE.split(','))}>>").alias("a"))
    rows = whole.select(F.posexplode("a").alias("n", "x"))
    return rows.select(F.format_string("doc_%04d", "n").alias("doc_id"), F.col("x.body").alias("text"), F.struct(*[F.col(f"x.{m}").alias(m) for m in METADATA]).alias("metadata"))


def raw_questions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of questions, with question_id ``q_0000`` in file order."""
    fields = RAW_QUESTION.replace("query STRING, answer STRING, question_type STRING, evidence_list ", "query: STRING, answer: STRING, question_type: STRING, evidence_list: ")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"ARRAY<STRUCT<{fields}>>").alias("a"))
    rows = whole.select(F.posexplode("a").alias("n", "x"))
    return rows.select(F.format_string("q_%04d", "n").alias("question_id"), "x.*")


def read_labels(spark: SparkSession, path: str, column: str = "human") -> DataFrame:
    """A CSV sheet; y, yes, 1, true and n, no, 0, false count, in any case; other rows go."""
    said = F.lower(F.trim(F.col(column)))
    value = F.when(said.isin("y", "yes", "1", "true"), True).when(said.isin("n", "no", "0", "false"), False)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("label", value).where("label is not null")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all runs under ``path``/<run>/questions.jsonl with the run's name."""
    rows = spark.read.json(f"{path.rstrip('/')}/*/questions.jsonl")
    return rows.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """Files as documents: ``upload_`` and eight digits of the content's checksum; bytes that are no UTF-8 are replaced."""
    rows = spark.read.format("binaryFile").load(path)
    digest = F.substring(F.sha2("content", 256), 1, 8)
    return rows.select(F.concat(F.lit("upload_"), digest).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """run, group, metric, mean, low, high, n with four decimals."""
    rounded = [F.format_string("%.4f", c).alias(c) if c in ("mean", "low", "high") else F.col(c) for c in df.columns]
    df.select(*rounded).write.mode("overwrite").option("header", True).csv(path)


def fingerprint(settings: dict) -> str:
    """Checksum of the settings that an index depends on."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


class IndexMismatch(ValueError):
    """An index was made with other settings."""


def save_index(df: DataFrame, path: str, settings: dict, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(fingerprint(settings), json.dumps(settings, sort_keys=True))], "fingerprint string, settings string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_index(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    there = spark.read.schema("fingerprint string, settings string").json(f"{path}/meta").first()
    if there is None or there["fingerprint"] != fingerprint(settings):
        raise IndexMismatch(f"{path} was made with {there and there['settings']}")
    return spark.read.parquet(f"{path}/rows")


def stamp(chunks: DataFrame, settings: dict, key: str = "chunk_id") -> dict:
    """What saved postings were made from: the settings, and the chunks' number and a checksum of their ids (in any order)."""
    one = chunks.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.col(key).cast("string")).cast("decimal(38,0)")).alias("ids")).first()
    return {"settings": settings, "chunks": one["n"], "chunk_ids": str(one["ids"] or 0)}


def postings_for(chunks: DataFrame, path: str, settings: dict, build, key: str = "chunk_id", files: int = 8) -> DataFrame:
    """The saved postings (key, term, tf, length) of these chunks, or those that ``build()`` makes now, saved in the order of terms.

    Each setting has its own folder.  Postings of other chunks than these are stale
    and are replaced.  Ordered files let a reader skip what its terms can't be in.
    """
    spark, folder = chunks.sparkSession, f"{path.rstrip('/')}/{fingerprint(settings)[:12]}"
    now = stamp(chunks, settings, key)
    try:
        there = spark.read.schema("stamp string").json(f"{folder}/meta").first()
        if there and json.loads(there["stamp"]) == now:
            return spark.read.parquet(f"{folder}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().repartitionByRange(files, "term").sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{folder}/rows")
    spark.createDataFrame([(json.dumps(now),)], "stamp string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")
    return spark.read.parquet(f"{folder}/rows")


def content_hash(spark: SparkSession, path: str) -> str:
    """The files' sha256; of several, that of their hashes in the order of their names."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()
    return rows[0]["h"] if len(rows) == 1 else hashlib.sha256("".join(r["h"] for r in rows).encode()).hexdigest()


def cache_key(*parts):
    """Checksum of what a result depends on, as a column."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Each distinct key that the cache lacks, once."""
    return wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def through_cache(wanted: DataFrame, cache: DataFrame, compute, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(``wanted`` with the cached columns, new cache rows); ``compute`` sees each missing key once."""
    fresh = compute(misses(wanted, cache, key))
    return wanted.join(cache.unionByName(fresh), key), fresh


def new_documents(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """Those whose doc_id the index lacks."""
    return documents.join(indexed.select("doc_id").distinct(), "doc_id", "left_anti")


def persist_fresh(fresh: DataFrame, path: str) -> None:
    """Append new cache rows to the cache's table."""
    fresh.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache's table, a key once; empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path).dropDuplicates(["key"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def spliced(text: str, begin: str, end: str, body: str) -> str | None:
    """``text`` with what stands between two markers replaced; None if a marker is missing."""
    head, found, rest = text.partition(begin)
    _, closed, tail = rest.partition(end)
    return f"{head}{begin}\n{body}\n{end}{tail}" if found and closed else None


def sheet(rows: list[dict]) -> str:
    """Rows as CSV text."""
    out = io.StringIO()
    if rows:
        writer = csv.DictWriter(out, list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
    return out.getvalue()
