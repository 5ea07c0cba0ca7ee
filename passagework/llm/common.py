"""What the operators share: words, bounded memos, shared-folder tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that go to Python at once; texts may be long.
BATCH_ROWS = 512


def session_defaults(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, so that a batch of long texts fits in a worker; smaller bounds stay.

    Spark reads these settings when a result is computed, so they can't be put back here.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        own = spark.conf.get(key)
        if not (own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(key, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_defaults(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, as ``doc_id`` long and ``text`` string."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bucket_of(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: Groups whose sample limits travel to the tasks; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def hash_sample(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """group, key, _n: at most ``size`` keys of each group, those with the smallest hash, numbered in that order.

    The keys of a group are counted first (about), and those whose hash is not
    among the smallest 4 * size / n of a group's range are left out before any
    shuffle, so what is sorted is bounded however large a group is.  A key counts
    once, however many rows it has.  Nothing is collected.
    """
    share = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = rows.groupBy(group).agg(F.least(F.lit(1.0), 4.0 * size / F.greatest(F.lit(1), F.approx_count_distinct(key))).alias("_limit"))
    few = counts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    near = rows.select(group, key, share.alias("_share")).join(F.broadcast(counts) if few else counts, group).where("_share <= _limit").select(group, key, "_share").distinct()
    order = Window.partitionBy(group).orderBy("_share", key)
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_share")


def bounded_texts(rows: DataFrame, sample: DataFrame, on: list[str], group: str, chars: int) -> DataFrame:
    """group, the columns of ``on``, text: the texts of a ``hash_sample``, bounded in rows and in characters.

    ``rows``: the columns of ``on``, text.  Each sampled key has one text (the
    smallest, if it has several).  Of each group the texts are taken in the
    sample's order as long as they have at most ``chars`` characters together; a
    single text that is longer is passed over.
    """
    few = sample.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    own = rows.where(F.length("text").between(1, chars)).join(F.broadcast(sample) if few else sample, on)
    keys = list(dict.fromkeys([group, *on]))
    one = own.groupBy(*keys, "_n").agg(F.min("text").alias("text"))
    upto = F.sum(F.length("text").cast("long")).over(Window.partitionBy(group).orderBy("_n"))
    return one.withColumn("_upto", upto).where(F.col("_upto") <= chars).select(*keys, "text")


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: under ``spark.checkpoint.dir``; only a local session may go without, and gets one of its own."""
    application = spark.sparkContext.applicationId
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not path:
        if application not in _folders:
            _folders[application] = f"file://{tempfile.mkdtemp(prefix='passagework-')}"
        path = _folders[application]
    return f"{path.rstrip('/')}/passagework/{application}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._passagework_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and that no result reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_passagework_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Nodes of a plan that give the rows of a file in the file's order.
ORDERLY = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "SubqueryAlias", "View"}


def in_file_order(df: DataFrame) -> bool:
    """Whether a task that is run again sees the rows of ``df`` in the same order: scans, projections and filters alone."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().split(" ")[0] not in ORDERLY:
            return False
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return True


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of the plan's leaves; grows with the input and needs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Memo(dict):
    """A dict that computes what it lacks.

    With half of ``limit`` entries it becomes the older generation of a new
    one; what is used again moves back.  So frequent keys stay, and a worker's
    memory is bounded.
    """

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute, self.half, self.old = compute, limit // 2, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine (driver or executor)."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
