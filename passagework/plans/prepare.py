"""From raw files to a corpus, question splits and a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset
from ..sources import tables


@dataclass(frozen=True)
class Preparation:
    """Sizes of the splits, the largest share of one evidence cluster, and the seed."""

    dev_size: int
    test_size: int
    answer_subset_size: int
    max_cluster_share: float = 0.25
    seed: str = "0"


def spans_of(questions: DataFrame) -> DataFrame:
    """question_id, span: each gold span as one text."""
    rows = questions.select("question_id", F.explode("evidence").alias("s"))
    return rows.select("question_id", F.concat_ws(":", *[F.col(f"s.{c}").cast("string") for c in ("doc_id", "start_char", "end_char")]).alias("span"))


def prepare(spark: SparkSession, corpus: str, questions: str, out: str, settings: Preparation) -> dict:
    """Write documents, the splits, the excluded questions and manifest.json under ``out``; the manifest is returned.

    A question with evidence that can't be found is excluded.  Dev and test share no
    gold span; the manifest says so from the written rows.
    """
    documents = tables.raw_documents(spark, corpus)
    flat = documents.select("doc_id", "text", "metadata.url", "metadata.title", F.col("doc_id").alias("ordinal"))
    made, items = dataset.build_questions(tables.raw_questions(spark, questions), flat)
    made = tables.checkpointed(made)
    eligible = made.where("complete")
    clusters = dataset.clusters(spans_of(eligible), eligible.select("question_id"))
    own = tables.checkpointed(eligible.join(clusters, "question_id"))
    asked = own.select("question_id", "question_type", "cluster", (F.size("evidence") > 0).alias("has_evidence"))
    split = tables.checkpointed(dataset.evidence_split(asked, {"dev": settings.dev_size, "test": settings.test_size}, settings.max_cluster_share, settings.seed))
    dev = own.join(split.where("split = 'dev'"), "question_id")
    subset = dataset.stratified_sample(dev.select("question_id", "question_type"), "question_id", "question_type", settings.answer_subset_size, settings.seed).select("question_id", F.lit(True).alias("answer_subset"))
    placed = own.drop("complete").join(split, "question_id").join(subset, "question_id", "left").withColumn("answer_subset", F.coalesce("answer_subset", F.lit(False)))
    placed = tables.checkpointed(placed)
    tables.write_jsonl(documents, f"{out}/documents.jsonl")
    names = ("dev", "test", "pool", "test_pool")
    for name in names:
        tables.write_jsonl(placed.where(F.col("split") == name).drop("split"), f"{out}/questions_{name}.jsonl")
    tables.write_jsonl(made.where("not complete").drop("complete"), f"{out}/questions_excluded.jsonl")
    sizes = {r["split"]: r["count"] for r in placed.groupBy("split").count().collect()}
    spans = {n: spans_of(placed.where(F.col("split") == n)).join(placed.select("question_id"), "question_id").select(F.split("span", ":").alias("x")).select(*[F.col("x")[k].alias(c) for k, c in enumerate(("doc_id", "start_char", "end_char"))]) for n in ("dev", "test", "pool")}
    shares = {n: dataset.largest_share(placed.where((F.col("split") == n) & (F.size("evidence") > 0)).select("question_id", "cluster")).first()["largest_share"] for n in ("dev", "test")}
    manifest = {
        "raw_sha256": {"corpus": tables.content_hash(spark, corpus), "questions": tables.content_hash(spark, questions)},
        "seed": settings.seed,
        "documents": documents.count(),
        "questions": {n: sizes.get(n, 0) for n in names} | {"dev_answer_subset": placed.where("answer_subset").count(), "excluded": made.where("not complete").count()},
        "split_check": {
            "evidence_clusters": clusters.select("cluster").distinct().count(),
            "gold_spans_shared_by_dev_and_test": dataset.shared_gold_spans(spans["dev"], spans["test"]).count(),
            "gold_spans_shared_by_pool_and_test": dataset.shared_gold_spans(spans["pool"], spans["test"]).count(),
            "largest_cluster_share": shares,
        },
        "mapping": dataset.build_report(made, items).first().asDict(),
    }
    spark.createDataFrame([(json.dumps(manifest, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest.json")
    return manifest
