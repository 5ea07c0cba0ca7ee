import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagework.operators import diagnostics, models
from passagework.plans import pipeline
from passagework.plans.pipeline import Component, Settings

DOCS = [(1, "The ferry left the harbour late. Fog kept it waiting."), (2, "Bakery revenue rose again in autumn. Bread was cheap."), (3, "A mayor opened the harbour bridge. The ferry was there.")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    settings = Settings(chunker=Component("sentence", {"size": 6}))
    assert pipeline.ingest(docs.where("doc_id < 3"), settings, path) == {"documents": 2, "chunks": 4}
    assert pipeline.ingest(docs, settings, path) == {"documents": 1, "chunks": 2}
    return docs, spark.read.parquet(f"{path}/rows"), path


def asked(spark):
    return spark.createDataFrame([("q1", "Why was the ferry late?"), ("q2", "Did bakery revenue rise, and was the price of the bread cheap?")], "question_id string, question string")


@pytest.mark.parametrize("settings", [
    Settings(top_k=2),
    Settings(retriever=Component("sparse", {"stopwords": True, "stems": True, "k1": 0.8, "b": 1.0}), top_k=2, reranker=Component("overlap"), context=Component("assembler", {"order": "edges"})),
    Settings(retriever=Component("dense"), top_k=2, query_transform=Component("clauses"), context=Component("assembler", {"budget": 20, "mmr_weight": 0.7, "pool": 4})),
    Settings(top_k=2, query_transform=Component("decompose"), routing=models.Routing(retrieve_with="both", rerank_with="both", combine="round_robin", rerank_combine="max"), reranker=Component("overlap")),
    Settings(top_k=2, retriever=Component("hybrid", {"method": "minmax", "weights": (0.3, 0.7)}), query_transform=Component("multi_query")),
    Settings(top_k=2, query_transform=Component("hyde")),
])
def test_ask(spark, index, settings):
    docs, rows, _ = index
    got = {r["question_id"]: r for r in pipeline.ask(asked(spark), docs, rows, settings).collect()}
    assert got.keys() == {"q1", "q2"}
    assert "ferry" in got["q1"]["passages"] and "read" in got["q2"]["passages"]


def test_evaluate(spark, index):
    _, rows, _ = index
    gold = spark.createDataFrame([("q1", 0, 1, 0, 32), ("q2", 0, 2, 0, 36)], "question_id string, span_no int, doc_id int, start_char int, end_char int")
    got = {(r[0], r[1]): r[2] for r in pipeline.evaluate(asked(spark), gold, rows, Settings(retriever=Component("sparse"), top_k=3)).collect()}
    assert got[("q1", "recall@5")] == 1.0 and got[("q2", "mrr")] == 0.5


def test_settings(spark, index, tmp_path):
    assert Settings.load('{"top_k": 3, "chunker": {"name": "fixed", "params": {"size": 4}}}').chunker.params == {"size": 4}
    with pytest.raises(ValueError):
        Settings.load('{"topk": 3}')
    with pytest.raises(KeyError):
        pipeline.registry.make("chunker", "none")
    with pytest.raises(ValueError):
        pipeline.registry.add("chunker", "fixed", None)
    with pytest.raises(pipeline.tables.IndexMismatch):
        pipeline.ingest(index[0], Settings(), index[2])
    with pytest.raises(ValueError):
        pipeline.registry.make("retriever", "hybrid", method="sum")
    assert Settings.load('{"retriever": "sparse", "context": {"name": "assembler", "params": {"pool": 9}}}').pool == 9
    assert spark.read.json(f"{index[2]}/ingest").agg(F.sum("documents"), F.sum("chunks")).first()[:] == (3, 6)
    with pytest.raises(PermissionError):
        pipeline.guard_split("data/questions_test_final.jsonl")
    assert [pipeline.run_name("a"), pipeline.run_name("a", "gold", 2), pipeline.run_name("a", "guesser")] == ["a", "a-gold-r2", "guesser"]
    scores = spark.createDataFrame([("q", "m", 1.0)], "question_id string, metric string, value double")
    pipeline.save_run(scores, str(tmp_path / "r"), Settings(), answered=True)
    with pytest.raises(FileExistsError):
        pipeline.save_run(scores, str(tmp_path / "r"), Settings())


def test_models(spark):
    requests = spark.createDataFrame([("s", "u" * 300), ("s", "u" * 300), ("s", "v")], "system string, user string")
    got = models.generate(requests).collect()
    assert sorted(len(r["reply"]) for r in got) == [1, 200, 200] and not any(r["cached"] for r in got)
    cache = requests.where("user = 'v'").select(models.request_key("echo", F.col("system"), F.col("user")).alias("key"), F.lit("known").alias("reply"))
    assert [r["reply"] for r in models.generate(requests, cache=cache).where("cached").collect()] == ["known"]
    silent = lambda s, u: pd.Series([""] * len(u))
    assert {r["role"] for r in models.transform(asked(spark), "rewrite", silent).collect()} == {"original"}
    assert models.transform(asked(spark), "decompose").where("question_id = 'q2'").count() == 3
    with pytest.raises(ValueError):
        models.Routing(combine="sum")
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id int, turn int, role string, text string")
    assert {r["turn"]: r["question"] for r in models.standalone(turns).collect()} == {0: "a", 2: "c"}
    rows = spark.createDataFrame([("q", "w", f"c{i}", i, f"t{i}") for i in (1, 2, 3)], "question_id string, question string, chunk_id string, rank int, text string")
    assert [r["chunk_id"] for r in models.listwise(rows).orderBy("new_rank").collect()] == ["c2", "c1", "c3"]


def test_answers(spark):
    rows = spark.createDataFrame(
        [("a", "inference", "Spotify", "spotify", None, True, True), ("b", "null_query", "Insufficient information", "Insufficient information.", True, None, None), ("c", "inference", "Insufficient information", "Yes", None, None, False), ("d", "inference", "A long answer", "Other", None, False, True)],
        "question_id string, question_type string, answer string, reference string, judge_correct boolean, judge_faithful boolean, full_support boolean",
    )
    got = {(r[0], r[1]): r[2] for r in models.answer_scores(rows).collect()}
    assert got[("a", "correct")] == 1.0 and got[("d", "correct")] == 0.0 and got[("d", "judged")] == 1.0
    assert got[("b", "abstain_null")] == 1.0 and ("b", "false_abstain") not in got and got[("b", "judge_agrees_with_match")] == 1.0
    assert got[("c", "false_abstain_without_support")] == 1.0 and ("c", "faithful") not in got


def test_diagnostics(spark):
    ranks = spark.createDataFrame([(1, None, 0.5), (2, 3, 0.25), (None, None, 0.0), (1, 99, 0.7)], "first int, second int, overlap double")
    assert {r["found"]: (r["spans"], r["median_overlap"]) for r in diagnostics.found_by(ranks, 10).collect()} == {"first only": (2, 0.6), "both": (1, 0.25), "neither": (1, 0.0)}
    run = lambda *v: spark.createDataFrame(list(enumerate(v)), "question_id int, value double")
    compared = diagnostics.three_way(run(1.0, 0.0, 0.5), run(0.0, 1.0, 0.5), run(0.5, 1.0, 0.5))
    assert {r["question_id"]: r["winner"] for r in compared.collect()} == {0: "first", 1: "second", 2: "tie"} and diagnostics.fusion_losses(compared).count() == 1
    grid = spark.createDataFrame([(i, i / 10, v) for i, vs in enumerate([(0.0, 1.0), (1.0, 1.0), (1.0, 1.0)]) for v in vs], "ordinal int, k double, value double")
    assert diagnostics.best_setting(grid, ["k"]).first()["ordinal"] == 1
    lists = spark.createDataFrame([("q", "a", 1, 2.0), ("q", "b", 2, 1.0)], "question_id string, key string, rank int, score double")
    other = spark.createDataFrame([("q", "b", 1, 2.0), ("q", "a", 2, 1.0)], lists.schema)
    assert diagnostics.parity(lists, other).first().asDict() == {"questions": 1, "same_scores": 1, "same_set": 1, "same_order": 0}
    assert spark.range(1).select(diagnostics.term_overlap(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("a"))).alias("x")).first()["x"] == 0.5
