import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import context, dense, fusion, rerank, sparse


def lists(spark, **rows):
    data = [("q", n, c, i + 1, float(10 - i)) for n, names in enumerate(rows.values()) for i, c in enumerate(names)]
    return spark.createDataFrame(data, "question_id string, list_no int, chunk_id string, rank int, score double")


def order(df):
    return [r["chunk_id"] for r in df.orderBy("rank").collect()]


def test_bm25(spark):
    chunks = spark.createDataFrame([(0, "ferry fog"), (1, "ferry ferry late harbour"), (2, "bakery revenue rose")], "id int, text string")
    asked = spark.createDataFrame([("q", ["ferry", "ferry", "nowhere"])], "question_id string, terms array<string>")
    got = {r["id"]: r["score"] for r in sparse.search(asked, chunks, "id", T.terms(F.col("text"))).collect()}
    assert got.keys() == {0, 1}
    assert math.isclose(got[0], math.log(1.6) / 1.9) and math.isclose(got[1], math.log(1.6) * 2 / 3.5)


def test_bm25_ties_and_empty(spark):
    chunks = spark.createDataFrame([(2, "fog"), (1, "sun"), (0, "fog"), (3, None)], "id int, text string")
    asked = spark.createDataFrame([("q", ["fog"])], "question_id string, terms array<string>")
    found = sparse.search(asked, chunks, "id", T.terms(F.col("text")))
    assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 2]
    assert sparse.search(asked, chunks.limit(0), "id", T.terms(F.col("text"))).count() == 0


def test_search_is_scores_and_best(spark, monkeypatch):
    """The block product gives what the join of postings gives, for whole grids, with ties, in several parts and with stems."""
    import random

    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(300)] + [(300, None), (301, rows_text := "w1 w2 w3"), (302, rows_text)]
    chunks = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(q, rng.choices([*words, "nowhere"], k=rng.randint(0, 9))) for q in range(25)], "question_id long, terms array<string>")
    terms, grid = T.terms(F.col("text")), [(1.2, 0.75), (0.4, 1.0)]
    settings = spark.createDataFrame(grid, "k1 double, b double")
    every = sparse.scores(asked, sparse.postings(chunks, "id", terms), sparse.collection(chunks, terms), "id", settings)
    want = {(grid.index((r["k1"], r["b"])), r["question_id"], r["id"]): (r["rank"], r["score"]) for r in sparse.best(every, 7, "id", ("k1", "b", "question_id")).collect()}

    def found(**more):
        return {(r["setting"], r["question_id"], r["id"]): (r["rank"], r["score"]) for r in sparse.grid_search(asked, chunks, "id", terms, 7, grid, **more).collect()}

    for most, at_once, travel in ((4096, 512, 200_000), (6, 16, 200_000), (6, 16, 10)):
        monkeypatch.setattr(sparse, "QUESTIONS", most)
        monkeypatch.setattr(sparse, "CHUNKS", at_once)
        monkeypatch.setattr(sparse, "BROADCAST_TERMS", travel)
        got = found()
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)
    one = sparse.search(asked.limit(0), chunks, "id", terms)
    assert one.columns == ["question_id", "id", "score", "rank"] and one.count() == 0
    more = sparse.search(asked, chunks.withColumn("extra", F.col("id") * 2), "id", terms, carry=("extra",))
    assert more.columns == ["question_id", "id", "score", "rank", "extra"] and more.where("extra <> 2 * id").count() == 0 and more.count() > 0
    last = found(stem=lambda t: t[:2])
    assert last.keys() != want.keys()


def test_dense_nulls_and_dimensions(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [None, 1.0])], "chunk_id int, vector array<double>")
    asked = store.withColumnRenamed("chunk_id", "question_id")
    assert sorted((r["question_id"], r["chunk_id"], r["rank"]) for r in dense.cosine_top(asked, store, 5).collect()) == [(1, 1, 1), (1, 3, 2), (3, 1, 2), (3, 3, 1)]
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "chunk_id int, vector array<double>")
    with pytest.raises(ValueError):
        dense.cosine_top(mixed.withColumnRenamed("chunk_id", "question_id"), store, 5)
    with pytest.raises(Exception, match="dimensions"):
        dense.cosine_top(asked, mixed, 5).collect()
    dense.QUERY_BYTES, before = 16, dense.QUERY_BYTES  # a query in each block
    assert dense.cosine_top(asked, store, 1).count() == 2
    dense.QUERY_BYTES = before


def test_dense(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    v[3], v[7] = v[5], 0
    store = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id int, vector array<float>")
    asked = store.where("chunk_id in (5, 9)").select(F.col("chunk_id").alias("question_id"), "vector")
    got = dense.cosine_top(asked, store, 60)
    assert got.where("question_id = 5").count() == 40
    assert [r["chunk_id"] for r in got.where("question_id = 5 and rank <= 2").orderBy("rank").collect()] == [3, 5]
    unit = v.astype(np.float32).astype(float)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    want = np.argsort(-np.round(unit @ unit[9], 9), kind="stable")[:10].tolist()
    assert [r["chunk_id"] for r in dense.cosine_top(asked, store, 10).where("question_id = 9").orderBy("rank").collect()] == want


def test_fusion(spark):
    rows = lists(spark, dense="ABC", sparse="CAD")
    got = fusion.reciprocal_rank(rows, "chunk_id")
    assert order(got) == list("ACBD")
    assert math.isclose(got.where("chunk_id = 'A'").first()["score"], 1 / 61 + 1 / 62)
    two = lists(spark, dense="AXB", sparse="CYB")
    assert order(fusion.reciprocal_rank(two, "chunk_id", k=0.5))[0] == "A"
    assert order(fusion.reciprocal_rank(two, "chunk_id", k=60))[0] == "B"
    assert order(fusion.round_robin(rows, "chunk_id")) == list("ACBD")
    flat = rows.withColumn("score", F.lit(2.0))
    assert {r["norm"] for r in fusion.normalised(flat).collect()} == {0.0}
    weighted = {r["chunk_id"]: r["score"] for r in fusion.weighted(rows, "chunk_id", {0: 0.5, 1: 0.5}).collect()}
    assert weighted == {"A": 0.75, "C": 0.5, "B": 0.25, "D": 0.0}


def test_collapse_and_rerank(spark):
    rows = spark.createDataFrame([("q", "a", 1, 0), ("q", "b", 2, 0), ("q", "c", 3, 9)], "question_id string, chunk_id string, rank int, start_char int")
    assert order(fusion.collapse(rows, ["start_char"])) == ["a", "c"]
    scored = rows.withColumn("new_score", F.lit(1.0) * F.col("rank"))
    assert [r["chunk_id"] for r in rerank.reorder(scored).orderBy("new_rank").collect()] == ["c", "b", "a"]
    assert [r["chunk_id"] for r in rerank.head_and_tail(scored, 2, 3).orderBy("new_rank").collect()] == ["b", "a", "c"]
    pairs = spark.createDataFrame([("who won", "who lost"), ("who won", "who lost"), ("a b", None)], "question string, passage string")
    assert sorted(r["new_score"] for r in rerank.score_pairs(pairs).collect()) == [0.0, 0.5, 0.5]


def test_mmr():
    s = np.eye(4)
    s[0, 1] = s[1, 0] = 0.95
    s[0, 2] = s[2, 0] = s[1, 2] = s[2, 1] = 0.1
    assert context.mmr_order(np.array([1, 0.9, 0.8, 0.1]), s, 3, 0.5) == [0, 2, 3]
    assert context.mmr_order(np.array([0.2, 0.9]), np.eye(2), 5, 1.0) == [1, 0]
