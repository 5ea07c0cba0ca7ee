import math

import pytest
from pyspark.sql import functions as F

from passagework.operators import metrics, stats


def returned(spark):
    rows = [("q", 1, "a", 0, 100), ("q", 2, "a", 100, 200), ("q", 3, "c", 0, 100), ("q", 4, "b", 0, 100)]
    return spark.createDataFrame(rows, "question_id string, rank int, doc_id string, start_char int, end_char int")


def gold(spark):
    return spark.createDataFrame([("q", 0, "a", 120, 160), ("q", 1, "b", 10, 50), ("z", 0, "x", 0, 9)], "question_id string, span_no int, doc_id string, start_char int, end_char int")


def test_ranks_and_scores(spark):
    ranks = metrics.gold_ranks(returned(spark), gold(spark))
    assert {(r[0], r[1]): r[2] for r in ranks.collect()} == {("q", 0): 2, ("q", 1): 4, ("z", 0): None}
    scores = {(r[0], r[1]): r[2] for r in metrics.span_scores(ranks, (2, 4)).collect()}
    assert scores[("q", "recall@2")] == 0.5 and scores[("q", "full_support@4")] == 1.0 and scores[("z", "recall@4")] == 0.0


def test_ndcg(spark):
    flagged = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, False), ("q", 4, True)], "question_id string, rank int, hit boolean")
    totals = spark.createDataFrame([("q", 2), ("none", 0)], "question_id string, total long")
    got = {r["question_id"]: r for r in metrics.rank_scores(flagged, totals).collect()}
    assert math.isclose(got["q"]["ndcg"], (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert got["q"]["mrr"] == 0.5 and got["none"]["ndcg"] == 0.0


def test_containment_and_cover(spark):
    index = returned(spark).select("doc_id", "start_char", "end_char")
    assert {(r[0], r[1]) for r in metrics.spans_not_contained(index, gold(spark)).select("question_id", "span_no").collect()} == {("z", 0)}
    cut = spark.createDataFrame([("a", 130, 200)], "doc_id string, start_char int, end_char int")
    assert metrics.spans_cut(cut, gold(spark)).count() == 1
    ranges = spark.createDataFrame([("q", "a", 110, 130), ("q", "a", 125, 150), ("q", "b", 0, 5)], "question_id string, doc_id string, start_char int, end_char int")
    assert metrics.covered_chars(ranges, gold(spark)).first()["covered"] == 30
    got = {r["question_id"]: r for r in metrics.budget_scores(ranges, gold(spark)).collect()}
    assert got["q"]["recall"] == 0.5 and math.isclose(got["q"]["precision"], 30 / 50) and got["z"]["precision"] == 0.0


def test_groups(spark):
    scores = spark.createDataFrame([(1, "m", 1.0), (2, "m", 0.0), (3, "m", None)], "question_id int, metric string, value double")
    kinds = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "question_id int, kind string")
    got = {(r["kind"], r["overall"]): (r["mean"], r["n"]) for r in metrics.by_group(scores, kinds, "kind").collect()}
    assert got == {(None, 1): (0.5, 2), ("x", 0): (1.0, 1), ("y", 0): (0.0, 1)}


def test_agreement(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (None, True)], "a boolean, b boolean")
    got = stats.kappa(rows, "a", "b").first()
    assert got["n"] == 3 and math.isclose(got["agree"], 2 / 3) and math.isclose(got["kappa"], 0.4, abs_tol=1e-12)
    assert stats.kappa(rows.where("a and b"), "a", "b").first()["kappa"] == 1.0
    assert stats.confusion(rows, "a", "b").first().asDict() == {"n": 3, "agree": 2, "too_kind": 1, "too_harsh": 0}
    ranked = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("g", 3, True), ("h", 1, True)], "g string, r int, ok boolean")
    assert {r["g"]: r["auc"] for r in stats.separation(ranked, "g", "r", "ok").collect()} == {"g": 0.5, "h": None}


def test_bootstrap(spark):
    rows = spark.createDataFrame([("m", c, float(c % 2)) for c in range(20) for _ in range(c % 3 + 1)], "metric string, cluster int, value double")
    got = stats.bootstrap(rows, ["metric"], "cluster", "value").first()
    assert got["low"] <= got["mean"] <= got["high"] and got["n"] == rows.count()
    same = stats.bootstrap(rows.withColumn("value", F.lit(0.5)), ["metric"], "cluster", "value").first()
    assert same["low"] == same["mean"] == same["high"] == pytest.approx(0.5)
    a = spark.createDataFrame([(1, "m", 1.0), (2, "m", 0.0), (3, "m", None)], "question_id int, metric string, value double")
    b = a.withColumn("value", F.lit(1.0))
    pairs = stats.paired(a, b)
    assert stats.flips(pairs).first().asDict() == {"metric": "m", "differing": 1, "shared": 2, "mean_difference": -0.5}
    assert {r["winner"]: r["questions"] for r in stats.winners(pairs).collect()} == {"tie": 1, "b": 1}
