import datetime
import json

import pytest
from pyspark.sql import functions as F

from passagework.operators import dataset, query
from passagework.plans import preparation
from passagework.sources import costs, tables
from passagework.streaming import ingest


def test_clauses():
    assert query.clauses("Did the company that built the ferry open it, 2023, while the harbour that lost it was still closed?") == ["Did the company that built the ferry open it, 2023", "while the harbour that lost it was still closed?"]
    assert query.clauses("Short, and then the rest of this question follows") == ["Short, and then the rest of this question follows"]
    assert query.clauses("") == []


def test_every_clause(spark):
    part = "one two three four w%d"
    asked = spark.createDataFrame([("q", ", ".join(part % i for i in range(6))), ("r", "who built it")], "question_id string, question string")
    got = query.split_clauses(asked).orderBy("question_id", "query_no").collect()
    assert [(r["query_no"], r["text"], r["role"]) for r in got] == [(i + 1, part % i, "clause") for i in range(6)] + [(1, "who built it", "original")]
    few = query.split_clauses(asked, 4).orderBy("question_id", "query_no").collect()
    assert [(r["query_no"], r["extra"]) for r in few] == [(1, 2), (2, 2), (3, 2), (4, 2), (1, 0)]


def test_header_dates(spark, tmp_path):
    rows = [(k, "1-URGENT", "O", datetime.datetime(1996, 1, 2)) for k in (1, 1999, 2000, 150_000)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["header"] for r in preparation.header_dates(spark, str(tmp_path)).collect()}
    assert got == {k: "1-URGENT. O, January 2, 1996." for k, *_ in rows}


def test_parsing(spark):
    replies = spark.createDataFrame([("q", "1. First one\n2. first  ONE\n\n- 'Second'\nThird\nFourth")], "question_id string, reply string")
    got = query.parse_lines(replies, 3).orderBy("query_no").collect()
    assert [r["text"] for r in got] == ["First one", "Second", "Third"] and got[0]["repeated"] == 1 and got[0]["extra"] == 1
    order = query.parse_ranking(spark.createDataFrame([("q", "[3] > 1, 3, 9", 4)], "question_id string, reply string, n int")).orderBy("place").collect()
    assert [r["passage"] for r in order] == [2, 0, 1, 3]
    assert replies.select(query.parse_passage(F.col("reply")).alias("x")).first()["x"] == "First one first  ONE Second Third Fourth"


def test_history_and_route(spark):
    turns = spark.createDataFrame([(1, i, "user", str(i)) for i in range(5)], "conv_id int, turn int, role string, text string")
    got = {r["turn"]: r["history"] for r in query.history(turns, 2).collect()}
    assert got[0] == "" and got[4] == "user: 2\nuser: 3"
    own = spark.createDataFrame([("q", 1, "a", "original")], "question_id string, query_no int, text string, role string")
    more = spark.createDataFrame([("q", 1, "a", "clause"), ("q", 2, "b", "clause")], own.schema)
    assert sorted(r["text"] for r in query.route(own, more, "both").collect()) == ["a", "b"]


def test_spans(spark):
    assert dataset.find_span("one two  three", "two three") == (4, 14, "whitespace")
    assert dataset.find_span("one two", " ") is None and dataset.find_span("aXbX", "X") == (1, 2, "exact")
    rows = spark.createDataFrame([(1, "one two  three", "two"), (2, "one two  three", "two three"), (3, "x", "y"), (4, None, "y")], "id int, text string, fact string")
    got = {r["id"]: (r["start_char"], r["end_char"], r["method"]) for r in dataset.map_evidence(rows).collect()}
    assert got == {1: (4, 7, "exact"), 2: (4, 14, "whitespace"), 3: (None, None, None), 4: (None, None, None)}
    report = dataset.mapping_report(dataset.map_evidence(rows)).first()
    assert (report["facts"], report["exact"], report["missing"], report["mapping_rate"]) == (4, 1, 2, 0.5)
    assert dataset.mapping_report(dataset.map_evidence(rows).limit(0)).first()["mapping_rate"] == 1.0


def test_verbatim(spark):
    docs = spark.createDataFrame([(1, "xthe quick brown foxy"), (2, "the quick red fox"), (3, None), (4, "a")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "the quick brown fox"), (2, "the quick"), (3, " "), (4, None), (5, "a")], "question_id int, fact string")
    want = {(1, 1), (1, 2), (2, 2), (4, 5)}
    for most in (100, 1):
        assert {(r["doc_id"], r["question_id"]) for r in dataset.verbatim(docs, items, most).collect()} == want


def test_clusters_and_split(spark):
    evidence = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "c"), (3, "d")], "question_id int, span string")
    asked = spark.createDataFrame([(i,) for i in range(5)], "question_id int")
    labels = dataset.clusters(evidence, asked)
    assert {r[0]: r[1] for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert dataset.largest_share(labels).first()["largest_share"] == 0.6
    many = spark.createDataFrame([(i, i if i > 50 else i % 2) for i in range(110)], "question_id int, cluster int")
    split = dataset.disjoint_split(many, {"dev": 30, "test": 30}, 10)
    sides = split.join(many, "question_id").groupBy("cluster").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0]
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sides == 1 and counts == {"dev": 30, "test": 30}


def test_samples(spark):
    rows = spark.createDataFrame([(i, "abc"[min(2, i // 5)]) for i in range(20)], "id int, kind string")
    assert {r["kind"]: r["quota"] for r in dataset.quotas(rows, "kind", 10).collect()} == {"a": 3, "b": 2, "c": 5}
    assert dataset.stratified_sample(rows, "id", "kind", 10).count() == 10
    assert dataset.capped(rows, "id", "kind", 2).count() == 6
    top = dataset.modal(spark.createDataFrame([("t", "x", 3), ("t", "y", 1), ("t", "x", 4), ("t", "y", 2)], "t string, a string, n int"), "t", F.col("a"), "n").first()
    assert (top["answer"], top["n"]) == ("y", 2)
    ranks = dataset.nearest_rank(spark.createDataFrame([("g", v) for v in (1, 1, 2, 3, None)], "g string, v int"), "g", "v", [5, 50, 62, 100])
    assert {r["percent"]: r["value"] for r in ranks.collect()} == {5: 1, 50: 1, 62: 1, 100: 3}


def test_sources(spark, tmp_path):
    raw = tmp_path / "corpus.json"
    raw.write_text(json.dumps([{"body": "één", "title": "T", "url": "u"}, {"body": "two"}]))
    docs = tables.raw_documents(spark, str(raw)).orderBy("doc_id").collect()
    assert [(d["doc_id"], d["text"], d["metadata"]["title"]) for d in docs] == [("doc_0000", "één", "T"), ("doc_0001", "two", None)]
    asked = tmp_path / "questions.json"
    asked.write_text(json.dumps([{"query": "who?", "answer": "x", "question_type": "inference", "evidence_list": [{"url": "u", "title": "T", "fact": "f"}]}, {"query": "why?"}]))
    got = tables.raw_questions(spark, str(asked)).orderBy("question_id").collect()
    assert [(r["question_id"], r["query"], r["evidence_list"] and r["evidence_list"][0]["fact"]) for r in got] == [("q_0000", "who?", "f"), ("q_0001", "why?", None)]
    tables.write_metrics(spark.createDataFrame([("r", "recall", 1234.5, 0.25)], "run string, metric string, mean double, low double"), str(tmp_path / "metrics"))
    assert spark.read.option("header", True).csv(str(tmp_path / "metrics")).first()["mean"] == "1234.5000"
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("id,human\n1,Yes\n2,n\n3,?\n4,TRUE\n")
    assert {r["id"]: r["label"] for r in tables.read_labels(spark, str(sheet)).collect()} == {"1": True, "2": False, "4": True}
    rows = spark.createDataFrame([("k", 1)], "key string, v int")
    tables.save_index(rows, str(tmp_path / "index"), {"chunker": "fixed"})
    assert tables.load_index(spark, str(tmp_path / "index"), {"chunker": "fixed"}).count() == 1
    with pytest.raises(tables.IndexMismatch):
        tables.load_index(spark, str(tmp_path / "index"), {"chunker": "sentence"})
    wanted = spark.createDataFrame([("k",), ("l",), ("l",)], "key string")
    both, fresh = tables.through_cache(wanted, rows, lambda m: m.withColumn("v", F.lit(2)))
    assert fresh.count() == 1 and sorted(r["v"] for r in both.collect()) == [1, 2, 2]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.txt").write_bytes(b"ok \xff")
    up = tables.uploaded(spark, str(tmp_path / "up")).first()
    assert up["doc_id"].startswith("upload_") and up["text"].startswith("ok ")
    assert tables.spliced("a<x>old<y>b", "<x>", "<y>", "new") == "a<x>\nnew\n<y>b" and tables.spliced("a", "<x>", "<y>", "n") is None


def test_bill(spark, tmp_path):
    usage = spark.createDataFrame([("m", 1_000_000, 0, False), ("m", 5, 5, True), ("n", 9, 9, False)], "model string, input_tokens long, output_tokens long, cached boolean")
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input double, output double")
    assert {r["model"]: (r["calls"], r["cost"]) for r in costs.bill(usage, prices).collect()} == {"m": (1, 2.0), "n": (1, 0.0)}
    for step in ("one", "two"):
        costs.flush(usage, prices, str(tmp_path / "ledger"), step)
    ledger = spark.read.option("header", True).csv(str(tmp_path / "ledger"))
    assert sorted((r["step"], r["model"], float(r["cost_usd"])) for r in ledger.collect()) == [("one", "m", 2.0), ("one", "n", 0.0), ("two", "m", 2.0), ("two", "n", 0.0)]


def test_stream(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    cut = lambda d: d.select("doc_id", F.explode(F.split("text", " ")).alias("chunk"))
    for rows in ([(1, "a b"), (1, "a b")], [(1, "a b"), (2, "c")]):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
        ingest.ingest(spark, source, "doc_id long, text string", index, str(tmp_path / "check"), cut).awaitTermination()
    assert sorted((r["doc_id"], r["chunk"]) for r in spark.read.parquet(index).collect()) == [(1, "a"), (1, "b"), (2, "c")]
