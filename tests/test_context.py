from pyspark.sql import functions as F

from passagework.operators import context

DOCS = {"a": "First article about a ferry and its harbour, with some fog in it today.", "b": "Second article about bread.", "c": "Third one."}


def chunks(spark, rows):
    data = [("q", r, f"{d}:{s}", d, s, e, DOCS[d][s:e]) for r, (d, s, e) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "question_id string, rank int, chunk_id string, doc_id string, start_char int, end_char int, text string")


def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id string, text string")


def test_merge(spark):
    rows = chunks(spark, [("b", 0, 10), ("a", 21, 45), ("a", 0, 21), ("a", 50, 70)])
    got = context.stitched(context.merge_neighbours(rows), docs(spark)).orderBy("rank").collect()
    assert [(r["doc_id"], r["start_char"], r["end_char"], r["rank"], r["n_chunks"]) for r in got] == [("b", 0, 10, 1, 1), ("a", 0, 45, 2, 2), ("a", 50, 70, 4, 1)]
    assert got[1]["text"] == DOCS["a"][:45]


def test_orders(spark):
    rows = chunks(spark, [("a", 0, 5), ("a", 5, 9), ("a", 9, 12), ("b", 0, 4), ("c", 0, 5)])
    edges = context.order_edges(rows).orderBy("position").collect()
    assert [r["rank"] for r in edges] == [1, 3, 5, 4, 2]
    assert [r["rank"] for r in context.order_edges(rows.where("rank < 5")).orderBy("position").collect()] == [2, 4, 3, 1]
    dated = context.order_chronological(rows, F.when(F.col("doc_id") == "b", F.lit("2023-01-01").cast("timestamp")))
    assert [r["doc_id"] for r in dated.orderBy("position").collect()] == ["b", "a", "a", "a", "c"]


def test_dedupe_budget_render(spark):
    rows = spark.createDataFrame([("q", 1, "One  two"), ("q", 2, "one two"), ("q", 3, " three four five "), ("q", 4, "six")], "question_id string, rank int, text string")
    kept = context.dedupe(rows)
    assert [r["rank"] for r in kept.orderBy("rank").collect()] == [1, 3, 4]
    assert [r["rank"] for r in context.within_tokens(kept, context.token_count(F.col("text")), 4).orderBy("rank").collect()] == [1]
    assert [r["rank"] for r in context.within_tokens(kept, context.token_count(F.col("text")), 1).orderBy("rank").collect()] == [1]
    blocks = context.rendered(kept.where("rank in (1, 3)"), header=F.when(F.col("rank") == 3, "Head."))
    assert blocks.first()["passages"] == '<passages>\n<passage id="1">\nOne  two\n</passage>\n\n<passage id="2">\nHead.\nthree four five\n</passage>\n</passages>'
    asked = spark.createDataFrame([("q", "Why?")], "question_id string, question string")
    assert context.prompts(asked, blocks).first()["user"].endswith("</passages>\n\nQuestion: Why?")
    assert context.prompts(asked, None).first()["user"] == "Question: Why?"
    assert context.echo_answers(rows).first()["answer"] == "One  two"
