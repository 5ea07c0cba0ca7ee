"""Embedders, scorers, assembling, question sets and comparison tables on small inputs with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import context, dataset, diagnostics, embedding, models, rerank, sparse, sweeps
from passagework.plans import pipeline
from passagework.sources import tables


# --- embedders and scorers ----------------------------------------------------------------


def test_embedder(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def call(texts):
        with open(calls, "a") as f:
            f.writelines(f"{len(texts)} {t}\n" for t in texts)
        return np.array([[len(t), 1.0, 0.0] for t in texts])

    own = embedding.Embedder("m", 3, call, query_prefix="q: ", document_prefix="d: ", batch=2)
    rows = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "abcd")], "id int, text string").coalesce(1)
    found, fresh = embedding.embedded(rows, "id", F.col("text"), own)
    assert {r["id"]: r["vector"] for r in found.collect()} == {1: [5.0, 1.0, 0.0], 2: [5.0, 1.0, 0.0], 3: [3.0, 1.0, 0.0], 4: [7.0, 1.0, 0.0]}
    asked = open(calls).read().splitlines()
    assert len({x[2:] for x in asked}) == 3 and all(int(x.split()[0]) <= 2 for x in asked)
    path = str(tmp_path / "cache")
    tables.persist_fresh(fresh, path)
    cache = tables.read_cache(spark, path, "key string, vector array<double>")
    open(calls, "w").close()
    more = rows.unionByName(spark.createDataFrame([(5, "new")], rows.schema))
    again, new = embedding.embedded(more, "id", F.col("text"), own, cache=cache)
    assert len(again.collect()) == 5 and len(new.collect()) == 1
    assert {x[2:] for x in open(calls).read().splitlines()} == {"d: new"}
    assert tables.read_cache(spark, str(tmp_path / "none"), "key string, vector array<double>").count() == 0
    query, _ = embedding.embedded(rows, "id", F.col("text"), own, "query", cache)
    assert query.count() == 4
    cut = embedding.hashing(8, cut=2)
    assert {len(r["vector"]) for r in embedding.embedded(rows, "id", F.col("text"), cut)[0].collect()} == {2}
    with pytest.raises(ValueError):
        embedding.hashing(8, cut=9)
    with pytest.raises(ValueError):
        embedding.seeded_cache(rows, cut)
    index = spark.createDataFrame([("ab", [1.0, 2.0, 3.0]), ("ab", [1.0, 2.0, 3.0])], "text string, vector array<double>")
    seeded = embedding.seeded_cache(index, own)
    hit, none = embedding.embedded(rows.where("id = 1"), "id", F.col("text"), own, cache=seeded)
    assert hit.first()["vector"] == [1.0, 2.0, 3.0] and none.count() == 0
    long = embedding.Embedder("m", 3, call, document_prefix="d: ", longest=6)
    assert embedding.truncated_inputs(rows, long, F.col("text")).first()[:] == (4, 1)
    assert embedding.truncated_inputs(rows, embedding.Embedder("m", 3, call, longest=2), F.col("text")).first()[:] == (4, 1)
    assert embedding.ordered([(1, [2.0]), (0, [1.0])], 2).tolist() == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        embedding.ordered([(1, [2.0])], 2)
    assert embedding.pick_device() in ("cpu", "cuda", "mps")


def test_store(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0])], "chunk_id string, vector array<double>")
    store = embedding.added(None, chunks, vectors, 2)
    assert {r["chunk_id"]: r["vector"] for r in store.collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0]}
    assert embedding.added(store, chunks, vectors, 2).count() == 4
    with pytest.raises(ValueError):
        embedding.added(store, chunks, vectors.limit(1), 2)
    with pytest.raises(Exception, match="2 dimensions, not 3"):
        embedding.added(None, chunks, vectors, 3).collect()


def test_cross_encoder(spark):
    def logits(questions, passages):
        assert [len(q) + len(p) for q, p in zip(questions, passages)] == sorted(len(q) + len(p) for q, p in zip(questions, passages))
        return [[len(p.split()), 2.0] for p in passages]

    pairs = spark.createDataFrame([("q", 1, "who won", "a b c d e f"), ("q", 2, "who won", "a"), ("q", 3, "who won", "a"), ("q", 4, "w " * 9, "p " * 3)], "question_id string, rank int, question string, passage string").coalesce(1)
    scorer = rerank.ClassifierScorer(logits, longest=6)
    found, fresh = rerank.cross_encoded(pairs, scorer)
    got = {r["rank"]: (r["new_score"], r["truncated"]) for r in found.collect()}
    assert got == {1: (4.0, True), 2: (1.0, False), 3: (1.0, False), 4: (3.0, True)}
    assert fresh.count() == 3
    none, more = rerank.cross_encoded(pairs, scorer, cache=fresh)
    assert none.count() == 4 and more.count() == 0
    yes = rerank.YesNoScorer(lambda q, p: [[len(x), 2.0] for x in p])
    assert yes.score(["a"], ["bcd"]).tolist() == [1.0]
    notes = spark.createDataFrame([("q", 0.5, True, False, "m"), ("q", 1.0, False, True, "m")], "question_id string, seconds double, cached boolean, refused boolean, model string")
    assert rerank.merged_notes(notes).first().asDict() == {"question_id": "q", "seconds": 1.5, "cached": False, "refused": True, "model": "m"}


def test_clause_orders(spark):
    rows = [("q", 0, "a", 1, 0.9), ("q", 0, "b", 2, 0.1), ("q", 0, "c", 3, 0.2), ("q", 1, "a", 1, 0.1), ("q", 1, "b", 2, 0.8), ("q", 1, "c", 3, 0.85)]
    got = rerank.clause_orders(spark.createDataFrame(rows, "question_id string, query_no int, chunk_id string, rank int, new_score double"))
    order = lambda k: [r["chunk_id"] for r in got.where(F.col("order") == k).orderBy("rank").collect()]
    assert order("best") == ["a", "c", "b"] and order("round_robin") == ["a", "c", "b"]


# --- models -------------------------------------------------------------------------------


def test_refusals_and_routes(spark):
    asked = spark.createDataFrame([("q1", "one two three four five six"), ("q2", "say no"), ("q3", "empty")], "question_id string, question string")

    def moody(systems, users):
        if "say no" in users.iloc[0]:
            raise models.Refused
        return users.map(lambda u: "" if "empty" in u else "1. One two three four five six\n2. other words\n3. more words")

    got = {(r["question_id"], r["query_no"]): (r["text"], r["fallback"], r["missing"]) for r in models.transform(asked, "multi_query", moody).collect()}
    assert got == {("q1", 1): ("other words", None, 1), ("q1", 2): ("more words", None, 1), ("q2", 1): ("say no", "refused", 3), ("q3", 1): ("empty", "empty", 3)}
    with pytest.raises(ValueError):
        models.transform(asked, "decompose", limit=1)
    rows = spark.createDataFrame([("q", "w", f"c{i}", i, f"t{i}") for i in (1, 2, 3)], "question_id string, question string, chunk_id string, rank int, text string")

    def never(systems, users):
        raise models.Refused

    refused = models.listwise(rows, generator=never).orderBy("new_rank").collect()
    assert [(r["chunk_id"], r["refused"]) for r in refused] == [("c1", True), ("c2", True), ("c3", True)]
    assert [r["chunk_id"] for r in models.listwise(rows, depth=2).orderBy("new_rank").collect()] == ["c2", "c1", "c3"]
    assert models.echo(pd.Series(["s"]), pd.Series(['<passages>\n<passage id="1">\nthe text\n</passage>\n</passages>\n\nQuestion: x'])).tolist() == ["the text"]
    assert models.routing_of("decompose", None).combine == "round_robin" and models.routing_of("multi_query", None).retrieve_with == "both"
    requests, prices = spark.createDataFrame([("k", 1_000_000)], "key string, tokens long"), spark.createDataFrame([("m", 2.0, 0.0)], "model string, input double, output double")
    none = spark.createDataFrame([], "key string")
    assert models.confirmed(models.estimate(requests, none, prices, "m"), 3.0)["cost"] == 2.0
    with pytest.raises(models.TooExpensive):
        models.confirmed(models.estimate(requests, none, prices, "m"), 1.0)


def test_split_reranking(spark):
    """Two sub-questions score the candidates on their own; their orders are interleaved or the best score counts."""
    candidates = spark.createDataFrame([("q", f"c{i}", i, 1.0, f"d{i}", 0, 9, t) for i, t in enumerate(["x y", "cat food", "dog food", "cat dog"], 1)], "question_id string, chunk_id string, rank int, score double, doc_id string, start_char int, end_char int, text string")
    queries = spark.createDataFrame([("q", 1, "cat"), ("q", 2, "dog food")], "question_id string, query_no int, text string")
    for combine, want in (("round_robin", ["c2", "c3", "c1", "c4"]), ("max", ["c2", "c3", "c1", "c4"])):
        settings = pipeline.Settings(top_k=4, query_transform=pipeline.Component("decompose"), routing=models.Routing(rerank_with="queries", rerank_combine=combine), reranker=pipeline.Component("overlap"), rerank_depth=3)
        assert [r["chunk_id"] for r in pipeline.reranked(candidates, queries, settings).orderBy("rank").collect()] == want


# --- contexts -----------------------------------------------------------------------------

TEXTS = {"a": "Owls hunt at night in the old barn and sleep by day there.", "b": "A barn was built here.", "c": "Rain fell."}


def passages(spark):
    docs = spark.createDataFrame([("a", TEXTS["a"], "Owls?", "Field Notes", "2021-05-02"), ("b", TEXTS["b"], "Barns", None, "2020-01-31"), ("c", TEXTS["c"], None, None, None)], "doc_id string, text string, title string, source string, published_at string")
    spans = [("a", 10, 30), ("b", 0, 22), ("a", 0, 10), ("c", 0, 10), ("a", 40, 58)]
    rows = [("q", i, 1.0 - i / 10, f"{d}:{s}", d, s, e, TEXTS[d][s:e]) for i, (d, s, e) in enumerate(spans, 1)]
    return spark.createDataFrame(rows, "question_id string, rank int, score double, chunk_id string, doc_id string, start_char int, end_char int, text string"), docs


def test_assembler(spark):
    chunks, docs = passages(spark)
    got = context.assemble(chunks, docs, 5, order="chronological", header=True).orderBy("position").collect()
    assert [(r["doc_id"], r["start_char"], r["end_char"], r["rank"], r["header"]) for r in got] == [
        ("b", 0, 22, 2, "Barns. January 31, 2020."), ("a", 0, 30, 1, "Owls? Field Notes, May 2, 2021."), ("a", 40, 58, 5, "Owls? Field Notes, May 2, 2021."), ("c", 0, 10, 4, "")]
    assert got[1]["text"] == TEXTS["a"][:30] and got[1]["n_chunks"] == 2
    # the header's words count: six of the first passage's header and seven of its text, then four and five
    assert [r["doc_id"] for r in context.assemble(chunks, docs, 5, budget=21, header=True).collect()] == ["a"]
    few = context.assemble(chunks, docs, 5, budget=22, header=True).orderBy("position").collect()
    assert [r["doc_id"] for r in few] == ["a", "b"]
    plain = context.assemble(chunks, docs, 2, merge=False).orderBy("position").collect()
    assert [(r["doc_id"], r["rank"], r["n_chunks"], r["header"]) for r in plain] == [("a", 1, 1, ""), ("b", 2, 1, "")]
    sizes = context.contents(context.assemble(chunks, docs, 5)).first()
    assert (sizes["context_passages"], sizes["context_chunks"]) == (4, 5)
    gold = context.wrapped(chunks.where("rank < 3"), docs, header=True).orderBy("position").collect()
    assert [r["header"] for r in gold] == ["Owls? Field Notes, May 2, 2021.", "Barns. January 31, 2020."]
    for wrong in ({"order": "length"}, {"pool": 2}, {"mmr_weight": 0.5}):
        with pytest.raises(ValueError):
            context.assemble(chunks, docs, 5, **wrong)


def test_counted_by_a_rank_file(spark, tmp_path):
    """A budget in the tokens of a rank file: here every byte is one."""
    import base64

    path = tmp_path / "bytes.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)))
    count = context.counter(str(path), r"[\s\S]")
    chunks, docs = passages(spark)
    assert chunks.where("rank = 2").select(count(F.col("text"))).first()[0] == 22
    got = context.assemble(chunks, docs, 5, merge=False, budget=42, tokens=count).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2]


def test_variety(spark):
    """Of a pool of four, where the second is nearly the first again, the third is chosen beside the first."""
    chunks, docs = passages(spark)
    pool = chunks.where("rank <= 4")
    vectors = spark.createDataFrame([("a:10", [1.0, 0.0]), ("b:0", [0.99, 0.14]), ("a:0", [0.0, 1.0]), ("c:0", [0.0, 1.0])], "chunk_id string, vector array<double>")
    got = context.assemble(pool, docs, 2, pool=4, merge=False, mmr_weight=0.5, vectors=vectors).orderBy("position").collect()
    assert [(r["rank"], r["position"]) for r in got] == [(1, 1), (3, 2)]
    same = context.assemble(pool, docs, 2, pool=4, merge=False, mmr_weight=1.0, vectors=vectors).orderBy("position").collect()
    assert [r["rank"] for r in same] == [1, 2]


def test_modes(spark):
    _, docs = passages(spark)
    asked = spark.createDataFrame([("q", "Where do owls hunt?", "inference", "barn"), ("r", "Did it rain?", "yes_no", "yes"), ("s", "Was it dry?", "yes_no", "yes")], "question_id string, question string, question_type string, answer string")
    gold = spark.createDataFrame([("q", 0, "a", 0, 30)], "question_id string, span_no int, doc_id string, start_char int, end_char int")
    chunks = spark.createDataFrame([(f"{d}:0000", d, t, 0, len(t)) for d, t in TEXTS.items()], "chunk_id string, doc_id string, text string, start_char int, end_char int")
    settings = pipeline.Settings(top_k=2, retriever=pipeline.Component("sparse"), context=pipeline.Component("assembler", {"header": True}))
    ask = lambda mode: {r["question_id"]: r for r in pipeline.ask(asked, docs, chunks, settings, mode, gold).collect()}
    assert ask("guesser")["s"]["answer"] == "yes"
    assert ask("gold")["q"]["passages"].startswith('<passages>\n<passage id="1">\nOwls? Field Notes, May 2, 2021.\nOwls hunt')
    assert ask("closed_book")["r"]["answer"] == "Question: Did it rain?"
    assert ask("retrieved")["q"]["answer"].startswith("Owls? Field Notes, May 2, 2021.\nOwls hunt")
    with pytest.raises(ValueError):
        ask("other")
    scores = pipeline.evaluate(asked.where("question_id = 'q'").select("question_id", "question"), gold, chunks, settings, (1,), 6, docs)
    got = {r["metric"]: r["value"] for r in scores.collect()}
    assert got["recall@1"] == got["context_recall"] == got["context_full_support"] == got["recall@6tok"] == 1.0 and got["precision@6tok"] > 0.9
    yes = lambda systems, users: pd.Series(['{"verdict": "correct"}'] * len(users))
    rows, answers = pipeline.answer_run(asked, docs, chunks, settings, gold=gold, correct=yes)
    got_rows = {r["question_id"]: r for r in rows.collect()}
    assert got_rows["q"]["judge_correct"] is True and got_rows["q"]["full_support"] is True and got_rows["r"]["full_support"] is None and got_rows["q"]["judge_faithful"] is None
    assert {r["question_id"]: r["value"] for r in answers.where("metric = 'correct'").collect()} == {"q": 1.0, "r": 1.0, "s": 1.0}
    guessed = pipeline.answer_run(asked, docs, chunks, settings, "guesser")[1]
    assert guessed.where("metric = 'exact_match'").agg(F.sum("value")).first()[0] == 3.0
    clusters = asked.select("question_id", F.col("question_type").alias("cluster"))
    mean = pipeline.summary(scores, clusters, samples=20).where("metric = 'recall@1'").first()
    assert (mean["mean"], mean["low"], mean["high"], mean["n"]) == (1.0, 1.0, 1.0, 1)


# --- question sets ------------------------------------------------------------------------


def test_build_questions(spark):
    docs = spark.createDataFrame([("d0", "One fact here. Two  facts there. One fact here.", "u0", "T0", 0), ("d1", "Other words.", "u1", "T1", 1)], "doc_id string, text string, url string, title string, ordinal int")
    item = lambda u, t, f: {"url": u, "title": t, "fact": f}
    raw = [("q0", "?", "a", "x", [item("u0", None, "One fact here."), item(None, "T0", "Two facts there."), item("u0", None, "One fact here.")]), ("q1", "?", "a", "x", [item("u9", None, "x"), item("u1", None, "absent")]), ("q2", "?", "a", "x", [])]
    frame = spark.createDataFrame(raw, "question_id string, query string, answer string, question_type string, evidence_list array<struct<url:string,title:string,fact:string>>")
    questions, items = dataset.build_questions(frame, docs)
    got = {r["question_id"]: ([tuple(e) for e in r["evidence"]], r["complete"]) for r in questions.collect()}
    assert got == {"q0": ([("d0", 0, 14), ("d0", 15, 32)], True), "q1": ([], False), "q2": ([], True)}
    assert dataset.build_report(questions, items).first().asDict() == {"questions": 3, "without_evidence": 2, "incomplete": 1, "facts": 5, "exact": 1, "whitespace": 1, "article_not_in_corpus": 1, "sentence_not_in_article": 1, "duplicates": 1, "repeated_sentences": 2, "mapping_rate": 0.6}
    assert [r["question_id"] for r in dataset.answerable(questions).collect()] == ["q0"]
    spans = spark.createDataFrame([("d0", 0, 14), ("d1", 0, 5)], "doc_id string, start_char int, end_char int")
    assert dataset.shared_gold_spans(spans, spans.limit(1)).count() == 1


def test_evidence_split(spark):
    rows = [(i, "abc"[i % 3], f"c{i % 2}" if i < 30 else f"c{i}", i < 120) for i in range(150)]
    questions = spark.createDataFrame(rows, "question_id int, question_type string, cluster string, has_evidence boolean")
    got = {r["question_id"]: r["split"] for r in dataset.evidence_split(questions, {"dev": 40, "test": 30}, 0.25).collect()}
    assert len(got) == 150
    size = {s: sum(x == s for x in got.values()) for s in ("dev", "test")}
    assert size == {"dev": 40, "test": 30}
    side = lambda *names: {c for i, _, c, e in rows if e and got[i] in names}
    assert not side("dev", "pool") & side("test", "test_pool")
    assert sum(not rows[i][3] for i, s in got.items() if s == "dev") == 8 and sum(not rows[i][3] for i, s in got.items() if s == "test") == 6
    for s, quota in (("dev", 32), ("test", 24)):
        most = max(sum(got[i] == s and c == k for i, _, c, e in rows if e) for k in ("c0", "c1"))
        assert most <= 0.25 * quota
    with pytest.raises(ValueError):
        dataset.evidence_split(questions, {"dev": 400, "test": 30}, 0.25)


def test_label_sheet(spark):
    rows = [(i, f"q{i}", "r", "x", None if i % 4 else True, None if i % 5 == 0 else i % 3 == 0) for i in range(60)] * 2
    answers = spark.createDataFrame(rows, "question_id int, question string, reference string, answer string, match boolean, judge_correct boolean")
    got = dataset.label_sheet(answers, 10).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["id"])] == [f"c{i:02d}" for i in range(1, 11)] and len({r["question"] for r in got}) == 10
    number = [int(r["question"][1:]) for r in got]
    assert all(i % 4 and i % 5 for i in number) and sum(i % 3 != 0 for i in number) == 5


def test_postings_are_kept(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "owl barn"), ("b", "owl")], "chunk_id string, text string")
    made = []

    def build(rows):
        def run():
            made.append(1)
            return sparse.postings(rows, "chunk_id", T.terms(F.col("text")))
        return run

    first = tables.postings_for(chunks, str(tmp_path), {"stems": False}, build(chunks))
    assert first.count() == 3 and tables.postings_for(chunks, str(tmp_path), {"stems": False}, build(chunks)).count() == 3 and len(made) == 1
    tables.postings_for(chunks, str(tmp_path), {"stems": True}, build(chunks))
    assert len(made) == 2
    more = chunks.unionByName(spark.createDataFrame([("c", "rain")], chunks.schema))
    assert tables.postings_for(more, str(tmp_path), {"stems": False}, build(more)).count() == 4 and len(made) == 3
    (tmp_path / "f.txt").write_text("x")
    assert tables.content_hash(spark, str(tmp_path / "f.txt")) == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


# --- comparisons --------------------------------------------------------------------------


def test_tables_of_runs(spark):
    scores = spark.createDataFrame([(r, i, "m", v) for r, vs in {"a": (1.0, 0.0, 1.0, 0.0), "b": (1.0, 1.0, 1.0, 0.0)}.items() for i, v in enumerate(vs)], "run string, question_id int, metric string, value double")
    asked = spark.createDataFrame([(i, "xy"[i // 2], f"c{i}") for i in range(4)], "question_id int, question_type string, cluster string")
    got = {r["run"]: r for r in sweeps.run_table(scores, "a", asked, ["m"], samples=100).collect()}
    assert (got["a"]["mean"], got["a"]["difference"]) == (0.5, None) and (got["b"]["mean"], got["b"]["difference"], got["b"]["n"]) == (0.75, 0.25, 4)
    assert got["b"]["low"] <= 0.25 <= got["b"]["high"]
    by = {(r["run"], r["question_type"]): r["difference"] for r in sweeps.type_table(scores, "a", asked, "m", samples=20).collect()}
    assert by == {("a", "x"): None, ("a", "y"): None, ("b", "x"): 0.5, ("b", "y"): 0.0}
    grid = spark.createDataFrame([(0, 1.0, None, 0.2), (1, 2.0, None, 0.6), (2, 2.0, 10, 0.5), (3, 2.0, 20, 0.9), (4, 1.0, 20, 1.0)], "ordinal int, k1 double, depth int, value double")
    assert sweeps.stepwise(grid, [["k1"], ["depth"]]) == {"k1": 2.0, "depth": 20}
    with pytest.raises(ValueError):
        sweeps.stepwise(grid.limit(0), [["k1"]])
    checks = spark.createDataFrame([("What?", "What does the owl eat?", ["Owl"]), ("And?", "And?", []), ("So?", "So what?", [])], "asked string, question string, must array<string>")
    assert sweeps.followups_passed(checks).first()[:] == (3, 2)
    assert sorted(r["v"] for r in sweeps.first_of_each(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int"), "k", "v").collect()) == [1, 3]
    contexts = {n: spark.createDataFrame(rows, "question_id int, rank int, doc_id int, start_char int, end_char int") for n, rows in {"plain": [(0, 1, 7, 0, 9)], "wide": [(0, 1, 7, 0, 9), (1, 1, 8, 0, 9)]}.items()}
    gold = spark.createDataFrame([(0, 0, 7, 2, 4), (1, 0, 8, 2, 4)], "question_id int, span_no int, doc_id int, start_char int, end_char int")
    table = {(r["run"], r["metric"]): (r["mean"], r["difference"]) for r in sweeps.context_table(contexts, gold, asked, "plain", samples=20).collect()}
    assert table[("wide", "context_recall")] == (1.0, 0.5) and table[("plain", "context_full_support")] == (0.5, None)


def test_failures_and_examples(spark):
    rows = [(1, 0, "s1", 0.1, None, 3, 5), (2, 0, "s1", 0.2, None, 2, 40), (3, 0, "s2", 0.3, None, None, None), (4, 0, "s3", 0.0, None, None, None), (5, 0, "s4", 0.5, 1, 2, 1)]
    sentences = spark.createDataFrame(rows, "question_id int, span_no int, sentence string, overlap double, dense int, sparse int, hybrid int")
    found = sweeps.failures(sentences)
    assert sorted((r["kind"], r["question_id"]) for r in found.collect()) == [("both miss", 3), ("both miss", 4), ("dense misses", 1), ("dense misses", 2), ("fusion loses", 2)]
    kinds = found.withColumn("cluster", F.col("question_id") % 2)
    got = diagnostics.picked(kinds, "kind", "cluster", "order", 5, "sentence").collect()
    # questions 1 and 2 have one sentence, of which the better rank is shown; 3 and 4 are of different clusters
    assert sorted((r["kind"], r["question_id"]) for r in got) == [("both miss", 3), ("both miss", 4), ("dense misses", 2), ("fusion loses", 2)]


# --- from files to a run ------------------------------------------------------------------


def test_prepare_and_commands(spark, tmp_path):
    """Raw files to splits and a manifest, an index, an answer, a scored run and a comparison, from the command line."""
    import json

    from passagework import __main__ as command

    words = ["owl", "barn", "ferry", "rain", "bread", "fog", "harbour", "mayor", "kite", "lamp"]
    corpus = [{"body": f"The {w} number {n} was seen in town {n}. Nobody knew the {w} before.", "title": f"T{n} {w}", "url": f"u{n}-{w}", "source": "Wire", "published_at": "2022-03-04"} for n in range(4) for w in words]
    questions = [{"query": f"Was the {w} number {n} seen?", "answer": "yes", "question_type": "xy"[n % 2], "evidence_list": [{"url": f"u{n}-{w}", "title": None, "fact": f"The {w} number {n} was seen in town {n}."}]} for n in range(4) for w in words]
    questions += [{"query": f"What of {n}?", "answer": "Insufficient information.", "question_type": "null_query", "evidence_list": []} for n in range(8)]
    questions += [{"query": "?", "answer": "a", "question_type": "x", "evidence_list": [{"url": "u0-owl", "title": None, "fact": "not there"}]}]
    for name, rows in (("corpus", corpus), ("questions", questions)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    out = str(tmp_path / "out")
    manifest = command.main(["prepare", str(tmp_path / "corpus.json"), str(tmp_path / "questions.json"), out, "--dev", "12", "--test", "12", "--subset", "4"], spark)
    assert manifest["documents"] == 40 and manifest["questions"] == {"dev": 12, "test": 12, "pool": 24, "test_pool": 0, "dev_answer_subset": 4, "excluded": 1}
    assert manifest["split_check"]["gold_spans_shared_by_dev_and_test"] == 0 and manifest["mapping"]["exact"] == 40 and len(manifest["raw_sha256"]["corpus"]) == 64
    assert json.loads("\n".join(r[0] for r in spark.read.text(f"{out}/manifest.json").collect())) == manifest
    (tmp_path / "s.json").write_text('{"retriever": "sparse", "chunker": {"name": "sentence", "params": {"size": 20}}, "top_k": 2}')
    settings = ["--settings", str(tmp_path / "s.json")]
    index = str(tmp_path / "index")
    assert command.main(["ingest", f"{out}/documents.jsonl", index, *settings], spark)["documents"] == 40
    answer = command.main(["ask", f"{out}/documents.jsonl", index, "Was the ferry number 2 seen?", *settings], spark)
    assert answer["answer"].startswith("The ferry number 2 was seen")
    run = str(tmp_path / "run")
    means = command.main(["eval", f"{out}/documents.jsonl", index, f"{out}/questions_dev.jsonl", run, *settings], spark)
    assert means["recall@5"]["mean"] == 1.0 and means["recall@2000tok"]["mean"] == 1.0 and means["context_full_support"]["mean"] == 1.0
    assert command.main(["compare", run, run, "recall@1"], spark)["differing"] == 0
    with pytest.raises(PermissionError):
        command.main(["eval", f"{out}/documents.jsonl", index, f"{out}/questions_test.jsonl", run, *settings], spark)
    assert pipeline.Evaluation.load('{"ks": [3]}').ks == (3,)
    with pytest.raises(ValueError):
        pipeline.Evaluation.load('{"depths": [3]}')


def test_hosted():
    made, fails = [], [ConnectionError(), None]

    def connect():
        made.append(1)

        def client(system, user):
            error = fails.pop(0) if fails else None
            if error:
                raise error
            return ["  an ", f"answer to {user} "]
        return client

    call = models.hosted(connect)
    assert call(pd.Series(["s", "s"]), pd.Series(["a", "b"])).tolist() == ["an answer to a", "an answer to b"] and len(made) == 1
    assert models.tolerant(models.hosted(lambda: lambda s, u: (_ for _ in ()).throw(models.Refused())))(pd.Series(["s"]), pd.Series(["u"])).tolist() == [models.REFUSED]
