"""Question sets, sheets of labels, comparisons of runs and contexts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, dataset, diagnostics, fusion, metrics, rerank, sparse, stats, sweeps
from ..sources.tables import checkpointed
from .common import BM25_CTES, LIST_CTES, bm25_sql, chunk_ctes, docs, questions, table, terms_sql
from .evaluation import GOLD, gold
from .passages import MERGED, returned
from .retrieval import SECOND, _lists, _rescored

ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


# --- question sets ------------------------------------------------------------------------

#: Each gold span is an item of evidence; every question has its first one again, and one of an article that is not there.
EVIDENCE = f"""{GOLD},
items AS (SELECT question_id, span_no AS item_no, doc_id, start_char, end_char, CASE WHEN len(string_split(d.text, b.text)) > 2 THEN 1 ELSE 0 END AS again
  FROM gold JOIN benchmark b ON b.item_id = question_id JOIN documents d USING (doc_id))"""


def _raw(spark, sf_dir):
    """Raw questions of the items, and the documents with an address."""
    spans = gold(spark, sf_dir).select("question_id", "span_no", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    first = spans.where("span_no = 0")
    every = spans.unionByName(first.withColumn("span_no", F.col("span_no") + 1_000_000)).unionByName(first.select("question_id", F.lit(2_000_000).cast("long").alias("span_no"), F.lit("none").alias("url")))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    listed = every.join(items, "question_id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("span_no", "url", F.col("query").alias("fact")))).alias("x"))
    evidence = F.transform("x", lambda e: F.struct(e["url"].alias("url"), F.lit(None).cast("string").alias("title"), e["fact"].alias("fact")))
    raw = items.join(listed, "question_id", "left").select("question_id", "query", F.lit("yes").alias("answer"), F.lit("inference").alias("question_type"), evidence.alias("evidence_list"))
    own = docs(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("title"), F.col("doc_id").alias("ordinal"))
    return raw, own


@entry("build_questions", f"WITH {EVIDENCE} SELECT question_id, item_no AS span_no, doc_id, start_char::INTEGER AS start_char, end_char::INTEGER AS end_char FROM items")
def build_questions(spark, sf_dir):
    """The distinct spans of each question, in order."""
    made, _ = dataset.build_questions(*_raw(spark, sf_dir))
    rows = made.select("question_id", F.posexplode("evidence").alias("span_no", "s"))
    return rows.select("question_id", F.col("span_no").cast("long").alias("span_no"), "s.doc_id", "s.start_char", "s.end_char")


@entry("build_report", f"""WITH {EVIDENCE}, n AS (SELECT count(*) AS spans, count(DISTINCT question_id) AS asked, sum(again) + sum(CASE WHEN item_no = 0 THEN again ELSE 0 END) AS again FROM items)
SELECT (SELECT count(*) FROM benchmark) AS questions, (SELECT count(*) FROM benchmark) - asked AS without_evidence, asked AS incomplete, spans + 2 * asked AS facts, spans AS exact, 0::BIGINT AS whitespace,
  asked AS article_not_in_corpus, 0::BIGINT AS sentence_not_in_article, asked AS duplicates, coalesce(again, 0)::BIGINT AS repeated_sentences, coalesce((spans + asked)::DOUBLE / nullif(spans + 2 * asked, 0), 1) AS mapping_rate FROM n""")
def build_report(spark, sf_dir):
    return dataset.build_report(*dataset.build_questions(*_raw(spark, sf_dir)))


@entry("evidence_split")
def evidence_split(spark, sf_dir):
    """Documents as questions: the language is the type, the source the cluster, every tenth has no evidence."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("question_type"), F.concat_ws(":", "source", (F.col("doc_id") % 97).cast("string")).alias("cluster"), (F.col("doc_id") % 10 != 0).alias("has_evidence"))
    return dataset.evidence_split(rows, {"dev": 40, "test": 40}, 0.25)


@entry("shared_gold_spans", f"WITH {GOLD} SELECT doc_id, start_char, end_char FROM gold WHERE question_id % 2 = 0 INTERSECT SELECT doc_id, start_char, end_char FROM gold WHERE question_id % 3 = 0")
def shared_gold_spans(spark, sf_dir):
    """Of the questions with even numbers and those with numbers divisible by three."""
    spans = checkpointed(gold(spark, sf_dir))
    return dataset.shared_gold_spans(spans.where("question_id % 2 = 0"), spans.where("question_id % 3 = 0"))


ANSWERED = """a AS (SELECT DISTINCT doc_id AS question_id, 'q' || doc_id AS question, 'r' AS reference, CASE doc_id % 2 WHEN 0 THEN 'long' ELSE 'short' END AS answer, quality = 1 AS judge_correct FROM labels WHERE doc_id % 3 <> 0 AND quality IS NOT NULL),
k AS (SELECT *, md5('0:' || question_id || chr(0) || answer) AS h FROM a),
f AS (SELECT * FROM k WHERE NOT judge_correct ORDER BY h LIMIT 20),
p AS (SELECT * FROM k WHERE judge_correct ORDER BY h LIMIT (SELECT 40 - count(*) FROM f)),
c AS (SELECT * FROM f UNION ALL SELECT * FROM p)"""


@entry("label_sheet", f"WITH {ANSWERED} SELECT 'c' || lpad((row_number() OVER (ORDER BY h))::VARCHAR, 2, '0') AS id, question, reference AS reference_answer, answer, '' AS human FROM c")
def label_sheet(spark, sf_dir):
    """Forty answers that no comparison of strings settled, half of them failed ones if there are so many; every third answer was settled."""
    rows = table(spark, sf_dir, "labels").where("quality is not null")
    k = F.col("doc_id")
    answers = rows.select(k.alias("question_id"), F.concat(F.lit("q"), k.cast("string")).alias("question"), F.lit("r").alias("reference"), F.when(k % 2 == 0, "long").otherwise("short").alias("answer"), F.when(k % 3 == 0, True).alias("match"), (F.col("quality") == 1).alias("judge_correct"))
    return dataset.label_sheet(answers, 40)


@entry("disagreements", "SELECT doc_id, CASE WHEN quality = 1 THEN 'too_kind' ELSE 'too_harsh' END AS verdict FROM labels WHERE (quality = 1) <> (toxic = 0)")
def disagreements(spark, sf_dir):
    """Quality stands for the judge's verdict, the absence of toxicity for the human's."""
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("judge"), (F.col("toxic") == 0).alias("human"))
    return sweeps.disagreements(rows).select("doc_id", "verdict")


# --- runs ---------------------------------------------------------------------------------

RUNS = """s AS (SELECT 'a' AS run, doc_id AS question_id, 'correct' AS metric, quality::DOUBLE AS value FROM labels WHERE quality IS NOT NULL UNION ALL
  SELECT 'b', doc_id, 'correct', (1 - toxic)::DOUBLE FROM labels WHERE toxic IS NOT NULL UNION ALL SELECT 'c', doc_id, 'correct', (doc_id % 2)::DOUBLE FROM labels)"""


def _runs(spark, sf_dir):
    """Three runs of one score each, and the questions: the language is the type, the source the cluster."""
    rows = table(spark, sf_dir, "labels")
    run = lambda n, c: rows.select(F.lit(n).alias("run"), F.col("doc_id").alias("question_id"), F.lit("correct").alias("metric"), c.cast("double").alias("value"))
    scores = run("a", F.col("quality")).unionByName(run("b", 1 - F.col("toxic"))).unionByName(run("c", F.col("doc_id") % 2))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("question_type"), F.col("source").alias("cluster"))
    return scores, asked


@entry("run_table", f"""WITH {RUNS}, m AS (SELECT run, metric, avg(value) AS mean, count(*) AS n FROM s GROUP BY ALL),
d AS (SELECT x.run, x.metric, avg(x.value - y.value) AS difference FROM s x JOIN s y ON y.run = 'a' AND x.run <> 'a' AND x.question_id = y.question_id JOIN documents ON doc_id = x.question_id GROUP BY ALL)
SELECT run, metric, round(mean, 6) AS mean, n, round(difference, 6) AS difference FROM m LEFT JOIN d USING (run, metric)""")
def run_table(spark, sf_dir):
    """Means and paired differences from the first run; the intervals are drawn, and not shown here."""
    scores, asked = _runs(spark, sf_dir)
    return sweeps.run_table(scores, "a", asked, ["correct"], samples=50).select("run", "metric", F.round("mean", 6).alias("mean"), "n", F.round("difference", 6).alias("difference"))


@entry("type_table", f"""WITH {RUNS}, t AS (SELECT s.*, lang AS question_type FROM s JOIN documents ON doc_id = question_id), m AS (SELECT run, question_type, avg(value) AS mean, count(*) AS n FROM t GROUP BY ALL),
d AS (SELECT x.run, x.question_type, avg(x.value - y.value) AS difference FROM t x JOIN t y ON y.run = 'a' AND x.run <> 'a' AND x.question_id = y.question_id GROUP BY ALL)
SELECT run, question_type, round(mean, 6) AS mean, n, round(difference, 6) AS difference FROM m LEFT JOIN d USING (run, question_type)""")
def type_table(spark, sf_dir):
    scores, asked = _runs(spark, sf_dir)
    return sweeps.type_table(scores, "a", asked, "correct", samples=50).select("run", "question_type", F.round("mean", 6).alias("mean"), "n", F.round("difference", 6).alias("difference"))


SIZES = (64, 128, 256)


@entry("index_table", f"""WITH {GOLD}, spans AS (SELECT DISTINCT doc_id, start_char, end_char FROM gold), c AS ({' UNION ALL '.join(f"SELECT 'fixed-{n}' AS run, {n} AS size, * FROM (WITH {chunk_ctes(n)} SELECT doc_id, start_char, end_char, n_tokens FROM chunk)" for n in SIZES)}),
z AS (SELECT run, count(*) AS n_chunks, avg(n_tokens) AS mean_tokens, count(*) FILTER (n_tokens >= 128) AS at_limit FROM c GROUP BY run),
h AS (SELECT run, count(DISTINCT (s.doc_id, s.start_char, s.end_char)) AS held FROM c JOIN spans s ON s.doc_id = c.doc_id AND c.start_char <= s.start_char AND s.end_char <= c.end_char GROUP BY run)
SELECT run, n_chunks, round(mean_tokens, 6) AS mean_tokens, at_limit, (SELECT count(*) FROM spans) - coalesce(held, 0) AS spans_cut FROM z LEFT JOIN h USING (run)""")
def index_table(spark, sf_dir):
    """Three sizes of windows: how many there are, and how many gold spans none holds whole."""
    rows = docs(spark, sf_dir)
    every = None
    for n in SIZES:
        own = chunking.fixed(rows, n).select(F.lit(f"fixed-{n}").alias("run"), "doc_id", "start_char", "end_char", "n_tokens")
        every = own if every is None else every.unionByName(own)
    return sweeps.index_table(every, checkpointed(gold(spark, sf_dir)), F.col("n_tokens"), 128).withColumn("mean_tokens", F.round("mean_tokens", 6))


@entry("timings", """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, round(median(value), 6) AS median, round(max(value) FILTER (k = greatest(1, round_even(95 / 100.0 * n, 0)::BIGINT)), 6) AS p95 FROM o GROUP BY event_type""")
def timings(spark, sf_dir):
    """Events' values stand for seconds."""
    return sweeps.timings(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@entry("index_stats", "SELECT count(*) AS vectors, max(len(embedding))::INTEGER AS dimensions, (sum(len(embedding)) * 4)::BIGINT AS bytes FROM embeddings")
def index_stats(spark, sf_dir):
    return sweeps.index_stats(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"))


@entry("tokens_in_prompt", "SELECT event_type AS run, round(coalesce(avg(CASE WHEN event_id % 4 <> 0 THEN event_id % 500 END), 0), 6) AS tokens FROM events GROUP BY event_type")
def tokens_in_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 500).alias("input_tokens"))
    return sweeps.tokens_in_prompt(rows).withColumn("tokens", F.round("tokens", 6))


@entry("rerank_outcomes", "SELECT event_type AS run, count(*) AS questions, count(*) FILTER (event_id % 5 = 0) AS refused, count(*) FILTER (event_id % 7 = 0) AS repaired, count(*) FILTER (event_id % 11 = 0) AS cut_short FROM events GROUP BY event_type")
def rerank_outcomes(spark, sf_dir):
    k = F.col("event_id")
    return sweeps.outcomes(table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), (k % 5 == 0).alias("refused"), F.when(k % 7 == 0, True).alias("repaired"), (k % 11 == 0).alias("cut_short")))


@entry("clause_orders", f"""WITH {SECOND}, scored AS (SELECT l.question_id, p.list_no AS query_no, l.chunk_id, l.rank, p.score AS new_score FROM lists l JOIN pairs p ON p.question_id = l.question_id AND p.chunk_id = l.chunk_id WHERE l.list_no = 0),
best AS (SELECT question_id, chunk_id, max(new_score) AS score, min(rank) AS old FROM scored GROUP BY ALL),
one AS (SELECT 'best' AS kind, question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, old, chunk_id) AS rank FROM best),
own AS (SELECT *, row_number() OVER (PARTITION BY question_id, query_no ORDER BY round(new_score, 9) DESC, rank) AS place FROM scored),
first AS (SELECT question_id, chunk_id, min((place, query_no)) AS seen FROM own GROUP BY ALL)
SELECT kind, question_id, chunk_id, rank::INTEGER AS rank FROM one UNION ALL SELECT 'round_robin', question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY seen)::INTEGER FROM first""")
def clause_orders(spark, sf_dir):
    """Whole and truncated vectors stand for two clauses that score the same candidates."""
    lists = _lists(spark, sf_dir).where("list_no = 0")
    whole = lists.select("question_id", F.lit(0).alias("query_no"), "chunk_id", "rank", F.col("score").alias("new_score"))
    part = _rescored(spark, sf_dir).select("question_id", F.lit(1).alias("query_no"), "chunk_id", "rank", "new_score")
    return rerank.clause_orders(whole.unionByName(part)).select(F.col("order").alias("kind"), "question_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


SENTENCES = f"""{BM25_CTES}, {GOLD},
scored AS (SELECT question_id, doc_id, sum({bm25_sql()}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size GROUP BY question_id, doc_id),
scored1 AS (SELECT question_id, doc_id, sum({bm25_sql('0.8', '1.0')}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size GROUP BY question_id, doc_id),
lists AS (SELECT *, 0 AS list_no, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored
  UNION ALL SELECT *, 1 AS list_no, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored1),
top AS (SELECT * FROM lists WHERE rank <= 50),
fused AS (SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list_no, rank)) AS seen FROM top GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, seen) AS rank FROM fused),
sentences AS (SELECT g.question_id, g.span_no, a.rank AS dense, b.rank AS sparse, f.rank AS hybrid FROM gold g LEFT JOIN top a ON a.question_id = g.question_id AND a.doc_id = g.doc_id AND a.list_no = 0
  LEFT JOIN top b ON b.question_id = g.question_id AND b.doc_id = g.doc_id AND b.list_no = 1 LEFT JOIN f ON f.question_id = g.question_id AND f.doc_id = g.doc_id)"""


def _sentences(spark, sf_dir):
    found = checkpointed(sparse.grid_search(questions(spark, sf_dir), docs(spark, sf_dir), "doc_id", T.terms(F.col("text")), 50, [(1.2, 0.75), (0.8, 1.0)]))
    fused = fusion.reciprocal_rank(found.withColumnRenamed("setting", "list_no"), "doc_id")
    spans = checkpointed(gold(spark, sf_dir))
    of = lambda rows: spans.join(rows.select("question_id", "doc_id", F.col("rank").alias("gold_rank")), ["question_id", "doc_id"]).select("question_id", "span_no", "gold_rank")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return sweeps.gold_sentences(spans, docs(spark, sf_dir), asked, T.terms, {"dense": of(found.where("setting = 0")), "sparse": of(found.where("setting = 1")), "hybrid": of(fused)})


@entry("gold_sentences", f"WITH {SENTENCES} SELECT question_id, span_no, md5(b.text) AS digest, CASE WHEN len({terms_sql('b.text')}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS overlap, coalesce(dense, 0)::INTEGER AS dense, coalesce(sparse, 0)::INTEGER AS sparse, coalesce(hybrid, 0)::INTEGER AS hybrid FROM sentences JOIN benchmark b ON b.item_id = question_id")
def gold_sentences(spark, sf_dir):
    """Two BM25 settings stand for the dense and the sparse list; 0: not among the first fifty documents."""
    rank = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return _sentences(spark, sf_dir).select("question_id", "span_no", F.md5(F.col("sentence").cast("binary")).alias("digest"), "overlap", rank("dense"), rank("sparse"), rank("hybrid"))


@entry("failure_kinds", f"""WITH {SENTENCES}, k AS (SELECT unnest([CASE WHEN sparse <= 10 AND dense IS NULL THEN 'dense misses' END, CASE WHEN dense <= 10 AND sparse IS NULL THEN 'sparse misses' END, CASE WHEN dense IS NULL AND sparse IS NULL THEN 'both miss' END,
  CASE WHEN least(coalesce(dense, 51), coalesce(sparse, 51)) <= 10 AND (dense IS NULL OR sparse IS NULL) AND (hybrid IS NULL OR hybrid > 20) THEN 'fusion loses' END, CASE WHEN true THEN 'all' END]) AS kind FROM sentences)
SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY kind""")
def failure_kinds(spark, sf_dir):
    rows = checkpointed(_sentences(spark, sf_dir))
    kinds = sweeps.failures(rows).select("kind").unionByName(rows.select(F.lit("all").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@entry("wins_by_type", """WITH p AS (SELECT lang AS question_type, quality::DOUBLE AS a, (1 - toxic)::DOUBLE AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT 'correct' AS metric, question_type, CASE WHEN a - b > 1e-9 THEN 'a' WHEN a - b < -1e-9 THEN 'b' ELSE 'tie' END AS winner, count(*) AS questions FROM p GROUP BY ALL""")
def wins_by_type(spark, sf_dir):
    scores, asked = _runs(spark, sf_dir)
    pairs = stats.paired(scores.where("run = 'a'"), scores.where("run = 'b'")).join(asked.select("question_id", "question_type"), "question_id")
    return stats.winners(pairs, "question_type")


CONSTANTS = (1, 5, 10, 20, 40, 60, 100, 200)


@entry("fusion_constants", f"""WITH {LIST_CTES}, fused AS (SELECT k::DOUBLE AS k, question_id, chunk_id, sum(1.0::DOUBLE / (k + rank)) AS score, min((list_no, rank)) AS seen FROM lists, (SELECT unnest({list(CONSTANTS)}) AS k) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k, question_id ORDER BY round(score, 12) DESC, seen) AS rank FROM fused)
SELECT k, question_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def fusion_constants(spark, sf_dir):
    """Reciprocal rank fusion with eight constants over the same lists."""
    found = fusion.constant_grid(_lists(spark, sf_dir), "chunk_id", list(CONSTANTS), 10)
    return found.select("k", "question_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@entry("evidence_counts", f"WITH {GOLD}, o AS (SELECT question_id, count(*) AS spans, count(DISTINCT doc_id) AS documents FROM gold GROUP BY question_id) SELECT 'spans' AS kind, spans AS number, count(*) AS questions FROM o GROUP BY spans UNION ALL SELECT 'documents', documents, count(*) FROM o GROUP BY documents")
def evidence_counts(spark, sf_dir):
    return diagnostics.evidence_counts(gold(spark, sf_dir)).withColumnRenamed("each", "number")


@entry("evidence_coverage", f"WITH {GOLD}, d AS (SELECT DISTINCT doc_id, start_char, end_char FROM gold) SELECT count(*) AS spans, count(DISTINCT doc_id) AS holding, (SELECT count(*) FROM documents) AS documents, round(coalesce(sum(end_char - start_char), 0)::DOUBLE / (SELECT sum(length(coalesce(text, ''))) FROM documents), 9) AS coverage FROM d")
def evidence_coverage(spark, sf_dir):
    return diagnostics.evidence_coverage(gold(spark, sf_dir), docs(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


# --- contexts -----------------------------------------------------------------------------


def _dated(spark, sf_dir):
    """Documents with a title, a source and a date: the language, the source, and the date of the order with the document's number."""
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("published_at"))
    return docs(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("title"), "source").join(dates, "doc_id", "left")


HEADED = rf"""{MERGED},
h AS (SELECT p.question_id, p.rank, p.doc_id, p.start_char, p.end_char, o_orderdate, concat_ws(' ', lang || '.', concat_ws(', ', source, strftime(o_orderdate, '%B %-d, %Y')) || '.') || chr(10) || regexp_replace(p.text, '^\s+|\s+$', '', 'g') AS body
  FROM passages p JOIN documents d USING (doc_id) LEFT JOIN orders ON o_orderkey = p.doc_id),
t AS (SELECT *, sum(len(regexp_extract_all(body, '\S+'))) OVER (PARTITION BY question_id ORDER BY rank) AS running, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k FROM h),
kept AS (SELECT * FROM t WHERE k = 1 OR running <= 600)"""


@entry("assemble_headed", f"WITH {HEADED} SELECT question_id, rank::INTEGER AS rank, doc_id, start_char, end_char, md5(body) AS digest, row_number() OVER (PARTITION BY question_id ORDER BY o_orderdate NULLS LAST, doc_id, start_char)::INTEGER AS position FROM kept")
def assemble_headed(spark, sf_dir):
    """Merged passages under their headers, as many as 600 tokens hold, by date."""
    own = _dated(spark, sf_dir)
    placed = context.assemble(returned(spark, sf_dir), own, 10, unique=False, budget=600, order="chronological", header=True)
    body = context.passage_body(F.col("text"), F.col("header"))
    return placed.select("question_id", F.col("rank").cast("int").alias("rank"), "doc_id", "start_char", "end_char", F.md5(body.cast("binary")).alias("digest"), "position")


@entry("context_scores", f"""WITH {HEADED}, {GOLD}, z AS (SELECT question_id, count(*) AS passages FROM kept GROUP BY question_id),
r AS (SELECT g.question_id, g.span_no, max(CASE WHEN k.s < g.end_char AND g.start_char < k.e THEN 1 ELSE 0 END) AS held FROM gold g LEFT JOIN (SELECT question_id, doc_id, start_char AS s, end_char AS e FROM kept) k ON k.question_id = g.question_id AND k.doc_id = g.doc_id GROUP BY ALL)
SELECT question_id, 'context_passages' AS metric, passages::DOUBLE AS value FROM z UNION ALL SELECT question_id, 'context_recall', round(avg(held), 6) FROM r GROUP BY question_id UNION ALL SELECT question_id, 'context_full_support', min(held)::DOUBLE FROM r GROUP BY question_id""")
def context_scores(spark, sf_dir):
    """What the headed contexts hold of the gold spans."""
    placed = checkpointed(context.assemble(returned(spark, sf_dir), _dated(spark, sf_dir), 10, unique=False, budget=600, order="chronological", header=True))
    scores = metrics.context_scores(placed, context.contents(placed).select("question_id", "context_passages"), gold(spark, sf_dir))
    return scores.withColumn("value", F.round("value", 6))


@entry("passage_text", "SELECT doc_id, md5(lang || '. ' || source || '.' || chr(10) || text) AS digest FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def passage_text(spark, sf_dir):
    """What a reranker reads of each document under its header."""
    rows = docs(spark, sf_dir).where("text is not null and lang is not null and source is not null")
    line = T.header(F.col("lang"), F.col("source"), F.lit(None).cast("timestamp"))
    return rows.select("doc_id", F.md5(T.passage_text(F.col("text"), line).cast("binary")).alias("digest"))
