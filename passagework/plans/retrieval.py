"""Terms, BM25, dense lists, fusion and reranking over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stemming
from ..functions import text as T
from ..operators import dense, fusion, rerank, sparse
from .common import BM25_CTES, LIST_CTES, bm25_sql, docs, questions, table, terms_sql, vector_questions, vectors

ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


TERMS = T.terms


@entry("tokenize_terms", f"SELECT doc_id, len(t)::BIGINT AS n_terms, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)")
def tokenize_terms(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", TERMS(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def _posted(spark, sf_dir):
    """Postings of all terms, and the collection's size."""
    d = docs(spark, sf_dir)
    return sparse.postings(d, "doc_id", TERMS(F.col("text"))), sparse.collection(d, TERMS(F.col("text")))


@entry("bm25_postings", f"WITH {BM25_CTES} SELECT doc_id, term, tf::BIGINT AS tf, length::BIGINT AS length FROM p")
def bm25_postings(spark, sf_dir):
    return _posted(spark, sf_dir)[0].select("doc_id", "term", "tf", "length")


@entry("term_stats", f"WITH {BM25_CTES} SELECT term, df, cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM stats, size")
def term_stats(spark, sf_dir):
    posted, size = _posted(spark, sf_dir)
    return sparse.term_statistics(posted, size).withColumn("idf", F.round("idf", 6))


def _top(k: int, score: str, by: str = "question_id") -> str:
    return f"""
scored AS (SELECT {by}, doc_id, sum({score}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size GROUP BY {by}, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT {by}, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= {k}"""


@entry("bm25_topk", f"WITH {BM25_CTES}, {_top(10, bm25_sql())}")
def bm25_topk(spark, sf_dir):
    found = sparse.search(questions(spark, sf_dir), docs(spark, sf_dir), "doc_id", TERMS(F.col("text")))
    return found.select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@entry("bm25_tuned_stopwords_topk")
def bm25_tuned_stopwords_topk(spark, sf_dir):
    """Tuned settings: k1 0.8, b 1, stop words left out, stems instead of words."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), TERMS(F.col("text"), True).alias("terms"))
    found = sparse.search(asked, docs(spark, sf_dir), "doc_id", TERMS(F.col("text"), True), k1=0.8, b=1.0, stem=stemming.stem)
    return found.select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


HEADED = BM25_CTES.replace(terms_sql("text") + " AS terms FROM documents", terms_sql("concat_ws(chr(10), source || '. ' || lang || '.', text)") + " AS terms FROM documents")


@entry("bm25_header_topk", f"WITH {HEADED}, {_top(10, bm25_sql())}")
def bm25_header_topk(spark, sf_dir):
    """A header line of source and language is indexed with the text."""
    d = docs(spark, sf_dir).withColumn("headed", F.concat_ws("\n", T.header(F.col("source"), F.col("lang"), F.lit(None).cast("timestamp")), "text"))
    found = sparse.search(questions(spark, sf_dir), d, "doc_id", TERMS(F.col("headed")))
    return found.select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


GRID = [(k1, b) for k1 in (0.8, 1.2, 1.6) for b in (0.5, 0.75, 1.0)]


@entry("bm25_param_grid", f"""WITH {BM25_CTES}, grid AS (SELECT * FROM (VALUES {', '.join(f'({k}::DOUBLE, {b}::DOUBLE)' for k, b in GRID)}) g(k1, b)),
asked2 AS (SELECT * FROM asked, grid),
scored AS (SELECT k1, b, question_id, doc_id, sum({bm25_sql('k1', 'b')}) AS score FROM asked2 JOIN stats USING (term) JOIN p USING (term), size GROUP BY k1, b, question_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k1, b, question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
SELECT k1, b, question_id, doc_id, round(score, 6) AS score FROM ranked WHERE rank = 1""")
def bm25_param_grid(spark, sf_dir):
    """The best document under nine settings, in one job."""
    found = sparse.grid_search(questions(spark, sf_dir), docs(spark, sf_dir), "doc_id", TERMS(F.col("text")), 1, GRID)
    k1, b = (F.array(*[F.lit(float(s[n])) for s in GRID])[F.col("setting")] for n in (0, 1))
    return found.select(k1.alias("k1"), b.alias("b"), "question_id", "doc_id", F.round("score", 6).alias("score"))


@entry("porter_vocabulary")
def porter_vocabulary(spark, sf_dir):
    """The distinct terms of all documents with their stems."""
    return stemming.stems(docs(spark, sf_dir).select(F.explode(TERMS(F.col("text"))).alias("term")))


@entry("hash_embed")
def hash_embed(spark, sf_dir):
    return dense.hashed(docs(spark, sf_dir), "doc_id", F.col("text"))


def _lists(spark, sf_dir):
    """Two lists of twenty for each question: whole vectors, and their first sixteen components."""
    q, store = vector_questions(spark, sf_dir), vectors(spark, sf_dir)
    whole = dense.cosine_top(q, store, 20).withColumn("list_no", F.lit(0))
    part = dense.cosine_top(q, store, 20, 16).withColumn("list_no", F.lit(1))
    return whole.unionByName(part)


@entry("dense_topk", f"WITH {LIST_CTES} SELECT question_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM lists WHERE list_no = 0 AND rank <= 10")
def dense_topk(spark, sf_dir):
    return dense.cosine_top(vector_questions(spark, sf_dir), vectors(spark, sf_dir), 10).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@entry("dense_truncated_topk", f"WITH {LIST_CTES} SELECT question_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM lists WHERE list_no = 1 AND rank <= 10")
def dense_truncated_topk(spark, sf_dir):
    return dense.cosine_top(vector_questions(spark, sf_dir), vectors(spark, sf_dir), 10, 16).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _out(df):
    return df.select("question_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


FUSED = """, fused AS (SELECT question_id, chunk_id, {score} AS score, min((list_no, rank)) AS seen FROM {rows} GROUP BY question_id, chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, {decimals}) DESC, seen) AS rank FROM fused)
SELECT question_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 20"""


@entry("fuse_rrf", f"WITH {LIST_CTES}{FUSED.format(score='sum(1.0::DOUBLE / (60 + rank))', rows='lists', decimals=12)}")
def fuse_rrf(spark, sf_dir):
    return _out(fusion.reciprocal_rank(_lists(spark, sf_dir), "chunk_id", top=20))


@entry("fuse_rrf_weighted", f"WITH {LIST_CTES}{FUSED.format(score='sum(CASE list_no WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (10 + rank))', rows='lists', decimals=12)}")
def fuse_rrf_weighted(spark, sf_dir):
    return _out(fusion.reciprocal_rank(_lists(spark, sf_dir), "chunk_id", k=10.0, weights={0: 0.7, 1: 0.3}, top=20))


def _weighted_sql(shift: str, spread: str) -> str:
    norm = f"""normed AS (SELECT question_id, list_no, chunk_id, rank, CASE list_no WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END *
  coalesce((score - {shift} OVER w) / nullif({spread}, 0), 0) AS x FROM lists WINDOW w AS (PARTITION BY question_id, list_no)),
floors AS (SELECT question_id, list_no, min(x) AS floor FROM normed GROUP BY ALL),
every AS (SELECT question_id, sum(floor) AS floors FROM floors GROUP BY ALL),
gains AS (SELECT question_id, list_no, chunk_id, rank, x - floor AS g, floors FROM normed JOIN floors USING (question_id, list_no) JOIN every USING (question_id))"""
    return f"WITH {LIST_CTES}, {norm}{FUSED.format(score='sum(g) + any_value(floors)', rows='gains', decimals=9)}"


@entry("fuse_weighted_minmax", _weighted_sql("min(score)", "(max(score) OVER w - min(score) OVER w)"))
def fuse_weighted_minmax(spark, sf_dir):
    return _out(fusion.weighted(_lists(spark, sf_dir), "chunk_id", {0: 0.7, 1: 0.3}, "minmax", 20))


@entry("fuse_weighted_zscore", _weighted_sql("avg(score)", "stddev_pop(score) OVER w"))
def fuse_weighted_zscore(spark, sf_dir):
    return _out(fusion.weighted(_lists(spark, sf_dir), "chunk_id", {0: 0.7, 1: 0.3}, "zscore", 20))


ROBIN = """, first AS (SELECT question_id, chunk_id, min((rank, list_no)) AS seen FROM lists GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seen) AS rank FROM first)
SELECT question_id, chunk_id, round(1.0::DOUBLE / rank, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 20"""


@entry("fuse_round_robin", f"WITH {LIST_CTES}{ROBIN}")
def fuse_round_robin(spark, sf_dir):
    return _out(fusion.round_robin(_lists(spark, sf_dir), "chunk_id", 20))


@entry("hybrid_topk", f"""WITH {BM25_CTES},
scored AS (SELECT question_id, doc_id, sum({bm25_sql()}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size GROUP BY question_id, doc_id),
scored1 AS (SELECT question_id, doc_id, sum({bm25_sql('0.8', '1.0')}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size GROUP BY question_id, doc_id),
lists AS (SELECT *, 0 AS list_no, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored
  UNION ALL SELECT *, 1 AS list_no, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored1),
fused AS (SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list_no, rank)) AS seen FROM lists WHERE rank <= 200 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, seen) AS rank FROM fused)
SELECT question_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def hybrid_topk(spark, sf_dir):
    """Two BM25 settings to depth 200, fused; the corpus is read once."""
    found = sparse.grid_search(questions(spark, sf_dir), docs(spark, sf_dir), "doc_id", TERMS(F.col("text")), 200, [(1.2, 0.75), (0.8, 1.0)])
    return fusion.reciprocal_rank(found.withColumnRenamed("setting", "list_no"), "doc_id", top=10).select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@entry("collapse_spans", f"""WITH {LIST_CTES}, spans AS (SELECT question_id, rank, chunk_id, label FROM lists JOIN (SELECT vec_id AS chunk_id, label FROM embeddings) USING (chunk_id) WHERE list_no = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id, label ORDER BY rank) AS n FROM spans)
SELECT question_id, chunk_id, label, row_number() OVER (PARTITION BY question_id ORDER BY rank)::INTEGER AS rank FROM best WHERE n = 1""")
def collapse_spans(spark, sf_dir):
    """The label stands for the span that several chunks share."""
    q, store = vector_questions(spark, sf_dir), vectors(spark, sf_dir)
    ranked = dense.cosine_top(q, store, 20).join(store.select("chunk_id", "label"), "chunk_id")
    return fusion.collapse(ranked, ["label"]).select("question_id", "chunk_id", "label", F.col("rank").cast("int").alias("rank"))


SECOND = f"{LIST_CTES}, twice AS (SELECT l.question_id, l.chunk_id, l.rank, p.score AS new_score FROM lists l JOIN pairs p ON p.question_id = l.question_id AND p.chunk_id = l.chunk_id AND p.list_no = 1 WHERE l.list_no = 0)"


def _rescored(spark, sf_dir):
    """The whole-vector list with the cosine of the first sixteen components as a new score."""
    q, store = vector_questions(spark, sf_dir), vectors(spark, sf_dir)
    top = dense.cosine_top(q, store, 20).select("question_id", "chunk_id", "rank")
    own = top.join(store.select("chunk_id", dense.unit(F.col("vector"), 16).alias("c")), "chunk_id").join(q.select("question_id", dense.unit(F.col("vector"), 16).alias("q")), "question_id")
    return own.select("question_id", "chunk_id", "rank", dense.dot(F.col("q"), F.col("c")).alias("new_score"))


@entry("rerank_reorder", f"WITH {SECOND} SELECT question_id, chunk_id, rank::INTEGER AS rank, row_number() OVER (PARTITION BY question_id ORDER BY round(new_score, 9) DESC, rank)::INTEGER AS new_rank FROM twice")
def rerank_reorder(spark, sf_dir):
    return rerank.reorder(_rescored(spark, sf_dir)).select("question_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.col("new_rank").cast("int").alias("new_rank"))


@entry("rerank_head_tail", f"WITH {SECOND}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank > 10, CASE WHEN rank <= 10 THEN round(new_score, 9) END DESC, rank) AS new_rank FROM twice) SELECT question_id, chunk_id, rank::INTEGER AS rank, new_rank::INTEGER AS new_rank FROM r WHERE new_rank <= 15")
def rerank_head_tail(spark, sf_dir):
    return rerank.head_and_tail(_rescored(spark, sf_dir), 10, 15).select("question_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.col("new_rank").cast("int").alias("new_rank"))


@entry("rerank_merge_max", f"WITH {LIST_CTES}, m AS (SELECT question_id, chunk_id, max(score) AS score, min(rank) AS old FROM lists GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, old, chunk_id) AS rank FROM m) SELECT question_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def rerank_merge_max(spark, sf_dir):
    return _out(rerank.merge_max(_lists(spark, sf_dir), "chunk_id", 10))


@entry("rerank_pairs_cached", rf"""WITH {BM25_CTES}, scored AS (SELECT question_id, doc_id, sum({bm25_sql()}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size GROUP BY question_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored),
words AS (SELECT question_id, r.doc_id, rank, list_distinct(regexp_extract_all(lower(b.text), '\S+')) AS qw, list_distinct(regexp_extract_all(lower(t.text), '\S+')) AS pw FROM ranked r JOIN benchmark b ON b.item_id = question_id JOIN documents t ON t.doc_id = r.doc_id WHERE rank <= 10),
shares AS (SELECT question_id, doc_id, rank, CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(qw, pw)) / len(qw) END AS share FROM words)
SELECT question_id, doc_id, rank::INTEGER AS rank, round(share, 6) AS new_score, row_number() OVER (PARTITION BY question_id ORDER BY round(share, 9) DESC, rank)::INTEGER AS new_rank FROM shares""")
def rerank_pairs_cached(spark, sf_dir):
    """Each distinct question-passage pair of the BM25 lists scored once by the stand-in scorer."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    top = sparse.search(questions(spark, sf_dir), docs(spark, sf_dir), "doc_id", TERMS(F.col("text")))
    pairs = top.join(q, "question_id").join(docs(spark, sf_dir).select("doc_id", F.col("text").alias("passage")), "doc_id")
    scored = rerank.score_pairs(pairs.select("question_id", "doc_id", "rank", "question", "passage"))
    return rerank.reorder(scored).select("question_id", "doc_id", "rank", F.round("new_score", 6).alias("new_score"), "new_rank")
