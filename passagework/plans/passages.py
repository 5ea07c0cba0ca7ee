"""Chunks, context assembly and prompts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, dense, sparse
from ..sources.tables import checkpointed
from .common import BM25_CTES, bm25_sql, chunk_ctes, docs, questions, table, vector_questions, vectors

ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


COLUMNS = ("doc_id", "chunk_id", "start_char", "end_char", "n_tokens", "digest")


def _fixed(spark, sf_dir, size, overlap=0):
    rows = chunking.fixed(docs(spark, sf_dir), size, overlap)
    return rows.select("doc_id", "chunk_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), F.col("n_tokens").cast("long").alias("n_tokens"), F.md5(F.col("text").cast("binary")).alias("digest"))


@entry("chunk_fixed", f"WITH {chunk_ctes(128)} SELECT doc_id, chunk_id, start_char, end_char, n_tokens::BIGINT AS n_tokens, md5(text) AS digest FROM chunk")
def chunk_fixed(spark, sf_dir):
    return _fixed(spark, sf_dir, 128)


@entry("chunk_fixed_overlap", f"WITH {chunk_ctes(128, 32)} SELECT doc_id, chunk_id, start_char, end_char, n_tokens::BIGINT AS n_tokens, md5(text) AS digest FROM chunk")
def chunk_fixed_overlap(spark, sf_dir):
    return _fixed(spark, sf_dir, 128, 32)


@entry("chunk_lines", r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\s*\S[^\n]*(?:\n(?:[^\S\n]*\n)*(?:[^\S\n]+$)?)?') AS t FROM documents),
n AS (SELECT doc_id, t, unnest(range(0, len(t))) AS i FROM t)
SELECT doc_id, doc_id::VARCHAR || ':' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, '0') AS chunk_id, length(array_to_string(t[1:i], '')) AS start_char, length(array_to_string(t[1:i + 1], '')) AS end_char, md5(t[i + 1]) AS digest FROM n""")
def chunk_lines(spark, sf_dir):
    rows = chunking.lines(docs(spark, sf_dir))
    return rows.select("doc_id", "chunk_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), F.md5(F.col("text").cast("binary")).alias("digest"))


@entry("chunk_profile", f"WITH {chunk_ctes(128)} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, round(avg(n_tokens), 6) AS mean_tokens, min(n_tokens)::BIGINT AS least, max(n_tokens)::BIGINT AS most, count(*) FILTER (n_tokens >= 128) AS at_limit, count(*) FILTER (n_tokens < 100) AS short FROM chunk")
def chunk_profile(spark, sf_dir):
    rows = chunking.profile(chunking.fixed(docs(spark, sf_dir), 128), F.col("n_tokens"), 128)
    return rows.withColumns({"mean_tokens": F.round("mean_tokens", 6), "least": F.col("least").cast("long"), "most": F.col("most").cast("long")})


def _spans(rows):
    return rows.select("chunk_id", "doc_id", "start_char", "end_char", F.md5(F.col("text").cast("binary")).alias("digest"))


@entry("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return _spans(chunking.structure_chunks(docs(spark, sf_dir), "recursive", 128))


@entry("chunk_recursive_overlap")
def chunk_recursive_overlap(spark, sf_dir):
    return _spans(chunking.structure_chunks(docs(spark, sf_dir), "recursive", 128, 32))


@entry("chunk_paragraph")
def chunk_paragraph(spark, sf_dir):
    return _spans(chunking.structure_chunks(docs(spark, sf_dir), "paragraph", 128))


@entry("chunk_sentence")
def chunk_sentence(spark, sf_dir):
    return _spans(chunking.structure_chunks(docs(spark, sf_dir), "sentence", 128))


@entry("chunk_parent_child")
def chunk_parent_child(spark, sf_dir):
    rows = chunking.parent_child(docs(spark, sf_dir), 256, 64)
    return rows.select("chunk_id", "parent_id", "doc_id", "start_char", "end_char", "child_start", "child_end", F.md5(F.coalesce("embed_text", "text").cast("binary")).alias("digest"))


@entry("chunk_semantic")
def chunk_semantic(spark, sf_dir):
    return _spans(chunking.semantic(docs(spark, sf_dir), max_size=128))


#: The ten best chunks of 128 tokens (overlap 32) for each question, by BM25 over chunks: returned (question_id, rank, chunk_id, doc_id, start_char, end_char, text).
RETURNED = f"""{chunk_ctes(128, 32)},
{BM25_CTES.replace('SELECT doc_id,', 'SELECT chunk_id,').replace('any_value(length) AS length FROM long GROUP BY doc_id', 'any_value(length) AS length FROM long GROUP BY chunk_id').replace('FROM documents', 'FROM chunk')},
scored AS (SELECT question_id, chunk_id, sum({bm25_sql()}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size GROUP BY question_id, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored),
returned AS (SELECT question_id, rank, chunk_id, doc_id, start_char, end_char, text, score FROM ranked JOIN chunk USING (chunk_id) WHERE rank <= 10)
"""


def found(spark, sf_dir):
    """The same without the text: question_id, rank, chunk_id, doc_id, start_char, end_char, score."""
    chunks = chunking.fixed(docs(spark, sf_dir), 128, 32).withColumns({c: F.col(c).cast("long") for c in ("start_char", "end_char")})
    top = sparse.search(questions(spark, sf_dir), chunks, "chunk_id", T.terms(F.col("text")), carry=("doc_id", "start_char", "end_char"))
    return top.select("question_id", "rank", "chunk_id", "doc_id", "start_char", "end_char", "score")


def returned(spark, sf_dir):
    """With the text, cut from the documents that have a ranked chunk."""
    top = checkpointed(found(spark, sf_dir))  # ten rows per question
    return chunking.with_text(top, docs(spark, sf_dir)).select("question_id", "rank", "chunk_id", "doc_id", "start_char", "end_char", "text", "score")


@entry("chunk_bm25_topk", f"WITH {RETURNED} SELECT question_id, rank::INTEGER AS rank, chunk_id, doc_id, start_char, end_char, round(score, 6) AS score FROM returned")
def chunk_bm25_topk(spark, sf_dir):
    return found(spark, sf_dir).withColumn("score", F.round("score", 6))


@entry("dedupe_text", f"WITH {RETURNED}, n AS (SELECT *, row_number() OVER (PARTITION BY question_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY rank) AS k FROM returned) SELECT question_id, rank::INTEGER AS rank, chunk_id FROM n WHERE k = 1")
def dedupe_text(spark, sf_dir):
    return context.dedupe(returned(spark, sf_dir)).select("question_id", "rank", "chunk_id")


MERGED = f"""{RETURNED},
opened AS (SELECT *, CASE WHEN start_char <= max(end_char) OVER (PARTITION BY question_id, doc_id ORDER BY start_char, end_char, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM returned),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY question_id, doc_id ORDER BY start_char, end_char, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM opened),
merged AS (SELECT question_id, doc_id, min(start_char) AS start_char, max(end_char) AS end_char, min(rank) AS rank, count(*) AS n_chunks FROM islands GROUP BY question_id, doc_id, island),
passages AS (SELECT m.*, substring(d.text, (start_char + 1)::BIGINT, (end_char - start_char)::BIGINT) AS text FROM merged m JOIN documents d USING (doc_id))
"""


def _passages(spark, sf_dir):
    return context.stitched(context.merge_neighbours(returned(spark, sf_dir)), docs(spark, sf_dir))


@entry("merge_neighbours", f"WITH {MERGED} SELECT question_id, doc_id, start_char, end_char, rank::INTEGER AS rank, n_chunks, md5(text) AS digest FROM passages")
def merge_neighbours(spark, sf_dir):
    return _passages(spark, sf_dir).select("question_id", "doc_id", "start_char", "end_char", "rank", "n_chunks", F.md5(F.col("text").cast("binary")).alias("digest"))


@entry("order_edges", f"""WITH {MERGED}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k, count(*) OVER (PARTITION BY question_id) AS n FROM passages)
SELECT question_id, rank::INTEGER AS rank, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN (n - k) % 2 = 0 THEN k - n ELSE n - k END)::INTEGER AS position FROM r""")
def order_edges(spark, sf_dir):
    return context.order_edges(_passages(spark, sf_dir)).select("question_id", "rank", "position")


@entry("order_chronological", f"""WITH {MERGED} SELECT question_id, p.rank::INTEGER AS rank, row_number() OVER (PARTITION BY question_id ORDER BY o_orderdate NULLS LAST, p.doc_id, p.start_char)::INTEGER AS position FROM passages p LEFT JOIN orders ON o_orderkey = p.doc_id""")
def order_chronological(spark, sf_dir):
    """The date of the order with the document's number stands for the article's."""
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    rows = _passages(spark, sf_dir).join(dates, "doc_id", "left")
    return context.order_chronological(rows, F.col("o_orderdate")).select("question_id", "rank", "position")


@entry("token_budget", rf"""WITH {MERGED}, s AS (SELECT *, sum(len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY question_id ORDER BY rank) AS running_tokens, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k FROM passages)
SELECT question_id, rank::INTEGER AS rank, running_tokens::BIGINT AS running_tokens FROM s WHERE k = 1 OR running_tokens <= 500""")
def token_budget(spark, sf_dir):
    return context.within_tokens(_passages(spark, sf_dir), context.token_count(F.col("text")), 500).select("question_id", "rank", "running_tokens")


RENDER = rf"""body AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM passages),
blocks AS (SELECT question_id, '<passages>' || chr(10) || string_agg('<passage id="' || i || '">' || chr(10) || body || chr(10) || '</passage>', chr(10) || chr(10) ORDER BY i) || chr(10) || '</passages>' AS passages FROM body GROUP BY question_id)"""


@entry("render_prompt", f"WITH {MERGED}, {RENDER} SELECT question_id, md5(passages || chr(10) || chr(10) || 'Question: ' || b.text) AS digest, length(passages)::BIGINT AS n_chars FROM blocks JOIN benchmark b ON b.item_id = question_id")
def render_prompt(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    blocks = context.rendered(_passages(spark, sf_dir))
    return context.prompts(asked, blocks).join(blocks, "question_id").select("question_id", F.md5(F.col("user").cast("binary")).alias("digest"), F.length("passages").cast("long").alias("n_chars"))


@entry("echo_answer", f"WITH {MERGED} SELECT question_id, left(arg_min(text, rank), 200) AS answer FROM passages GROUP BY question_id")
def echo_answer(spark, sf_dir):
    return context.echo_answers(_passages(spark, sf_dir))


ASSEMBLED = rf"""{RETURNED},
uniq AS (SELECT *, row_number() OVER (PARTITION BY question_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY rank) AS k FROM returned),
chosen AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM uniq WHERE k = 1),
opened AS (SELECT *, CASE WHEN start_char <= max(end_char) OVER (PARTITION BY question_id, doc_id ORDER BY start_char, end_char, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM chosen WHERE place <= 6),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY question_id, doc_id ORDER BY start_char, end_char, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM opened),
merged AS (SELECT question_id, doc_id, min(start_char) AS start_char, max(end_char) AS end_char, min(rank) AS rank FROM islands GROUP BY question_id, doc_id, island),
sized AS (SELECT m.*, sum(len(regexp_extract_all(substring(d.text, (start_char + 1)::BIGINT, (end_char - start_char)::BIGINT), '\S+'))) OVER (PARTITION BY question_id ORDER BY rank) AS running, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i FROM merged m JOIN documents d USING (doc_id)),
fits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS r, count(*) OVER (PARTITION BY question_id) AS n FROM sized WHERE i = 1 OR running <= 600)"""


@entry("assemble_context", f"WITH {ASSEMBLED} SELECT question_id, doc_id, rank::INTEGER AS rank, start_char, end_char, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN (n - r) % 2 = 0 THEN r - n ELSE n - r END)::INTEGER AS position FROM fits")
def assemble_context(spark, sf_dir):
    rows = context.assemble(returned(spark, sf_dir), docs(spark, sf_dir), 6, pool=10, budget=600, order="edges")
    return rows.select("question_id", "doc_id", F.col("rank").cast("int").alias("rank"), "start_char", "end_char", "position")


@entry("mmr_select")
def mmr_select(spark, sf_dir):
    q, store = vector_questions(spark, sf_dir), vectors(spark, sf_dir)
    pool = dense.cosine_top(q, store, 20).withColumn("relevance", context.min_max(F.col("score"), "question_id"))
    rows = pool.join(dense.vectors_for(pool, store), "chunk_id").select("question_id", "chunk_id", "rank", "relevance", "vector")
    return context.mmr(rows, "chunk_id", 5)
