"""Comparisons of runs and settings, answer scores, and the end-to-end path over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, diagnostics, models, sparse
from ..sources.tables import checkpointed
from . import pipeline
from .common import BM25_CTES, LIST_CTES, bm25_sql, chunk_ctes, docs, questions, table, terms_sql
from .evaluation import GOLD, gold
from .preparation import SPANS, _evidence
from .retrieval import GRID, _lists

ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


BOTH = f"{LIST_CTES}, wide AS (SELECT question_id, chunk_id, max(rank) FILTER (list_no = 0) AS first, max(rank) FILTER (list_no = 1) AS second, (chunk_id % 7) / 7.0::DOUBLE AS overlap FROM lists GROUP BY question_id, chunk_id)"


@entry("found_by", f"WITH {BOTH} SELECT CASE WHEN first <= 10 AND second <= 10 THEN 'both' WHEN first <= 10 THEN 'first only' WHEN second <= 10 THEN 'second only' ELSE 'neither' END AS found, count(*) AS spans, round(median(overlap), 6) AS median_overlap FROM wide GROUP BY found")
def found_by(spark, sf_dir):
    rank = lambda n: F.max(F.when(F.col("list_no") == n, F.col("rank")))
    wide = _lists(spark, sf_dir).groupBy("question_id", "chunk_id").agg(rank(0).alias("first"), rank(1).alias("second")).withColumn("overlap", (F.col("chunk_id") % 7) / F.lit(7.0))
    return diagnostics.found_by(wide, 10).withColumn("median_overlap", F.round("median_overlap", 6))


@entry("list_moves", f"WITH {LIST_CTES} SELECT a.question_id, a.chunk_id, a.rank::INTEGER AS rank, coalesce(b.rank, 0)::INTEGER AS other_rank FROM lists a LEFT JOIN lists b ON b.question_id = a.question_id AND b.chunk_id = a.chunk_id AND b.list_no = 1 WHERE a.list_no = 0")
def list_moves(spark, sf_dir):
    """The whole-vector list with each chunk's rank in the truncated one; 0 if it is not there."""
    lists = _lists(spark, sf_dir)
    final = lists.where("list_no = 0").select("question_id", "chunk_id", "rank")
    return diagnostics.moved(final, lists, "chunk_id").select("question_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.coalesce(F.col("found")[1], F.lit(0)).cast("int").alias("other_rank"))


THREE = "t AS (SELECT doc_id AS question_id, quality::DOUBLE AS a, (1 - toxic)::DOUBLE AS b, 0.5::DOUBLE AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), w AS (SELECT question_id, CASE WHEN a > b THEN 'first' WHEN b > a THEN 'second' ELSE 'tie' END AS winner, c - greatest(a, b) AS fused_gain FROM t)"


def _compared(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select(F.col("doc_id").alias("question_id"), "quality", "toxic")
    run = lambda c: rows.select("question_id", c.cast("double").alias("value"))
    return diagnostics.three_way(run(F.col("quality")), run(1 - F.col("toxic")), run(F.lit(0.5)))


@entry("three_way_wins", f"WITH {THREE} SELECT question_id, winner, fused_gain FROM w")
def three_way_wins(spark, sf_dir):
    return _compared(spark, sf_dir)


@entry("fusion_losses", f"WITH {THREE} SELECT question_id, winner, fused_gain FROM w WHERE fused_gain < -1e-9")
def fusion_losses(spark, sf_dir):
    return diagnostics.fusion_losses(_compared(spark, sf_dir))


@entry("failure_examples", "WITH r AS (SELECT l.doc_id, source, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'poor' END AS kind FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1 OR quality = 0), f AS (SELECT *, row_number() OVER (PARTITION BY kind, source ORDER BY doc_id) AS n FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS k FROM f WHERE n = 1) SELECT doc_id, source, kind FROM g WHERE k <= 5")
def failure_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return diagnostics.picked(rows.select("doc_id", "source", F.when(F.col("toxic") == 1, "toxic").otherwise("poor").alias("kind")), "kind", "source", "doc_id")


@entry("tuning_argmax", f"""WITH {BM25_CTES}, grid AS (SELECT * FROM (VALUES {', '.join(f'({n}, {k}::DOUBLE, {b}::DOUBLE)' for n, (k, b) in enumerate(GRID))}) g(ordinal, k1, b)),
scored AS (SELECT ordinal, k1, b, question_id, doc_id, sum({bm25_sql('k1', 'b')}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size, grid GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ordinal, question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored),
hit AS (SELECT r.*, contains(d.text, q.text)::INTEGER::DOUBLE AS value FROM ranked r JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = r.question_id WHERE rank = 1)
SELECT ordinal, k1, b, round(avg(value), 6) AS mean, count(*) AS n FROM hit GROUP BY ordinal, k1, b ORDER BY round(avg(value), 9) DESC, ordinal LIMIT 1""")
def tuning_argmax(spark, sf_dir):
    """The setting whose best document holds the item verbatim most often; ties to the first."""
    grid = spark.createDataFrame([(n, float(k1), float(b)) for n, (k1, b) in enumerate(GRID)], "ordinal int, k1 double, b double")
    top = sparse.grid_search(questions(spark, sf_dir), docs(spark, sf_dir), "doc_id", T.terms(F.col("text")), 1, GRID).withColumnRenamed("setting", "ordinal")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("item"))
    hits = top.join(F.broadcast(grid), "ordinal").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id").join(items, "question_id")
    return diagnostics.best_setting(hits.withColumn("value", F.col("text").contains(F.col("item")).cast("double")), ["k1", "b"]).withColumn("mean", F.round("mean", 6))


@entry("term_overlap", rf"WITH {GOLD}, t AS (SELECT g.question_id, g.span_no, list_distinct({terms_sql('d.text')}) AS own, list_distinct({terms_sql('b.text')}) AS asked FROM gold g JOIN benchmark b ON b.item_id = g.question_id JOIN documents d USING (doc_id)) SELECT question_id, span_no, round(CASE WHEN len(own) = 0 THEN 0 ELSE len(list_intersect(own, asked)) / len(own) END, 6) AS overlap FROM t")
def term_overlap(spark, sf_dir):
    """The share of a gold document's terms that its item has."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), T.terms(F.col("text")).alias("asked"))
    rows = gold(spark, sf_dir).select("question_id", "span_no", "doc_id").join(docs(spark, sf_dir).select("doc_id", T.terms(F.col("text")).alias("own")), "doc_id").join(items, "question_id")
    return rows.select("question_id", "span_no", F.round(diagnostics.term_overlap(F.col("own"), F.col("asked")), 6).alias("overlap"))


@entry("evidence_profile", f"WITH {GOLD} SELECT least(4, floor(start_char * 5 / length(d.text)))::INTEGER AS part, count(*) AS n FROM gold JOIN documents d USING (doc_id) WHERE length(d.text) > 0 GROUP BY part")
def evidence_profile(spark, sf_dir):
    return diagnostics.evidence_profile(gold(spark, sf_dir), docs(spark, sf_dir))


@entry("evidence_uses", f"WITH {SPANS} SELECT span, count(DISTINCT question_id) AS uses FROM e GROUP BY span ORDER BY uses DESC, span LIMIT 10")
def evidence_uses(spark, sf_dir):
    return diagnostics.evidence_uses(_evidence(spark, sf_dir)[0])


@entry("list_parity", f"""WITH {LIST_CTES}, x AS (SELECT question_id, list_no, list(chunk_id ORDER BY rank) AS ks, list(round(score, 6) ORDER BY rank) AS ss FROM lists GROUP BY question_id, list_no)
SELECT count(*) AS questions, count(*) FILTER (a.ss = b.ss) AS same_scores, count(*) FILTER (list_sort(a.ks) = list_sort(b.ks)) AS same_set, count(*) FILTER (a.ks = b.ks) AS same_order FROM x a JOIN x b USING (question_id) WHERE a.list_no = 0 AND b.list_no = 1""")
def list_parity(spark, sf_dir):
    lists = _lists(spark, sf_dir).withColumnRenamed("chunk_id", "key")
    return diagnostics.parity(lists.where("list_no = 0"), lists.where("list_no = 1"))


@entry("answer_scores", """WITH a AS (SELECT doc_id AS question_id, toxic = 1 AS nul, CASE doc_id % 4 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'The yes' WHEN 2 THEN 'Insufficient information.' ELSE 'Another answer' END AS answer, doc_id % 4 AS k, quality = 1 AS jc FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
m AS (SELECT *, CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS match, k = 2 AS declined FROM a),
c AS (SELECT *, coalesce(match, jc, false)::INTEGER::DOUBLE AS correct FROM m)
SELECT question_id, 'correct' AS metric, correct AS value FROM c UNION ALL
SELECT question_id, 'judge_agrees_with_match', (jc = match)::INTEGER::DOUBLE FROM c WHERE match IS NOT NULL UNION ALL
SELECT question_id, 'exact_match', coalesce(match, false)::INTEGER::DOUBLE FROM c UNION ALL
SELECT question_id, 'judged', (match IS NULL)::INTEGER::DOUBLE FROM c UNION ALL
SELECT question_id, 'abstain_null', correct FROM c WHERE nul UNION ALL
SELECT question_id, 'correct_answerable', correct FROM c WHERE NOT nul UNION ALL
SELECT question_id, 'false_abstain', declined::INTEGER::DOUBLE FROM c WHERE NOT nul""")
def answer_scores(spark, sf_dir):
    k = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    answer = F.when(k == 0, "Yes.").when(k == 1, "The yes").when(k == 2, "Insufficient information.").otherwise("Another answer")
    null = F.lit(None).cast("boolean")
    return models.answer_scores(rows.select(F.col("doc_id").alias("question_id"), F.when(F.col("toxic") == 1, "null_query").otherwise("inference").alias("question_type"), answer.alias("answer"), F.lit("yes").alias("reference"), (F.col("quality") == 1).alias("judge_correct"), null.alias("judge_faithful"), null.alias("full_support")))


@entry("gold_context", f"WITH {GOLD} SELECT question_id, span_no, 'gold:' || doc_id || ':' || start_char AS chunk_id, md5(substring(d.text, (start_char + 1)::BIGINT, (end_char - start_char)::BIGINT)) AS digest FROM gold JOIN documents d USING (doc_id)")
def gold_context(spark, sf_dir):
    """The gold spans themselves as passages."""
    rows = gold(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    cut = F.substring(F.col("text"), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    return rows.select("question_id", "span_no", F.concat_ws(":", F.lit("gold"), F.col("doc_id").cast("string"), F.col("start_char").cast("string")).alias("chunk_id"), F.md5(cut.cast("binary")).alias("digest"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@entry("transform_decompose", r"""WITH w AS (SELECT item_id AS question_id, regexp_extract_all(text, '\S+') AS w FROM benchmark),
l AS (SELECT question_id, unnest(range(0, len(w), 5)) AS i, w FROM w), t AS (SELECT question_id, i, array_to_string(w[i + 1:i + 5], ' ') AS text FROM l),
f AS (SELECT question_id, min(i) AS i, arg_min(text, i) AS text FROM t GROUP BY question_id, lower(text)), o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY i) AS query_no FROM f)
SELECT question_id, query_no::INTEGER AS query_no, text, 'sub-question' AS role FROM o WHERE query_no <= 4""")
def transform_decompose(spark, sf_dir):
    """The stand-in splits a question into lines of five words; at most four sub-questions are the feature."""
    return models.transform(_asked(spark, sf_dir), "decompose").select("question_id", "query_no", "text", "role")


@entry("followup_rewrite", r"""WITH h AS (SELECT conv_id, turn, role, text, coalesce(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations),
u AS (SELECT *, trim(string_split(left(text || chr(10) || history, 200), chr(10))[1]) AS first FROM h WHERE role = 'user')
SELECT conv_id, turn, text AS asked, CASE WHEN history = '' OR first = '' THEN text ELSE first END AS question FROM u""")
def followup_rewrite(spark, sf_dir):
    return models.standalone(table(spark, sf_dir, "conversations"))


@entry("rerank_listwise", f"""WITH {BM25_CTES}, scored AS (SELECT question_id, doc_id, sum({bm25_sql()}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size GROUP BY question_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank, count(*) OVER (PARTITION BY question_id) AS n FROM scored)
SELECT question_id, doc_id AS chunk_id, rank::INTEGER AS rank, (CASE WHEN n > 1 AND rank <= 2 THEN 3 - rank ELSE rank END)::INTEGER AS new_rank FROM ranked WHERE rank <= 10""")
def rerank_listwise(spark, sf_dir):
    """The stand-in puts the second passage before the first."""
    top = sparse.search(questions(spark, sf_dir), docs(spark, sf_dir), "doc_id", T.terms(F.col("text")))
    rows = top.join(_asked(spark, sf_dir), "question_id").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return models.listwise(rows).select("question_id", "chunk_id", "rank", "new_rank")


SETTINGS = pipeline.Settings(retriever=pipeline.Component("sparse"), top_k=5, reranker=pipeline.Component("overlap"), rerank_depth=20)


#: CTEs up to reranked (question_id, rank, chunk_id, doc_id, start_char, end_char, text): the twenty best chunks by the share of the question's words that they have, the first five.
RERANKED = rf"""{chunk_ctes(128)},
{BM25_CTES.replace('SELECT doc_id,', 'SELECT chunk_id,').replace('any_value(length) AS length FROM long GROUP BY doc_id', 'any_value(length) AS length FROM long GROUP BY chunk_id').replace('FROM documents', 'FROM chunk')},
scored AS (SELECT question_id, chunk_id, sum({bm25_sql()}) AS score FROM asked JOIN stats USING (term) JOIN p USING (term), size GROUP BY question_id, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored),
words AS (SELECT r.question_id, r.rank, chunk.*, list_distinct(regexp_extract_all(lower(b.text), '\S+')) AS qw, list_distinct(regexp_extract_all(lower(chunk.text), '\S+')) AS pw FROM ranked r JOIN chunk USING (chunk_id) JOIN benchmark b ON b.item_id = r.question_id WHERE r.rank <= 20),
shares AS (SELECT *, CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(qw, pw)) / len(qw) END AS share FROM words),
placed AS (SELECT question_id, chunk_id, doc_id, start_char, end_char, text, row_number() OVER (PARTITION BY question_id ORDER BY round(share, 9) DESC, rank) AS rank FROM shares),
reranked AS (SELECT * FROM placed WHERE rank <= 5)"""


@entry("ask_end_to_end", rf"""WITH {RERANKED}, n AS (SELECT *, row_number() OVER (PARTITION BY question_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY rank) AS k FROM reranked),
opened AS (SELECT *, CASE WHEN start_char <= max(end_char) OVER (PARTITION BY question_id, doc_id ORDER BY start_char, end_char, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM n WHERE k = 1),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY question_id, doc_id ORDER BY start_char, end_char, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM opened),
merged AS (SELECT question_id, doc_id, min(start_char) AS start_char, max(end_char) AS end_char, min(rank) AS rank FROM islands GROUP BY question_id, doc_id, island),
best AS (SELECT question_id, arg_min((doc_id, start_char, end_char), rank) AS x FROM merged GROUP BY question_id)
SELECT question_id, md5(left(regexp_replace(substring(d.text, (x[2] + 1)::BIGINT, (x[3] - x[2])::BIGINT), '^\s+|\s+$', '', 'g'), 200)) AS digest FROM best JOIN documents d ON d.doc_id = x[1]""")
def ask_end_to_end(spark, sf_dir):
    """Cut, search, rerank, assemble, prompt and answer, with the stand-ins: the answer is the beginning of the first passage."""
    rows = docs(spark, sf_dir).select("doc_id", "text")
    return pipeline.ask(_asked(spark, sf_dir), rows, chunking.fixed(rows, 128), SETTINGS).select("question_id", F.md5(F.col("answer").cast("binary")).alias("digest"))


@entry("evaluate_end_to_end", f"""WITH {RERANKED}, {GOLD},
total AS (SELECT g.question_id, count(DISTINCT (c.doc_id, c.start_char, c.end_char)) FILTER (c.doc_id IS NOT NULL) AS total FROM gold g LEFT JOIN chunk c ON c.doc_id = g.doc_id AND c.start_char < g.end_char AND g.start_char < c.end_char GROUP BY g.question_id),
spans AS (SELECT g.question_id, g.span_no, min(c.rank) AS r FROM gold g LEFT JOIN reranked c ON c.question_id = g.question_id AND c.doc_id = g.doc_id AND c.start_char < g.end_char AND g.start_char < c.end_char GROUP BY g.question_id, g.span_no),
ks AS (SELECT unnest([1, 5, 10]) AS k),
hits AS (SELECT c.question_id, c.rank, bool_or(g.doc_id IS NOT NULL) AS hit FROM reranked c LEFT JOIN gold g ON c.question_id = g.question_id AND c.doc_id = g.doc_id AND c.start_char < g.end_char AND g.start_char < c.end_char GROUP BY ALL),
own AS (SELECT question_id, min(rank) FILTER (hit) AS first, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY question_id)
SELECT question_id, 'recall@' || k AS metric, round(avg(coalesce(r <= k, false)::INTEGER), 6) AS value FROM spans, ks GROUP BY question_id, k UNION ALL
SELECT question_id, 'full_support@' || k, min(coalesce(r <= k, false)::INTEGER)::DOUBLE FROM spans, ks GROUP BY question_id, k UNION ALL
SELECT question_id, 'mrr', round(coalesce(1.0::DOUBLE / first, 0), 6) FROM total LEFT JOIN own USING (question_id) UNION ALL
SELECT question_id, 'ndcg', round(CASE WHEN total = 0 THEN 0 ELSE coalesce(dcg / list_sum(list_transform(range(1, least(total, 10) + 1), lambda r: 1 / log2(r + 1))), 0) END, 6) FROM total LEFT JOIN own USING (question_id)""")
def evaluate_end_to_end(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text")
    found = pipeline.evaluate(_asked(spark, sf_dir), checkpointed(gold(spark, sf_dir)), chunking.fixed(rows, 128), SETTINGS)
    return found.withColumn("value", F.round("value", 6))


@entry("semantic_distance_breaks", r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\s*\S[^\n]*(?:\n(?:[^\S\n]*\n)*(?:[^\S\n]+$)?)?') AS t FROM documents),
l AS (SELECT doc_id, t, unnest(range(0, len(t))) AS i FROM t),
w AS (SELECT doc_id, i + 1 AS n, unnest(regexp_extract_all(lower(t[i + 1]), '[\p{L}\p{N}_]+')) AS w FROM l),
v AS (SELECT doc_id, n, ('0x' || md5(w)[1:2])::INTEGER AS b, count(*)::DOUBLE AS x FROM w GROUP BY ALL),
norm AS (SELECT doc_id, n, sqrt(sum(x * x)) AS len FROM v GROUP BY ALL),
dot AS (SELECT p.doc_id, p.n, sum(p.x * q.x) AS dot FROM v p JOIN v q ON q.doc_id = p.doc_id AND q.n = p.n + 1 AND q.b = p.b GROUP BY ALL),
gap AS (SELECT a.doc_id, a.n, round(1 - coalesce(dot, 0) / (a.len * b.len), 9) AS gap FROM norm a JOIN norm b ON b.doc_id = a.doc_id AND b.n = a.n + 1 LEFT JOIN dot ON dot.doc_id = a.doc_id AND dot.n = a.n),
m AS (SELECT doc_id, round(quantile_cont(gap, 0.9), 9) AS most FROM gap GROUP BY doc_id)
SELECT doc_id, n::INTEGER AS n, round(gap, 6) AS gap FROM gap JOIN m USING (doc_id) WHERE gap > most""")
def semantic_distance_breaks(spark, sf_dir):
    """Where a document's neighbouring lines differ most, by windows alone: cosine of hashed words, cut above the 90th percentile."""
    lines = chunking.lines(docs(spark, sf_dir))
    words = lines.select("doc_id", "chunk_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    v = words.groupBy("doc_id", "chunk_id", F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 2), 16, 10).cast("int").alias("b")).agg(F.count("*").cast("double").alias("x"))
    line = Window.partitionBy("doc_id").orderBy("start_char")
    order = lines.select("doc_id", "chunk_id", F.row_number().over(line).alias("n"))
    a = v.join(order, ["doc_id", "chunk_id"])
    norm = a.groupBy("doc_id", "n").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    dot = a.alias("p").join(a.alias("q"), (F.col("p.doc_id") == F.col("q.doc_id")) & (F.col("q.n") == F.col("p.n") + 1) & (F.col("p.b") == F.col("q.b"))).groupBy("p.doc_id", "p.n").agg(F.sum(F.col("p.x") * F.col("q.x")).alias("dot"))
    near = norm.join(norm.select("doc_id", (F.col("n") - 1).alias("n"), F.col("len").alias("next")), ["doc_id", "n"]).join(dot, ["doc_id", "n"], "left")
    gap = near.select("doc_id", "n", F.round(1 - F.coalesce("dot", F.lit(0.0)) / (F.col("len") * F.col("next")), 9).alias("gap"))
    limit = F.round(F.percentile("gap", F.lit(0.9)).over(Window.partitionBy("doc_id")), 9)
    return gap.withColumn("limit", limit).where("gap > limit").select("doc_id", "n", F.round("gap", 6).alias("gap"))
