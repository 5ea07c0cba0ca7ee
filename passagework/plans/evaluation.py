"""Gold spans, metrics, agreement and comparisons over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, dataset, metrics, stats
from ..sources.tables import checkpointed
from .common import chunk_ctes, docs, table
from .passages import RETURNED, found, returned

ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


#: Where a benchmark item stands verbatim in a document.
GOLD = """gold AS (SELECT item_id AS question_id, (row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1) AS span_no, doc_id, strpos(d.text, b.text) - 1 AS start_char, strpos(d.text, b.text) - 1 + length(b.text) AS end_char
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(trim(b.text)) > 0)"""


def gold(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("fact"))
    held = dataset.verbatim(docs(spark, sf_dir).select("doc_id", "text"), items)
    at = F.expr("locate(fact, text)") - 1
    number = F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id")) - 1
    return held.select("question_id", number.cast("long").alias("span_no"), "doc_id", at.cast("long").alias("start_char"), (at + F.length("fact")).cast("long").alias("end_char"))


def _with_gold(rows, spans):
    """The documents that hold a gold span; only these need to be cut."""
    return rows.join(spans.select("doc_id").distinct(), "doc_id", "left_semi")


@entry("gold_spans", f"WITH {GOLD} SELECT * FROM gold")
def gold_spans(spark, sf_dir):
    return gold(spark, sf_dir)


RANKS = f"""{RETURNED}, {GOLD}, gold_ranks AS (SELECT g.question_id, g.span_no, min(c.rank) AS gold_rank FROM gold g LEFT JOIN returned c ON c.question_id = g.question_id AND c.doc_id = g.doc_id AND c.start_char < g.end_char AND g.start_char < c.end_char GROUP BY g.question_id, g.span_no)"""


@entry("gold_ranks", f"WITH {RANKS} SELECT question_id, span_no, coalesce(gold_rank, 0)::INTEGER AS gold_rank FROM gold_ranks")
def gold_ranks(spark, sf_dir):
    """0 stands for a span that no chunk of the list overlaps."""
    return metrics.gold_ranks(found(spark, sf_dir), gold(spark, sf_dir)).withColumn("gold_rank", F.coalesce("gold_rank", F.lit(0)))


RELEVANT = """total AS (SELECT g.question_id, count(DISTINCT (c.doc_id, c.start_char, c.end_char)) FILTER (c.doc_id IS NOT NULL) AS total FROM gold g LEFT JOIN chunk c ON c.doc_id = g.doc_id AND c.start_char < g.end_char AND g.start_char < c.end_char GROUP BY g.question_id)"""


@entry("count_relevant", f"WITH {chunk_ctes(128, 32)}, {GOLD}, {RELEVANT} SELECT question_id, total FROM total")
def count_relevant(spark, sf_dir):
    spans = checkpointed(gold(spark, sf_dir))
    return metrics.count_relevant(chunking.fixed(_with_gold(docs(spark, sf_dir), spans), 128, 32), spans)


SCORES = f"""{RANKS}, {RELEVANT},
hits AS (SELECT c.question_id, c.rank, bool_or(g.doc_id IS NOT NULL) AS hit FROM returned c LEFT JOIN gold g ON c.question_id = g.question_id AND c.doc_id = g.doc_id AND c.start_char < g.end_char AND g.start_char < c.end_char GROUP BY ALL),
own AS (SELECT question_id, min(rank) FILTER (hit) AS first, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY question_id),
wide AS (SELECT question_id, avg(coalesce(gold_rank <= 5, false)::INTEGER) AS r5, min(coalesce(gold_rank <= 5, false)::INTEGER) AS f5, avg(coalesce(gold_rank <= 10, false)::INTEGER) AS r10, min(coalesce(gold_rank <= 10, false)::INTEGER) AS f10 FROM gold_ranks GROUP BY question_id),
scores AS (
  SELECT question_id, 'recall@5' AS metric, r5::DOUBLE AS value FROM wide UNION ALL SELECT question_id, 'full_support@5', f5 FROM wide UNION ALL
  SELECT question_id, 'recall@10', r10 FROM wide UNION ALL SELECT question_id, 'full_support@10', f10 FROM wide UNION ALL
  SELECT question_id, 'mrr', coalesce(1.0::DOUBLE / first, 0) FROM total LEFT JOIN own USING (question_id) UNION ALL
  SELECT question_id, 'ndcg', CASE WHEN total = 0 THEN 0 ELSE coalesce(dcg / list_sum(list_transform(range(1, least(total, 10) + 1), lambda r: 1 / log2(r + 1))), 0) END FROM total LEFT JOIN own USING (question_id))"""


def _scores(spark, sf_dir):
    top, spans = checkpointed(found(spark, sf_dir)), checkpointed(gold(spark, sf_dir))  # ten rows per question, and few spans
    totals = metrics.count_relevant(chunking.fixed(_with_gold(docs(spark, sf_dir), spans), 128, 32), spans)
    by_span = metrics.span_scores(metrics.gold_ranks(top, spans), (5, 10))
    return by_span.unionByName(metrics.long_format(metrics.rank_scores(metrics.relevance(top, spans), totals)))


@entry("retrieval_metrics", f"WITH {SCORES} SELECT question_id, metric, round(value, 6) AS value FROM scores")
def retrieval_metrics(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("value", F.round("value", 6))


@entry("metrics_by_group", f"WITH {SCORES} SELECT metric, kind, round(avg(value), 6) AS mean, count(*) AS n, grouping(kind)::TINYINT AS overall FROM (SELECT *, CASE WHEN question_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM scores) GROUP BY GROUPING SETS ((metric), (metric, kind))")
def metrics_by_group(spark, sf_dir):
    """Questions are of two types here: even and odd numbers."""
    kinds = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    return metrics.by_group(_scores(spark, sf_dir), kinds, "kind").withColumn("mean", F.round("mean", 6))


@entry("gold_not_contained", f"WITH {chunk_ctes(128, 32)}, {GOLD} SELECT question_id, span_no FROM gold g WHERE NOT EXISTS (SELECT 1 FROM chunk c WHERE c.doc_id = g.doc_id AND c.start_char <= g.start_char AND g.end_char <= c.end_char)")
def gold_not_contained(spark, sf_dir):
    spans = checkpointed(gold(spark, sf_dir))
    return metrics.spans_not_contained(chunking.fixed(_with_gold(docs(spark, sf_dir), spans), 128, 32), spans).select("question_id", "span_no")


@entry("gold_cut_by_chunk", f"WITH {chunk_ctes(128)}, {GOLD} SELECT question_id, span_no FROM gold g WHERE EXISTS (SELECT 1 FROM chunk c WHERE c.doc_id = g.doc_id AND g.start_char < c.start_char AND c.start_char < g.end_char)")
def gold_cut_by_chunk(spark, sf_dir):
    spans = checkpointed(gold(spark, sf_dir))
    return metrics.spans_cut(chunking.fixed(_with_gold(docs(spark, sf_dir), spans), 128), spans).select("question_id", "span_no")


BUDGET = rf"""{RETURNED}, {GOLD},
roomy AS (SELECT *, 300 - coalesce(sum(len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM returned),
ranges AS (SELECT question_id, rank, doc_id, start_char, start_char + length(array_to_string(regexp_extract_all(text, '\s*\S+')[1:room], '')) AS end_char FROM roomy WHERE room > 0),
clip AS (SELECT g.question_id, g.span_no, greatest(c.start_char, g.start_char) AS s, least(c.end_char, g.end_char) AS e FROM gold g JOIN ranges c ON c.question_id = g.question_id AND c.doc_id = g.doc_id AND c.start_char < g.end_char AND g.start_char < c.end_char),
fresh AS (SELECT *, greatest(0, e - greatest(s, coalesce(max(e) OVER (PARTITION BY question_id, span_no ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s))) AS f FROM clip),
cov AS (SELECT question_id, span_no, sum(f) AS covered FROM fresh GROUP BY ALL),
spans AS (SELECT question_id, avg((coalesce(covered, 0) > 0)::INTEGER) AS recall, sum(coalesce(covered, 0)) AS gold_chars FROM gold LEFT JOIN cov USING (question_id, span_no) GROUP BY question_id),
chars AS (SELECT question_id, sum(end_char - start_char) AS chars FROM ranges GROUP BY question_id)"""


@entry("budget_metrics", f"WITH {BUDGET} SELECT question_id, round(recall, 6) AS recall, round(coalesce(gold_chars::DOUBLE / nullif(chars, 0), 0), 6) AS precision FROM spans LEFT JOIN chars USING (question_id)")
def budget_metrics(spark, sf_dir):
    """What 300 tokens of the ranked chunks hold of the gold spans."""
    kept = metrics.within_budget(returned(spark, sf_dir), F.regexp_count("text", F.lit(r"\S+")), 300)
    ranges = kept.withColumn("end_char", F.col("start_char") + metrics.cut_to_tokens(F.col("text"), F.col("tokens_kept")))
    return metrics.budget_scores(ranges, gold(spark, sf_dir)).select("question_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def _judged(spark, sf_dir):
    """Quality stands for the judge's verdict, the absence of toxicity for the human's."""
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("judge"), (F.col("toxic") == 0).alias("human"))


JUDGED = "j AS (SELECT quality = 1 AS judge, toxic = 0 AS human FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@entry("kappa", f"WITH {JUDGED}, m AS (SELECT count(*) AS n, avg((judge = human)::INTEGER) AS agree, avg(judge::INTEGER) AS x, avg(human::INTEGER) AS y FROM j) SELECT n, round(agree, 6) AS agree, round(CASE WHEN x * y + (1 - x) * (1 - y) >= 1 THEN 1 ELSE (agree - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))) END, 6) AS kappa FROM m")
def kappa(spark, sf_dir):
    return stats.kappa(_judged(spark, sf_dir), "judge", "human").select("n", F.round("agree", 6).alias("agree"), F.round("kappa", 6).alias("kappa"))


@entry("judge_confusion", f"WITH {JUDGED} SELECT count(*) AS n, count(*) FILTER (judge = human) AS agree, count(*) FILTER (judge AND NOT human) AS too_kind, count(*) FILTER (NOT judge AND human) AS too_harsh FROM j")
def judge_confusion(spark, sf_dir):
    return stats.confusion(_judged(spark, sf_dir), "judge", "human")


@entry("separation_auc", """WITH r AS (SELECT source, quality = 1 AS good, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents JOIN labels USING (doc_id)),
g AS (SELECT source, count(*) AS n, count(*) FILTER (good) AS pos, sum(k) FILTER (good) AS ranks FROM r GROUP BY source)
SELECT source, CASE WHEN pos > 0 AND n > pos THEN round(1 - (ranks - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) END AS auc FROM g""")
def separation_auc(spark, sf_dir):
    """How well length ranks the good documents of each source first."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    ranked = rows.withColumn("place", F.struct((-F.col("n_chars")).alias("length"), "doc_id"))
    return stats.separation(ranked, "source", "place", "good").withColumn("auc", F.round("auc", 6))


def _runs(spark, sf_dir):
    """Two runs: scores of each labelled document."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), "quality", "toxic")
    as_run = lambda a: rows.select("question_id", F.lit("correct").alias("metric"), a.cast("double").alias("value"))
    return as_run(F.col("quality")), as_run(1 - F.col("toxic"))


PAIRED = "p AS (SELECT doc_id AS question_id, 'correct' AS metric, quality::DOUBLE AS a, (1 - toxic)::DOUBLE AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@entry("paired_diff", f"WITH {PAIRED} SELECT question_id, metric, a, b FROM p")
def paired_diff(spark, sf_dir):
    return stats.paired(*_runs(spark, sf_dir))


@entry("flips", f"WITH {PAIRED} SELECT metric, count(*) FILTER (abs(a - b) > 1e-9) AS differing, count(*) AS shared, round(avg(a - b), 6) AS mean_difference FROM p GROUP BY metric")
def flips(spark, sf_dir):
    return stats.flips(stats.paired(*_runs(spark, sf_dir))).withColumn("mean_difference", F.round("mean_difference", 6))


@entry("wins", f"WITH {PAIRED} SELECT metric, CASE WHEN a - b > 1e-9 THEN 'a' WHEN a - b < -1e-9 THEN 'b' ELSE 'tie' END AS winner, count(*) AS questions FROM p GROUP BY ALL")
def wins(spark, sf_dir):
    return stats.winners(stats.paired(*_runs(spark, sf_dir)))


@entry("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    """Mean quality by language, resampling sources."""
    rows = table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id").withColumn("value", F.col("quality").cast("double"))
    return stats.bootstrap(rows, ["lang"], "source", "value")


@entry("paired_bootstrap_ci")
def paired_bootstrap_ci(spark, sf_dir):
    sources = docs(spark, sf_dir).select(F.col("doc_id").alias("question_id"), F.col("source").alias("cluster"))
    return stats.paired_bootstrap(stats.paired(*_runs(spark, sf_dir)), sources, "cluster")


@entry("match_verdict", r"""WITH a AS (SELECT item_id, array_to_string(list_filter(string_split_regex(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ') AS r FROM benchmark)
SELECT item_id, md5(r) AS digest, true AS same, CASE WHEN r = 'yes' THEN 'true' WHEN r IN ('no', 'insufficient information') THEN 'false' ELSE 'open' END AS other FROM a""")
def match_verdict(spark, sf_dir):
    """Each item against itself in capitals, which must match, and against a bare yes, which leaves the verdict open."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.md5(T.normalised_answer(F.col("text")).cast("binary")).alias("digest"), T.match_verdict(F.upper("text"), F.col("text")).alias("same"), F.coalesce(T.match_verdict(F.lit("Yes."), F.col("text")).cast("string"), F.lit("open")).alias("other"))
