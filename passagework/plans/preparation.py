"""Question sets, samples, profiles, replies, caches and costs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dataset, query
from ..sources import costs, tables
from .common import docs, table, terms_sql
from .evaluation import GOLD, gold

ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


#: Documents are questions here and their lines, lower-cased and trimmed, are the spans that they share.
SPANS = r"e AS (SELECT DISTINCT question_id, md5(line) AS span FROM (SELECT doc_id AS question_id, unnest(list_transform(string_split(lower(text), chr(10)), lambda x: trim(x))) AS line FROM documents) WHERE line <> '')"


def _evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    lines = rows.select(F.col("doc_id").alias("question_id"), F.explode(F.split(F.lower("text"), "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    return lines.select("question_id", F.md5(F.col("line").cast("binary")).alias("span")).distinct(), rows.select(F.col("doc_id").alias("question_id"))


#: Labels (the smallest question reached) move over shared spans; each round looks at what the one before changed.
CLUSTERS = f"""RECURSIVE {SPANS}, clusters(question_id, cluster) USING KEY (question_id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT question_id, m FROM (SELECT e.question_id, min(s.m) AS m FROM (SELECT span, min(cluster) AS m FROM clusters JOIN e USING (question_id) GROUP BY span) s JOIN e USING (span) GROUP BY e.question_id) near
  JOIN (SELECT question_id, cluster FROM recurring.clusters) known USING (question_id) WHERE m < cluster)"""


@entry("evidence_clusters", f"WITH {CLUSTERS} SELECT question_id, cluster FROM clusters")
def evidence_clusters(spark, sf_dir):
    return dataset.clusters(*_evidence(spark, sf_dir))


@entry("largest_cluster_share", f"WITH {CLUSTERS}, s AS (SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster) SELECT count(*) AS clusters, sum(n)::BIGINT AS questions, round(max(n)::DOUBLE / sum(n), 6) AS largest_share FROM s")
def largest_cluster_share(spark, sf_dir):
    return dataset.largest_share(dataset.clusters(*_evidence(spark, sf_dir))).withColumn("largest_share", F.round("largest_share", 6))


@entry("disjoint_split")
def disjoint_split(spark, sf_dir):
    return dataset.disjoint_split(dataset.clusters(*_evidence(spark, sf_dir)), {"dev": 200, "test": 200}, 25)


QUOTAS = """q0 AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
q1 AS (SELECT *, 100 * size / sum(size) OVER () AS exact FROM q0), q2 AS (SELECT *, floor(exact) AS base FROM q1),
quotas AS (SELECT lang, size, (base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, lang) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM q2)"""


@entry("stratified_quota", f"WITH {QUOTAS} SELECT lang, size, quota FROM quotas")
def stratified_quota(spark, sf_dir):
    return dataset.quotas(table(spark, sf_dir, "documents"), "lang", 100)


@entry("stratified_sample", f"WITH {QUOTAS}, r AS (SELECT doc_id, lang, quota, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS n FROM documents JOIN quotas USING (lang)) SELECT doc_id, lang FROM r WHERE n <= quota")
def stratified_sample(spark, sf_dir):
    return dataset.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 100).select("doc_id", "lang")


@entry("cap_per_cluster", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, source FROM r WHERE n <= 5")
def cap_per_cluster(spark, sf_dir):
    return dataset.capped(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 5).select("doc_id", "source")


@entry("modal_guess", "WITH c AS (SELECT lang, source AS answer, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, seen) AS k FROM c) SELECT lang, answer, n FROM r WHERE k = 1")
def modal_guess(spark, sf_dir):
    """The most common source of each language."""
    return dataset.modal(table(spark, sf_dir, "documents"), "lang", F.col("source"), "doc_id")


@entry("answer_form", "SELECT CASE WHEN lower(trim(answer)) IN ('yes', 'no') THEN 'yes/no' WHEN starts_with(lower(trim(answer)), 'insufficient information') THEN 'insufficient information' ELSE 'entity' END AS form, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'Insufficient information.' WHEN 2 THEN 'no' ELSE source END AS answer FROM documents) GROUP BY ALL")
def answer_form(spark, sf_dir):
    answer = F.when(F.col("doc_id") % 4 == 0, " Yes").when(F.col("doc_id") % 4 == 1, "Insufficient information.").when(F.col("doc_id") % 4 == 2, "no").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select(T.answer_form(answer).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@entry("nearest_rank_percentiles", """WITH o AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL),
p AS (SELECT unnest([5, 25, 50, 75, 95]) AS percent)
SELECT lang, percent::INTEGER AS percent, n_chars AS value FROM o, p WHERE k = greatest(1, round_even(percent / 100.0 * n, 0)::BIGINT)""")
def nearest_rank_percentiles(spark, sf_dir):
    return dataset.nearest_rank(table(spark, sf_dir, "documents"), "lang", "n_chars", [5, 25, 50, 75, 95])


@entry("profile_sources", "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def profile_sources(spark, sf_dir):
    return dataset.profile(table(spark, sf_dir, "documents"), "source").withColumn("share", F.round("share", 6))


MAPPED = """p AS (SELECT b.item_id, d.doc_id, d.text, CASE WHEN b.item_id % 5 = 0 THEN replace(b.text, ' ', '  ') ELSE b.text END AS fact, g.start_char AS a, g.end_char AS z FROM gold g JOIN benchmark b ON b.item_id = g.question_id JOIN documents d USING (doc_id))"""


def _pairs(spark, sf_dir):
    """Each gold span's fact with its document; of every fifth item the white space is doubled, so that only the loose search finds it."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("fact"))
    rows = gold(spark, sf_dir).select("question_id", "doc_id").join(items, "question_id").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return rows.withColumn("fact", F.when(F.col("question_id") % 5 == 0, F.replace("fact", F.lit(" "), F.lit("  "))).otherwise(F.col("fact")))


@entry("map_evidence", f"WITH {GOLD}, {MAPPED} SELECT item_id AS question_id, doc_id, a::INTEGER AS start_char, z::INTEGER AS end_char, CASE WHEN item_id % 5 = 0 THEN 'whitespace' ELSE 'exact' END AS method FROM p")
def map_evidence(spark, sf_dir):
    return dataset.map_evidence(_pairs(spark, sf_dir)).select("question_id", "doc_id", "start_char", "end_char", "method")


@entry("mapping_report", f"WITH {GOLD}, {MAPPED} SELECT count(*) AS facts, count(*) FILTER (item_id % 5 <> 0) AS exact, count(*) FILTER (item_id % 5 = 0) AS whitespace, 0::BIGINT AS missing, 1::DOUBLE AS mapping_rate FROM p")
def mapping_report(spark, sf_dir):
    return dataset.mapping_report(dataset.map_evidence(_pairs(spark, sf_dir)))


@entry("followup_history", "SELECT conv_id, turn, md5(coalesce(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '')) AS digest FROM conversations")
def followup_history(spark, sf_dir):
    return query.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5(F.col("history").cast("binary")).alias("digest"))


@entry("clause_split")
def clause_split(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return query.split_clauses(asked)


@entry("parse_ranking", r"""WITH r AS (SELECT item_id AS question_id, 8 AS n, [x::INTEGER for x in regexp_extract_all((item_id % 11) || ', 3 then [' || (item_id * 7 % 9) || '] and 3', '\d+')] AS said FROM benchmark),
f AS (SELECT question_id, unnest(said) - 1 AS passage, unnest(range(0, len(said))) AS pos FROM r), g AS (SELECT question_id, passage, min(pos) AS pos FROM f WHERE passage BETWEEN 0 AND 7 GROUP BY ALL),
every AS (SELECT question_id, unnest(range(0, 8)) AS passage FROM r)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY pos NULLS LAST, passage)::INTEGER AS place, passage::INTEGER AS passage, pos IS NOT NULL AS mentioned FROM every LEFT JOIN g USING (question_id, passage)""")
def parse_ranking(spark, sf_dir):
    reply = F.concat((F.col("item_id") % 11).cast("string"), F.lit(", 3 then ["), (F.col("item_id") * 7 % 9).cast("string"), F.lit("] and 3"))
    return query.parse_ranking(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), reply.alias("reply"), F.lit(8).alias("n")))


PARSED = r"""WITH t AS (SELECT conv_id || ':' || turn AS question_id, string_split(text, chr(10)) AS x FROM conversations WHERE text IS NOT NULL),
r AS (SELECT question_id, array_to_string(list_concat(list_transform(x, lambda t, i: i || '. "' || t || '"'), ['- ' || replace(x[1], ' ', '  ')]), chr(10)) AS reply FROM t),
n AS (SELECT question_id, unnest(l) AS raw, unnest(range(0, len(l))) AS pos FROM (SELECT question_id, string_split_regex(reply, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]') AS l FROM r)),
b AS (SELECT question_id, pos, trim(regexp_replace(regexp_replace(trim(raw), '^\s*(?:[-*•]+|\(?\d+[.):]|[Qq]\d+[.):])\s*', ''), '(?i)^(?:(?:rewritten|search|sub)[- ]?)?(?:query|question|passage|phrasing)\s*\d*\s*:\s*', '')) AS bare FROM n),
c AS (SELECT question_id, pos, CASE WHEN length(bare) > 1 AND contains('"''“”‘’`', bare[1]) AND contains('"''“”‘’`', bare[length(bare)]) THEN trim(substring(bare, 2, length(bare) - 2)) ELSE bare END AS text FROM b),
k AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM c WHERE text <> ''),
f AS (SELECT question_id, key, min(pos) AS pos, arg_min(text, pos) AS text, count(*) AS times FROM k GROUP BY question_id, key),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS query_no, sum(times - 1) OVER (PARTITION BY question_id) AS repeated, greatest(0, count(*) OVER (PARTITION BY question_id) - 3) AS extra FROM f)
SELECT question_id, query_no::INTEGER AS query_no, text, repeated::BIGINT AS repeated, extra::BIGINT AS extra FROM o WHERE query_no <= 3"""


@entry("parse_lines", PARSED)
def parse_lines(spark, sf_dir):
    """Every turn as a reply: its lines numbered and quoted, the first once more; the limit of three lines is the feature."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.split("text", "\n").alias("x"))
    reply = F.array_join(F.concat(F.transform("x", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". \""), t, F.lit('"'))), F.transform(F.slice("x", 1, 1), lambda t: F.concat(F.lit("- "), F.replace(t, F.lit(" "), F.lit("  "))))), "\n")
    return query.parse_lines(rows.select("question_id", reply.alias("reply")), 3)


@entry("parse_verdict", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unreadable' END AS verdict FROM benchmark")
def parse_verdict(spark, sf_dir):
    reply = F.when(F.col("item_id") % 3 == 0, 'Sure: {"reasoning": "a {b}", "verdict": " Correct"} done').when(F.col("item_id") % 3 == 1, '{"verdict": "incorrect"}').otherwise("no object")
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(T.verdict(reply, "correct", "incorrect").cast("string"), F.lit("unreadable")).alias("verdict"))


@entry("header_dates", "SELECT o_orderkey, o_orderpriority || '. ' || o_orderstatus || ', ' || strftime(o_orderdate, '%B %-d, %Y') || '.' AS header FROM orders")
def header_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.prompt_header(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderdate")).alias("header"))


@entry("ingest_anti", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def ingest_anti(spark, sf_dir):
    """A third of the documents is indexed already."""
    rows = docs(spark, sf_dir)
    return tables.new_documents(rows, rows.where("doc_id % 3 = 0")).select("doc_id")


@entry("cache_misses", f"WITH t AS (SELECT DISTINCT unnest({terms_sql('text')}) AS key FROM documents), c AS (SELECT DISTINCT unnest({terms_sql('text')}) AS key FROM benchmark) SELECT key FROM t WHERE key NOT IN (SELECT key FROM c)")
def cache_misses(spark, sf_dir):
    """Terms of the documents that the benchmark's vocabulary, as a cache, lacks; each once."""
    own = lambda name: table(spark, sf_dir, name).select(F.explode(T.terms(F.col("text"))).alias("key"))
    return tables.misses(own("documents"), own("benchmark").distinct())


PRICES = [("view", 0.02, 0.0), ("click", 0.13, 0.4), ("purchase", 1.0, 5.0)]


@entry("cost_rollup", f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in PRICES)}) p(model, input, output)),
u AS (SELECT event_type AS model, count(*) AS calls, sum(event_id % 500)::BIGINT AS input_tokens, sum(user_id % 90)::BIGINT AS output_tokens FROM events WHERE event_id % 4 <> 0 GROUP BY event_type)
SELECT model, calls, input_tokens, output_tokens, round(coalesce((input_tokens * input + output_tokens * output) / 1e6, 0), 6) AS cost FROM u LEFT JOIN p USING (model)""")
def cost_rollup(spark, sf_dir):
    """Events stand for calls; every fourth was answered by the cache."""
    usage = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 500).alias("input_tokens"), (F.col("user_id") % 90).alias("output_tokens"), (F.col("event_id") % 4 == 0).alias("cached"))
    return costs.bill(usage, spark.createDataFrame(PRICES, "model string, input double, output double")).withColumn("cost", F.round("cost", 6))
