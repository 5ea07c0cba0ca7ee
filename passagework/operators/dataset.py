"""Evidence spans, clusters, samples and profiles of a question set."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def find_span(text: str, fact: str) -> tuple[int, int, str] | None:
    """First exact occurrence, else the first that differs in white space only; None for a blank fact."""
    words = fact.split()
    if not words:
        return None
    at = text.find(fact)
    if at >= 0:
        return at, at + len(fact), "exact"
    m = re.search(r"\s+".join(map(re.escape, words)), text)
    return (m.start(), m.end(), "whitespace") if m else None


#: Characters of facts whose automaton one task holds.
FACT_CHARS = 4 << 20


def verbatim(documents: DataFrame, items: DataFrame, chars: int = FACT_CHARS) -> DataFrame:
    """doc_id, text, question_id, fact: the documents that hold a fact as it is.

    ``documents``: doc_id, text; ``items``: question_id, fact.  Facts of up to
    ``chars`` characters together travel to the documents, and each text is read
    once for all of them.  Of more, those of three words or more are found by a
    join on their longest inner word (a document that holds the fact has it as a
    word of its own), and shorter ones travel in several blocks.
    """
    columns = ["doc_id", "text", "question_id", "fact"]
    items = items.where(F.trim("fact") != "").select("question_id", "fact")
    size = lambda rows: rows.agg(F.sum(F.length("fact").cast("long"))).first()[0] or 0
    total = size(items)
    if total <= chars:
        return _searched(documents, items)
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"[^ \t-\r]+"), F.lit(0))
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    longest = F.reduce(inner, F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))
    keyed = items.withColumn("w", words("fact")).withColumn("word", F.when(F.size("w") > 2, longest)).drop("w")
    long, short = keyed.where("word is not null"), keyed.where("word is null").select("question_id", "fact")
    own = documents.select("doc_id", F.explode(F.array_distinct(words("text"))).alias("word"))
    pairs = own.join(long.select("question_id", "word"), "word").select("doc_id", "question_id")
    found = pairs.join(documents, "doc_id").join(long.drop("word"), "question_id").where(F.col("text").contains(F.col("fact"))).select(columns)
    blocks = -(-size(short) // chars)
    for block in range(blocks):
        found = found.unionByName(_searched(documents, short.where(F.pmod(F.xxhash64("question_id", "fact"), F.lit(blocks)) == block)))
    return found


def _searched(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Each text searched for all facts at once, by an automaton that every task makes of them."""
    kinds = dict(documents.dtypes) | dict(items.dtypes)
    ids = to_arrow_type(items.schema["question_id"].dataType)
    travelling = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in items.select("question_id", "fact").distinct().collect()])  # about FACT_CHARS

    def run(batches):
        import ahocorasick

        machine, asked = ahocorasick.Automaton(), {}
        for question, fact in travelling.value:
            asked.setdefault(fact, []).append(question)
        for fact in asked:
            machine.add_word(fact, fact)
        if not asked:
            return
        machine.make_automaton()
        for batch in batches:
            at, questions, facts = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for fact in sorted({f for _, f in machine.iter(text)}) if text else ():
                    for question in asked[fact]:
                        at.append(k)
                        questions.append(question)
                        facts.append(fact)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(questions, ids), pa.array(facts, pa.string())], ["doc_id", "text", "question_id", "fact"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, text string, question_id {kinds['question_id']}, fact string")


def map_evidence(pairs: DataFrame) -> DataFrame:
    """pairs (text, fact, ...) with start_char, end_char and method (null: missing); Python only where the exact search fails."""

    @F.pandas_udf("struct<start:int,end:int,method:string>")
    def loose(texts: pd.Series, facts: pd.Series) -> pd.DataFrame:
        found = [find_span(t or "", f or "") or (None, None, None) for t, f in zip(texts, facts, strict=True)]
        return pd.DataFrame(found, columns=["start", "end", "method"]).astype({"start": "Int32", "end": "Int32"})

    at = F.expr("locate(fact, text)")
    exact = pairs.withColumn("_at", F.when(F.trim("fact") != "", at).otherwise(0))
    hit = exact.where("_at > 0").select(*pairs.columns, (F.col("_at") - 1).alias("start_char"), (F.col("_at") - 1 + F.length("fact")).alias("end_char"), F.lit("exact").alias("method"))
    rest = exact.where("_at = 0 or _at is null").withColumn("_f", loose("text", "fact")).select(*pairs.columns, F.col("_f.start").alias("start_char"), F.col("_f.end").alias("end_char"), F.col("_f.method").alias("method"))
    return hit.unionByName(rest)


def build_questions(raw: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions; every evidence item with what became of it).

    ``raw``: question_id, query, answer, question_type, evidence_list (url, title,
    fact).  ``documents``: doc_id, text, url, title, ordinal.  Questions have
    evidence: their distinct spans in order, and ``complete``: whether all their
    items were found.  An item's ``outcome`` is exact, whitespace, no article, no
    sentence or duplicate; ``repeats`` says that an exact sentence stands more than
    once in its article.
    """
    items = raw.select("question_id", F.posexplode("evidence_list").alias("item_no", "e")).select("question_id", "item_no", "e.url", "e.title", "e.fact")
    placed = articles(items, documents).join(documents.select("doc_id", "text"), "doc_id", "left")
    mapped = map_evidence(placed.where("doc_id is not null")).withColumn("repeats", (F.col("method") == "exact") & (F.length(F.replace("text", F.col("fact"))) <= F.length("text") - 2 * F.length("fact")))
    found = mapped.unionByName(placed.where("doc_id is null"), allowMissingColumns=True).drop("text")
    span = Window.partitionBy("question_id", "doc_id", "start_char", "end_char").orderBy("item_no")
    outcome = F.when(F.col("doc_id").isNull(), "no article").when(F.col("method").isNull(), "no sentence").when(F.row_number().over(span) > 1, "duplicate").otherwise(F.col("method"))
    found = found.withColumns({"outcome": outcome, "repeats": F.coalesce("repeats", F.lit(False))})
    kept = F.when(F.col("outcome").isin("exact", "whitespace"), F.struct("item_no", "doc_id", "start_char", "end_char"))
    own = found.groupBy("question_id").agg(F.array_sort(F.collect_list(kept)).alias("spans"), F.bool_and(~F.col("outcome").isin("no article", "no sentence")).alias("complete"))
    spans = F.transform("spans", lambda s: F.struct(s["doc_id"].alias("doc_id"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char")))
    joined = raw.join(own, "question_id", "left").withColumn("evidence", spans)
    empty = F.array().cast(dict(joined.dtypes)["evidence"])
    questions = joined.select("question_id", F.col("query").alias("text"), "answer", "question_type", F.coalesce("evidence", empty).alias("evidence"), F.coalesce("complete", F.lit(True)).alias("complete"))
    return questions, found


def build_report(questions: DataFrame, items: DataFrame) -> DataFrame:
    """One row: what became of the evidence of a question set."""
    how = {"exact": "exact", "whitespace": "whitespace", "no article": "article_not_in_corpus", "no sentence": "sentence_not_in_article", "duplicate": "duplicates"}
    one = items.agg(F.count("*").alias("facts"), *[F.count_if(F.col("outcome") == k).alias(v) for k, v in how.items()], F.count_if(F.col("repeats")).alias("repeated_sentences"))
    asked = questions.agg(F.count("*").alias("questions"), F.count_if(F.size("evidence") == 0).alias("without_evidence"), F.count_if(~F.col("complete")).alias("incomplete"))
    mapped = F.col("facts") - F.col("article_not_in_corpus") - F.col("sentence_not_in_article")
    return asked.crossJoin(one).withColumn("mapping_rate", F.coalesce(F.try_divide(mapped.cast("double"), F.nullif("facts", F.lit(0))), F.lit(1.0)))  # two single rows


def answerable(questions: DataFrame, subset_only: bool = False) -> DataFrame:
    """The questions that have gold evidence, and of those only the subset that is to be answered if asked for."""
    rows = questions.where(F.size("evidence") > 0)
    return rows.where("answer_subset") if subset_only else rows


def shared_gold_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char of the gold spans that two question sets share."""
    columns = ["doc_id", "start_char", "end_char"]
    return a.select(columns).intersect(b.select(columns))


def evidence_split(questions: DataFrame, sizes: dict[str, int], max_share: float, seed: str = "0") -> DataFrame:
    """question_id, split: dev, test, pool, test_pool.

    ``questions``: question_id, question_type, cluster, has_evidence.  Dev and test
    share no cluster; a cluster gives at most ``max_share`` of a split's answerable
    questions; each split has the types in proportion, and questions without
    evidence in their share of the whole.  What is left of the test side's clusters
    is test_pool; all else is pool.  Too few questions are an error.
    """
    n = questions.agg(F.count("*").alias("n"), F.count_if(~F.col("has_evidence")).alias("null")).first()
    nulls = {s: round(size * n["null"] / n["n"]) if n["n"] else 0 for s, size in sizes.items()}
    quota = {s: size - nulls[s] for s, size in sizes.items()}
    own = questions.where("has_evidence")
    largest = own.groupBy("cluster").count().orderBy(F.desc("count"), "cluster").limit(10 * sum(quota.values()) + 1).collect()
    filled, got, side = dict.fromkeys(quota, 0), dict.fromkeys(quota, 0), []
    for cluster, size in largest:
        if all(got[s] >= quota[s] for s in quota):
            break
        name = min(filled, key=lambda s: (filled[s] / quota[s] if quota[s] else float("inf"), s))
        side.append((cluster, name))
        filled[name] += size
        got[name] += min(size, int(max_share * quota[name]))
    short = [s for s in quota if got[s] < quota[s]]
    if short:
        raise ValueError(f"too few questions for {', '.join(sorted(short))}: {got} of {quota}")
    kind = dict(questions.dtypes)["cluster"]
    placed = own.join(F.broadcast(questions.sparkSession.createDataFrame(side, f"cluster {kind}, side string")), "cluster", "left")  # as many rows as quotas ask for
    taken = None
    for s in quota:
        capped_ = capped(placed.where(F.col("side") == s), "question_id", "cluster", int(max_share * quota[s]), seed)
        drawn = stratified_sample(capped_, "question_id", "question_type", quota[s], seed).select("question_id", F.lit(s).alias("split"))
        taken = drawn if taken is None else taken.unionByName(drawn)
    order = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("question_id").cast("string"))), "question_id"))
    blank = questions.where(~F.col("has_evidence")).select("question_id", F.md5(F.concat(F.lit(f"{seed}:"), F.col("question_id").cast("string"))).alias("_h")).orderBy("_h", "question_id").limit(sum(nulls.values()))
    names = [s for s in nulls for _ in range(nulls[s])]
    if names:
        numbered = blank.withColumn("_n", order)  # no more rows than the quotas
        taken = taken.unionByName(numbered.select("question_id", F.array(*map(F.lit, names))[F.col("_n") - 1].alias("split")))
    rest = questions.select("question_id", "cluster", "has_evidence").join(taken, "question_id", "left_anti").join(placed.select("question_id", "side"), "question_id", "left")
    return taken.unionByName(rest.select("question_id", F.when(F.col("side") == "test", "test_pool").otherwise("pool").alias("split")))


def pick(pool: DataFrame, key: str, verdict: str, n: int, seed: str = "0") -> DataFrame:
    """Up to ``n`` rows for a sheet of labels: at most half of them failed ones, the rest passed ones, in a seeded order."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = pool.withColumn("_h", hashed)
    failed = rows.where(~F.col(verdict)).orderBy("_h", key).limit(n // 2)
    left = n - failed.count()
    return failed.unionByName(rows.where(F.col(verdict)).orderBy("_h", key).limit(left)).orderBy("_h", key).drop("_h")


def label_sheet(answers: DataFrame, n: int = 40, seed: str = "0") -> DataFrame:
    """id, question, reference_answer, answer, human (empty): answers that no comparison of strings settles, each distinct (question, answer) once.

    ``answers``: question_id, question, reference, answer, match and judge_correct (nullable).
    """
    undecided = answers.where(F.col("match").isNull() & F.col("judge_correct").isNotNull())
    distinct = undecided.groupBy("question_id", "answer").agg(*[F.min(c).alias(c) for c in ("question", "reference", "judge_correct")])
    keyed = distinct.withColumn("_k", F.concat_ws("\0", F.col("question_id").cast("string"), "answer"))
    chosen = pick(keyed, "_k", "judge_correct", n, seed)
    place = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_k"))), "_k"))  # no more than n rows
    return chosen.select(F.format_string("c%02d", place).alias("id"), "question", F.col("reference").alias("reference_answer"), "answer", F.lit("").alias("human"))


def articles(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Evidence (url, title, ...) with the doc_id of its article: by url, else by title; of equal keys the last document."""
    by_url = documents.where("url is not null").groupBy("url").agg(F.max_by("doc_id", "ordinal").alias("_u"))
    by_title = documents.where("title is not null").groupBy("title").agg(F.max_by("doc_id", "ordinal").alias("_t"))
    return evidence.join(by_url, "url", "left").join(by_title, "title", "left").withColumn("doc_id", F.coalesce("_u", "_t")).drop("_u", "_t")


def mapping_report(mapped: DataFrame) -> DataFrame:
    """facts, exact, whitespace, missing, mapping_rate (1 when empty)."""
    one = mapped.agg(F.count("*").alias("facts"), F.count_if(F.col("method") == "exact").alias("exact"), F.count_if(F.col("method") == "whitespace").alias("whitespace"), F.count_if(F.col("method").isNull()).alias("missing"))
    return one.withColumn("mapping_rate", F.coalesce(F.try_divide((F.col("exact") + F.col("whitespace")).cast("double"), F.nullif("facts", F.lit(0))), F.lit(1.0)))


def clusters(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, cluster: the smallest question that is reachable over shared spans; a question without evidence is its own.

    ``evidence``: question_id, span.  Labels alternate between questions and spans
    and jump to their label's label; each round is checkpointed, and none is
    collected.
    """
    from ..sources.tables import checkpointed

    edges = checkpointed(evidence.select("question_id", "span").distinct())
    labels = checkpointed(questions.select("question_id", F.col("question_id").alias("cluster")))
    while True:
        spans = edges.join(labels, "question_id").groupBy("span").agg(F.min("cluster").alias("m"))
        near = edges.join(spans, "span").groupBy("question_id").agg(F.min("m").alias("m"))
        moved = labels.join(near, "question_id", "left").select("question_id", F.col("cluster").alias("was"), F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        jump = labels.select(F.col("question_id").alias("cluster"), F.col("cluster").alias("next"))
        moved = checkpointed(moved.join(jump, "cluster").select("question_id", "was", F.least("cluster", "next").alias("cluster")))
        labels = moved.select("question_id", "cluster")
        if moved.where("cluster <> was").isEmpty():
            return labels


def largest_share(labels: DataFrame) -> DataFrame:
    """clusters, questions, largest_share (0 when empty)."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("questions"), F.coalesce(F.try_divide(F.max("n").cast("double"), F.sum("n")), F.lit(0.0)).alias("largest_share"))


def quotas(rows: DataFrame, stratum: str, n: int) -> DataFrame:
    """stratum, quota: shares of ``n`` by largest remainder, ties by stratum."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    every = Window.partitionBy(F.lit(0))  # one row per stratum
    part = sizes.withColumn("exact", F.lit(n) * F.col("size") / F.sum("size").over(every)).withColumn("base", F.floor("exact"))
    left = F.lit(n) - F.sum("base").over(every)
    place = F.row_number().over(every.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), stratum))
    return part.select(stratum, "size", (F.col("base") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, key: str, stratum: str, n: int, seed: str = "0") -> DataFrame:
    """As many rows of each stratum as its quota, in the order of a seeded checksum of the key.

    No quota is above ``n``, so a task sends on its first ``n`` rows of each stratum at most.
    """
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return first.join(quotas(rows, stratum, n), stratum).where("_n <= quota").drop("_n", "quota", "size")


def capped(rows: DataFrame, key: str, cluster: str, cap: int, seed: str = "0") -> DataFrame:
    """At most ``cap`` rows of each cluster, in the order of a seeded checksum of the key."""
    order = Window.partitionBy(cluster).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def disjoint_split(labels: DataFrame, quota: dict[str, int], cap: int, seed: str = "0") -> DataFrame:
    """question_id, split: whole clusters, largest first, to the side that is emptiest for its quota; the rest is unused.

    Cluster sizes are counted by Spark; the greedy choice is on the driver, as each
    depends on all before it, over no more clusters than the quotas have places.
    """
    rows = capped(labels, "question_id", "cluster", cap, seed)
    # each cluster that is placed fills a quota by one at least, so no more than these can be placed
    largest = rows.groupBy("cluster").count().orderBy(F.desc("count"), "cluster").limit(sum(quota.values())).collect()
    filled, side = dict.fromkeys(sorted(quota), 0), []
    for cluster, size in largest:
        name = min(filled, key=lambda s: (filled[s] / quota[s] if quota[s] else float("inf"), s))
        if filled[name] >= quota[name]:
            break
        side.append((cluster, name))
        filled[name] += size
    kind = dict(labels.dtypes)["cluster"]
    chosen = labels.sparkSession.createDataFrame(side, f"cluster {kind}, split string")
    order = Window.partitionBy("split").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("question_id").cast("string"))), "question_id")
    limit = F.create_map(*[F.lit(x) for s, n in quota.items() for x in (s, n)])
    placed = rows.join(chosen, "cluster").withColumn("_n", F.row_number().over(order))
    return placed.where(F.col("_n") <= limit[F.col("split")]).select("question_id", "split")


def modal(rows: DataFrame, group: str, answer: Column, order: str) -> DataFrame:
    """group, answer, n: the most common answer of each group, ties to the one seen first."""
    counted = rows.select(group, answer.alias("answer"), order).groupBy(group, "answer").agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = Window.partitionBy(group).orderBy(F.desc("n"), "seen")
    return counted.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(group, "answer", "n")


def nearest_rank(rows: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """group, percent, value at rank max(1, round half even(p / 100 n)).

    Equal values are counted first, so a window sees one row per distinct value.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    line = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("c").over(line)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    asked = upto.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("at", F.greatest(F.lit(1), F.bround(F.col("percent") / 100.0 * F.col("n")).cast("long")))
    return asked.where("at <= upto and at > upto - c").select(group, "percent", F.col(value).alias("value"))


def profile(rows: DataFrame, group: str) -> DataFrame:
    """group, n, share."""
    counted = rows.groupBy(group).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
