"""The whole path: documents to an index, questions to answers, answers to metrics.

``Settings`` names components that ``registry`` makes; every stage works on all
questions at once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemming
from ..functions import text as T
from ..operators import chunking, context, dataset, dense, embedding, fusion, metrics, models, query, rerank, sparse, stats
from ..sources import tables


class Registry:
    """(kind, name) -> factory."""

    def __init__(self):
        self.factories: dict[tuple[str, str], Callable] = {}

    def add(self, kind: str, name: str, factory: Callable) -> None:
        if (kind, name) in self.factories:
            raise ValueError(f"{kind} {name} is there already")
        self.factories[kind, name] = factory

    def make(self, kind: str, name: str, **settings):
        if (kind, name) not in self.factories:
            raise KeyError(f"no {kind} {name}; there are {', '.join(sorted(n for k, n in self.factories if k == kind))}")
        return self.factories[kind, name](**settings)


registry = Registry()
registry.add("chunker", "fixed", lambda size=512, overlap=0: lambda d: chunking.fixed(d, size, overlap))
for _kind in chunking.LEVELS:
    registry.add("chunker", _kind, lambda size=512, overlap=0, _kind=_kind: lambda d: chunking.structure_chunks(d, _kind, size, overlap))
registry.add("chunker", "semantic", lambda **settings: lambda d: chunking.semantic(d, **settings))
registry.add("chunker", "parent_child", lambda **settings: lambda d: chunking.parent_child(d, **settings))
registry.add("embedder", "hashing", embedding.hashing)
for _kind in ("dense", "sparse", "hybrid"):
    registry.add("retriever", _kind, lambda _kind=_kind, **settings: Retriever(_kind, **settings))
registry.add("context", "assembler", lambda **settings: lambda chunks, documents, top_k, vectors: context.assemble(chunks, documents, top_k, vectors=vectors, **settings))
registry.add("followup", "standalone", lambda turns=3, generator=models.echo: lambda rows: models.standalone(rows, turns, generator))
registry.add("store", "parquet", lambda: tables)
registry.add("generator", "echo", lambda: models.echo)
registry.add("reranker", "overlap", lambda: lambda pairs: rerank.score_pairs(pairs, scorer=rerank.overlap_scorer))
registry.add("reranker", "cross_encoder", lambda scorer, batch=32: lambda pairs: rerank.cross_encoded(pairs, scorer, batch=batch)[0])
for _kind in models.TRANSFORMS:
    registry.add("query_transform", _kind, lambda _kind=_kind, **settings: lambda q: models.transform(q, _kind, **settings))
registry.add("query_transform", "clauses", lambda limit=None: lambda q: query.split_clauses(q, limit).select("question_id", "query_no", "text", "role"))


@dataclass(frozen=True)
class Retriever:
    """What a search is made of.

    ``stopwords``: they are left out; ``stems``: words are stemmed; ``header``: title,
    source and date are indexed with the text (chunks with such columns); ``method``:
    rrf (with ``fusion_k``), minmax or zscore (with ``weights`` of the dense and the
    sparse list).
    """

    kind: str = "hybrid"
    depth: int = 200
    k1: float = 1.2
    b: float = 0.75
    stopwords: bool = False
    stems: bool = False
    header: bool = False
    method: str = "rrf"
    fusion_k: float = 60.0
    weights: tuple[float, float] = (0.5, 0.5)

    def __post_init__(self):
        if self.method not in ("rrf", "minmax", "zscore"):
            raise ValueError(f"{self.method}: known are rrf, minmax and zscore")

    def fused(self, lists: DataFrame, k: int) -> DataFrame:
        weights = dict(enumerate(map(float, self.weights)))
        if self.method == "rrf":
            return fusion.reciprocal_rank(lists, "chunk_id", self.fusion_k, top=k)
        return fusion.weighted(lists, "chunk_id", weights, self.method, k)


@dataclass(frozen=True)
class Component:
    name: str
    params: dict = field(default_factory=dict)


def parsed(text: str) -> dict:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ValueError("settings are no JSON, and there is no YAML parser") from None
        return yaml.safe_load(text)


@dataclass(frozen=True)
class Evaluation:
    """How a pipeline is evaluated; shared by runs that are to be compared."""

    ks: tuple[int, ...] = (1, 5, 10)
    rank_k: int = 10
    budget: int = 2000
    samples: int = 2000
    seed: int = 0
    confirm_above: float = 1.0

    def __post_init__(self):
        if not self.ks or min(self.ks) < 1 or self.rank_k < 1 or self.budget < 1:
            raise ValueError("cut-offs and budget are at least 1")

    @classmethod
    def load(cls, text: str) -> Evaluation:
        raw = parsed(text)
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**raw | ({"ks": tuple(raw["ks"])} if "ks" in raw else {}))


@dataclass(frozen=True)
class Settings:
    """What a pipeline is made of; unknown keys are an error."""

    chunker: Component = Component("recursive", {"size": 128})
    embedder: Component = Component("hashing", {"dimensions": 256})
    retriever: Component = Component("hybrid")
    top_k: int = 5
    overfetch: int = 1
    query_transform: Component | None = None
    routing: models.Routing | None = None  # None: the transformation's own
    reranker: Component | None = None
    rerank_depth: int = 20
    rerank_header: bool = False
    context: Component = Component("assembler")
    generator: Component = Component("echo")

    @property
    def pool(self) -> int:
        """What the context may choose from, and so how many ranks are needed."""
        return max(self.top_k, self.context.params.get("pool") or 0)

    @classmethod
    def load(cls, text: str) -> Settings:
        """From JSON, or YAML where a parser for it is installed."""
        raw = parsed(text)
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        for key in ("chunker", "embedder", "retriever", "query_transform", "reranker", "context", "generator"):
            if raw.get(key):
                raw[key] = Component(raw[key]) if isinstance(raw[key], str) else Component(**raw[key])
        if raw.get("routing"):
            raw["routing"] = models.Routing(**raw["routing"])
        return cls(**raw)

    def index_settings(self) -> dict:
        """What an index depends on."""
        return {"chunker": asdict(self.chunker), "embedder": asdict(self.embedder)}


def ingest(documents: DataFrame, settings: Settings, index_path: str) -> dict:
    """Cut the documents that the index lacks and append them; counters of what was done, also kept beside the index."""
    began = time.time()
    spark = documents.sparkSession
    cut = registry.make("chunker", settings.chunker.name, **settings.chunker.params)
    documents = documents.dropDuplicates(["doc_id"])
    try:
        there = tables.load_index(spark, index_path, settings.index_settings())
        fresh = tables.new_documents(documents, there)
    except tables.AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there, fresh = None, documents
    chunks = tables.checkpointed(cut(fresh))
    if there is None:
        tables.save_index(chunks, index_path, settings.index_settings())
    else:
        chunks.write.mode("append").parquet(f"{index_path}/rows")
    counted = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents")).first()
    done = {"documents": counted["documents"], "chunks": counted["chunks"]}
    spark.createDataFrame([(*done.values(), time.time() - began)], "documents long, chunks long, seconds double").coalesce(1).write.mode("append").json(f"{index_path}/ingest")
    return done


def searched_text(index: DataFrame, header: bool) -> Column:
    """What is indexed of a chunk: its own text or the part that stands for it, under its header's line if that is asked for."""
    body = F.coalesce(F.col("embed_text"), F.col("text")) if "embed_text" in index.columns else F.col("text")
    if not header:
        return body
    own = lambda c: F.col(c).cast("string") if c in index.columns else F.lit(None).cast("string")
    return T.passage_text(body, T.header(own("title"), own("source"), T.published(own("published_at"))))


def search(queries: DataFrame, index: DataFrame, settings: Settings, k: int) -> DataFrame:
    """question_id, chunk_id, rank, score of each query text (question_id, text and, if there is one, role), dense, sparse or both fused.

    A made-up answer passage (role hypothetical) is embedded as a passage.
    """
    own = registry.make("retriever", settings.retriever.name, **settings.retriever.params)
    depth = max(own.depth, k) if own.kind == "hybrid" else k
    body = searched_text(index, own.header)
    lists = []
    if own.kind in ("dense", "hybrid"):
        embedder = registry.make("embedder", settings.embedder.name, **settings.embedder.params)
        made_up = F.col("role") == "hypothetical" if "role" in queries.columns else F.lit(False)
        asked = embedding.embedded(queries.where(~made_up), "question_id", F.col("text"), embedder, "query")[0]
        if "role" in queries.columns:
            asked = asked.unionByName(embedding.embedded(queries.where(made_up), "question_id", F.col("text"), embedder)[0])
        passages, _ = embedding.embedded(index.select("chunk_id", body.alias("_body")), "chunk_id", F.col("_body"), embedder)
        lists.append(dense.cosine_top(asked, passages, depth, key="chunk_id"))
    if own.kind in ("sparse", "hybrid"):
        asked = queries.select("question_id", T.terms(F.col("text"), own.stopwords).alias("terms"))
        lists.append(sparse.search(asked, index, "chunk_id", T.terms(body, own.stopwords), depth, own.k1, own.b, stemming.stem if own.stems else None).select("question_id", "chunk_id", "score", "rank"))
    if len(lists) == 1:
        return lists[0].where(F.col("rank") <= k)
    return own.fused(lists[0].withColumn("list_no", F.lit(0)).unionByName(lists[1].withColumn("list_no", F.lit(1))), k)


def transformed(questions: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The queries that are searched with, and those that are reranked with: question_id, query_no, text, role."""
    own = questions.select("question_id", F.lit(1).alias("query_no"), F.col("question").alias("text"), F.lit("original").alias("role"))
    if not settings.query_transform:
        return own, own
    routing = models.routing_of(settings.query_transform.name, settings.routing)
    made = registry.make("query_transform", settings.query_transform.name, **settings.query_transform.params)(questions)
    made = tables.checkpointed(made.select("question_id", "query_no", "text", "role"))  # model calls; read for both routes
    return query.route(own, made, routing.retrieve_with), query.route(own, made, routing.rerank_with)


def first_stage(questions: DataFrame, index: DataFrame, settings: Settings, routed: DataFrame | None = None) -> DataFrame:
    """question_id, chunk_id, rank, score with the chunk's columns; queries are transformed, searched, combined and equal spans collapsed."""
    fetch = max(settings.pool, settings.rerank_depth if settings.reranker else 0)
    routing = models.routing_of(settings.query_transform.name, settings.routing) if settings.query_transform else None
    routed = transformed(questions, settings)[0] if routed is None else routed
    each = max(fetch, routing.depth) if routing else fetch
    pair = F.struct("question_id", "query_no")
    named = routed.select(F.concat_ws("\0", F.col("query_no").cast("string"), F.col("question_id").cast("string")).alias("_name"), pair.alias("pair"), "text", "role")
    found = search(named.select(F.col("_name").alias("question_id"), "text", "role"), index, settings, each * settings.overfetch)
    lists = found.join(named.select(F.col("_name").alias("question_id"), "pair"), "question_id").select("pair.question_id", F.col("pair.query_no").alias("list_no"), "chunk_id", "rank", "score")
    if not routing:
        combined = lists.drop("list_no")
    elif routing.combine == "rrf":
        combined = fusion.reciprocal_rank(lists, "chunk_id", routing.combine_k)
    else:
        combined = fusion.round_robin(lists, "chunk_id")
    rows = combined.join(index, "chunk_id")
    return fusion.collapse(rows, ["doc_id", "start_char", "end_char"]).where(F.col("rank") <= fetch)


def reranked(candidates: DataFrame, queries: DataFrame, settings: Settings) -> DataFrame:
    """Candidates with their new rank, cut at what the context needs.

    ``queries``: question_id, query_no, text.  Each query scores the first
    ``rerank_depth`` on its own; several orders of a question are merged by the
    best score or interleaved.  The others stay below in their old order.
    """
    if not settings.reranker:
        return candidates.where(F.col("rank") <= settings.pool)
    routing = models.routing_of(settings.query_transform.name if settings.query_transform else "", settings.routing)
    scorer = registry.make("reranker", settings.reranker.name, **settings.reranker.params)
    head = candidates.where(F.col("rank") <= settings.rerank_depth)
    read = searched_text(candidates, True) if settings.rerank_header else F.col("text")
    pairs = head.select("question_id", "chunk_id", "rank", read.alias("passage")).join(queries.select("question_id", "query_no", F.col("text").alias("question")), "question_id")
    scored = scorer(pairs).select("question_id", "query_no", "chunk_id", "rank", "new_score")
    kind = "best" if routing.rerank_combine == "max" else "round_robin"
    order = rerank.clause_orders(scored).where(F.col("order") == kind).select("question_id", "chunk_id", F.col("rank").alias("new_rank"), F.col("score").alias("new_score"))
    top = head.drop("score").join(order, ["question_id", "chunk_id"]).withColumnRenamed("new_score", "score")
    rest = candidates.where(F.col("rank") > settings.rerank_depth).withColumn("new_rank", F.col("rank"))
    out = top.unionByName(rest).drop("rank").withColumnRenamed("new_rank", "rank")
    return out.where(F.col("rank") <= settings.pool)


def ranked(questions: DataFrame, index: DataFrame, settings: Settings) -> DataFrame:
    """First stage and reranking."""
    searched, scored = transformed(questions, settings)
    return reranked(first_stage(questions, index, settings, searched), scored, settings)


def assembled(questions: DataFrame, documents: DataFrame, index: DataFrame, settings: Settings) -> DataFrame:
    """The passages of each question, with ``position``."""
    vectors = None
    if settings.context.params.get("mmr_weight") is not None:
        embedder = registry.make("embedder", settings.embedder.name, **settings.embedder.params)
        vectors, _ = embedding.embedded(index.select("chunk_id", searched_text(index, False).alias("_body")), "chunk_id", F.col("_body"), embedder)
    assembler = registry.make("context", settings.context.name, **settings.context.params)
    return assembler(ranked(questions, index, settings), documents, settings.top_k, vectors)


MODES = ("retrieved", "gold", "closed_book", "guesser")


def ask(questions: DataFrame, documents: DataFrame, index: DataFrame, settings: Settings, mode: str = "retrieved", gold: DataFrame | None = None) -> DataFrame:
    """question_id, question, answer, passages for all questions (question_id, question).

    ``mode``: ``retrieved``; ``gold`` (the gold spans are the passages); ``closed_book``
    (no passages); ``guesser`` (the most common answer of the question's type; needs
    question_type and answer).
    """
    if mode not in MODES:
        raise ValueError(f"{mode}: known are {', '.join(MODES)}")
    if mode == "guesser":
        guess = dataset.modal(questions, "question_type", F.col("answer"), "question_id").select("question_type", F.col("answer").alias("_guess"))
        return questions.join(guess, "question_type").select("question_id", "question", F.col("_guess").alias("answer"), F.lit(None).cast("string").alias("passages"))
    blocks = None
    with_header = bool(settings.context.params.get("header"))
    if mode == "retrieved":
        blocks = context.rendered(assembled(questions, documents, index, settings), "position", F.col("header"))
    elif mode == "gold":
        spans = gold.join(documents.select("doc_id", "text"), "doc_id").withColumns({"rank": F.col("span_no") + 1, "text": F.substring(F.col("text"), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))})
        blocks = context.rendered(context.wrapped(spans, documents, with_header), "position", F.col("header"))
    requests = context.prompts(questions, blocks, with_header)
    generator = registry.make("generator", settings.generator.name, **settings.generator.params)
    answers = models.generate(requests, settings.generator.name, generator).select("question_id", F.col("reply").alias("answer"))
    out = questions.select("question_id", "question").join(answers, "question_id")
    return out.withColumn("passages", F.lit(None).cast("string")) if blocks is None else out.join(blocks, "question_id")


def evaluate(questions: DataFrame, gold: DataFrame, index: DataFrame, settings: Settings, ks: tuple[int, ...] = (1, 5, 10), budget: int | None = None, documents: DataFrame | None = None, rank_k: int = 10) -> DataFrame:
    """question_id, metric, value of the ranking against gold spans.

    With ``budget`` also what that many tokens hold; with ``documents`` also what the
    assembled context holds.
    """
    columns = ["question_id", "rank", "score", "chunk_id", "doc_id", "start_char", "end_char", "text"]
    found = tables.checkpointed(ranked(questions, index, settings).select(columns))
    out = metrics.span_scores(metrics.gold_ranks(found, gold), ks)
    held = index.join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = metrics.count_relevant(held, gold)
    out = out.unionByName(metrics.long_format(metrics.rank_scores(metrics.relevance(found, gold), totals, rank_k)))
    if budget is not None:
        kept = metrics.within_budget(found, context.token_count(F.col("text")), budget)
        ranges = kept.withColumn("end_char", F.col("start_char") + metrics.cut_to_tokens(F.col("text"), F.col("tokens_kept")))
        own = metrics.budget_scores(ranges, gold).select("question_id", F.col("recall").alias(f"recall@{budget}tok"), F.col("precision").alias(f"precision@{budget}tok"))
        out = out.unionByName(metrics.long_format(own))
    if documents is not None:
        placed = tables.checkpointed(assembled(questions, documents, index, settings))
        out = out.unionByName(metrics.context_scores(placed, context.contents(placed), gold))
    return out


def answer_run(questions: DataFrame, documents: DataFrame, index: DataFrame, settings: Settings, mode: str = "retrieved", gold: DataFrame | None = None, correct: models.Generator | None = None, faithful: models.Generator | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row per question, its scores: question_id, metric, value) of answers that are compared and, where that is not enough, judged.

    ``questions``: question_id, question, question_type, answer (the reference).  The
    judges are generators; without one its verdicts are null.  Whether the context
    had all gold spans is known in the mode that retrieves and with ``gold`` only.
    """
    said = ask(questions, documents, index, settings, mode, gold).select("question_id", F.col("answer").alias("said"), "passages")
    rows = questions.select("question_id", "question", "question_type", F.col("answer").alias("reference")).join(said.withColumnRenamed("said", "answer"), "question_id")
    rows = tables.checkpointed(rows.withColumn("match", T.match_verdict(F.col("answer"), F.col("reference"))))  # model calls
    for name, kind, judge, asked in (("judge_correct", "correctness", correct, rows.where("match is null")), ("judge_faithful", "faithfulness", faithful, rows.where("passages is not null"))):
        if judge is None:
            rows = rows.withColumn(name, F.lit(None).cast("boolean"))
        else:
            rows = rows.join(models.judge(asked.select("question_id", "question", "reference", "answer"), judge, kind).select("question_id", F.col("verdict").alias(name)), "question_id", "left")
    if mode == "retrieved" and gold is not None:
        placed = assembled(questions.select("question_id", "question"), documents, index, settings)
        held = metrics.gold_ranks(placed, gold).groupBy("question_id").agg(F.bool_and(F.col("gold_rank").isNotNull()).alias("full_support"))
        rows = rows.join(held, "question_id", "left")
    else:
        rows = rows.withColumn("full_support", F.lit(None).cast("boolean"))
    return rows, models.answer_scores(rows)


def summary(scores: DataFrame, clusters: DataFrame, groups: DataFrame | None = None, group: str | None = None, samples: int = 2000, seed: int = 0) -> DataFrame:
    """metric (and group) with mean, low, high, n: means with cluster-bootstrap intervals.  ``clusters``: question_id, cluster."""
    rows = scores.join(clusters, "question_id")
    rows = rows.join(groups, "question_id") if groups is not None else rows
    return stats.bootstrap(rows, ["metric", *([group] if group else [])], "cluster", "value", samples, seed)


def guard_split(path: str, allowed: bool = False) -> None:
    """Held-out questions are read only on purpose."""
    if path.rstrip("/").rsplit("/", 1)[-1].startswith("questions_test") and not allowed:
        raise PermissionError(f"{path} is held out")


def run_name(name: str, mode: str = "retrieved", sample: int = 0) -> str:
    """``name[-mode][-rN]``; a guesser's run has no other name."""
    if mode == "guesser":
        return "guesser"
    return "-".join([name, *([mode] if mode != "retrieved" else []), *([f"r{sample}"] if sample else [])])


def save_run(scores: DataFrame, folder: str, settings: Settings, answered: bool = False, rows: DataFrame | None = None) -> None:
    """Long metrics, settings and, if given, a row per question; a run without answers does not replace one that has them."""
    spark = scores.sparkSession
    try:
        before = spark.read.json(f"{folder}/meta").first()
        if before and before["answered"] and not answered:
            raise FileExistsError(f"{folder} holds an answered run")
    except tables.AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    scores.write.mode("overwrite").parquet(f"{folder}/scores")
    if rows is not None:
        tables.write_jsonl(rows, f"{folder}/questions.jsonl")
    spark.createDataFrame([(json.dumps(asdict(settings), sort_keys=True), answered)], "settings string, answered boolean").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def session(name: str = "passagework", **conf) -> SparkSession:
    """A session with adaptive execution and a fixed time zone."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
