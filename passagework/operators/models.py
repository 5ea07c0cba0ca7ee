"""Model calls as interfaces with deterministic stand-ins, and the operators around them.

A generator is a function of (system, user) series to replies.  Calls go through a
cache table (key, reply): each distinct request that it lacks is made once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables
from . import query

Generator = Callable[[pd.Series, pd.Series], pd.Series]


FIRST_PASSAGE = re.compile(r'<passage id="1">\n(.*?)\n</passage>', re.DOTALL)


def echo(systems: pd.Series, users: pd.Series) -> pd.Series:
    """The first 200 characters of the first passage, or of what is asked if there is none."""
    def answer(u: str) -> str:
        found = FIRST_PASSAGE.search(u or "")
        return (found[1] if found else u or "")[:200]

    return users.map(answer)


def words_as_lines(systems: pd.Series, users: pd.Series) -> pd.Series:
    """Every fifth part of the question on a line of its own, numbered: a stand-in for a model that splits questions."""
    def split(u: str) -> str:
        w = (u or "").removeprefix("Question: ").split()
        return "\n".join(f"{k + 1}. {' '.join(w[i : i + 5])}" for k, i in enumerate(range(0, len(w), 5)))

    return users.map(split)


def request_key(model: str, system: Column, user: Column, sample: int = 0) -> Column:
    return tables.cache_key(F.lit(model), system, user, F.lit(str(sample)))


def generate(requests: DataFrame, model: str = "echo", generator: Generator = echo, cache: DataFrame | None = None, sample: int = 0) -> DataFrame:
    """requests (system, user, ...) with reply and cached."""
    call = F.pandas_udf(generator, "string")
    keyed = requests.withColumn("key", request_key(model, F.col("system"), F.col("user"), sample))
    distinct = keyed.select("key", "system", "user").dropDuplicates(["key"])
    if cache is None:
        fresh = distinct
        known = None
    else:
        fresh = distinct.join(cache, "key", "left_anti")
        known = cache.select("key", "reply").withColumn("cached", F.lit(True))
    made = fresh.select("key", call("system", "user").alias("reply"), F.lit(False).alias("cached"))
    return keyed.join(made if known is None else known.unionByName(made), "key").drop("key")


@dataclass(frozen=True)
class Routing:
    """Which texts are searched and reranked with, and how several lists become one."""

    retrieve_with: str = "queries"
    rerank_with: str = "original"
    combine: str = "rrf"
    combine_k: float = 60.0
    rerank_combine: str = "round_robin"
    depth: int = 100

    def __post_init__(self):
        for value, known in ((self.retrieve_with, ("original", "queries", "both")), (self.rerank_with, ("original", "queries", "both")), (self.combine, ("rrf", "round_robin")), (self.rerank_combine, ("max", "round_robin"))):
            if value not in known:
                raise ValueError(f"{value}: known are {', '.join(known)}")


class Refused(Exception):
    """A model declines a request; the operators around it fall back to what they were given."""


#: What a generator that declined replies, so that it passes through a column.
REFUSED = "\x00refused"


def tolerant(generator: Generator) -> Generator:
    """``generator`` with each request on its own, so that one that is refused doesn't fail the others; other errors do."""
    def call(systems: pd.Series, users: pd.Series) -> pd.Series:
        out = []
        for n in range(len(users)):
            try:
                out.append(generator(systems.iloc[n : n + 1], users.iloc[n : n + 1]).iloc[0])
            except Refused:
                out.append(REFUSED)
        return pd.Series(out, dtype=object)

    return call


def hosted(connect: Callable[[], Callable[[str, str], list[str] | str]], attempts: int = 3) -> Generator:
    """A generator over a hosted model.

    ``connect()`` is called once per worker and gives a function of (system, user)
    to a text or to a list of text blocks, which are joined and stripped.  A
    ConnectionError or TimeoutError is tried again; ``Refused`` is passed on.
    """
    state: dict = {}

    def one(system: str, user: str) -> str:
        if "client" not in state:
            state["client"] = connect()
        for left in reversed(range(attempts)):
            try:
                said = state["client"](system, user)
                return (said if isinstance(said, str) else "".join(said)).strip()
            except (ConnectionError, TimeoutError):
                if not left:
                    raise
        raise ValueError("attempts is at least 1")

    return lambda systems, users: pd.Series([one(s, u) for s, u in zip(systems, users, strict=True)], dtype=object)


#: Name -> instruction, role of the queries, most lines, and default routing.
TRANSFORMS: dict[str, tuple[str, str, int, Routing]] = {
    "rewrite": ("Rewrite the question as one search query.", "rewrite", 1, Routing()),
    "multi_query": ("Write differently worded questions, one on each line.", "paraphrase", 3, Routing(retrieve_with="both")),
    "hyde": ("Write a short passage that answers the question.", "hypothetical", 1, Routing()),
    "decompose": ("Split the question into sub-questions, one on each line.", "sub-question", 4, Routing(combine="round_robin")),
}


def routing_of(kind: str, own: Routing | None) -> Routing:
    """The routing that is asked for, or the transformation's own."""
    return own or (TRANSFORMS[kind][3] if kind in TRANSFORMS else Routing())


def transform(questions: DataFrame, kind: str, generator: Generator = words_as_lines, limit: int | None = None, cache: DataFrame | None = None) -> DataFrame:
    """question_id, query_no, text, role, fallback, missing of the transformed queries.

    An empty or refused reply leaves the question itself (role original; fallback
    empty or refused).  Paraphrases that repeat the question go, and ``missing``
    says how many fewer there are than asked for.
    """
    instruction, role, most, _ = TRANSFORMS[kind]
    most = limit or most
    if kind == "decompose" and most < 2:
        raise ValueError("a question is decomposed into two parts at least")
    asked = questions.select("question_id", "question", F.lit(instruction).alias("system"), F.concat(F.lit("Question: "), F.col("question")).alias("user"))
    replies = generate(asked, kind, tolerant(generator), cache).withColumn("refused", F.col("reply") == REFUSED)
    good = replies.where(~F.col("refused"))
    if kind == "hyde":
        made = good.select("question_id", F.lit(1).alias("query_no"), query.parse_passage(F.col("reply")).alias("text")).where("text <> ''")
    elif kind == "multi_query":
        lines = query.parse_lines(good, most + 1).select("question_id", "query_no", "text")
        others = lines.join(questions.select("question_id", "question"), "question_id").where(T.text_key(F.col("text")) != T.text_key(F.col("question")))
        made = others.withColumn("query_no", F.row_number().over(Window.partitionBy("question_id").orderBy("query_no"))).where(F.col("query_no") <= most).drop("question")
    else:
        made = query.parse_lines(good, most).select("question_id", "query_no", "text")
    n = F.count("*").over(Window.partitionBy("question_id"))
    missing = F.lit(most) - n if kind == "multi_query" else F.lit(0)
    made = made.select("question_id", "query_no", "text", F.lit(role).alias("role"), F.lit(None).cast("string").alias("fallback"), missing.cast("int").alias("missing"))
    own = replies.join(made.select("question_id").distinct(), "question_id", "left_anti")
    return made.unionByName(own.select("question_id", F.lit(1).alias("query_no"), F.col("question").alias("text"), F.lit("original").alias("role"), F.when(F.col("refused"), "refused").otherwise("empty").alias("fallback"), F.lit(most if kind == "multi_query" else 0).alias("missing")))


def standalone(turns: DataFrame, keep: int = 3, generator: Generator = echo) -> DataFrame:
    """conv_id, turn, asked, question: user turns rewritten with the last ``keep`` rows before; without history, or after an empty reply, unchanged."""
    rows = query.history(turns, keep).where("role = 'user'").withColumn("system", F.lit("Make the last message a question that stands alone."))
    alone = rows.where("history = ''").select("conv_id", "turn", F.col("text").alias("asked"), F.col("text").alias("question"))
    talked = generate(rows.where("history <> ''").withColumn("user", F.concat("text", F.lit("\n"), "history")), "followup", tolerant(generator))
    said = F.when(F.col("reply") == REFUSED, "").otherwise(F.col("reply"))
    first = F.trim(F.split_part(said, F.lit("\n"), F.lit(1)))
    return alone.unionByName(talked.select("conv_id", "turn", F.col("text").alias("asked"), F.when(first == "", F.col("text")).otherwise(first).alias("question")))


def listwise(candidates: DataFrame, depth: int = 20, generator: Generator = lambda systems, users: users.map(lambda u: "2, 1")) -> DataFrame:
    """question_id, chunk_id, rank, new_rank, new_score (1 / new rank), refused: the first ``depth`` in the order of a reply that names their numbers, the others below them as they were.

    ``candidates``: question_id, question, chunk_id, rank, text.  After a refusal the
    order stays.
    """
    head = candidates.where(F.col("rank") <= depth).withColumn("number", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))
    numbered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("]\n"), F.trim(x["text"]))), "\n\n")
    asked = head.groupBy("question_id").agg(F.concat(numbered, F.lit("\n\nQuestion: "), F.first("question")).alias("user"), F.count("*").cast("int").alias("n")).withColumn("system", F.lit("Order the passages by relevance."))
    replies = generate(asked, "listwise", tolerant(generator)).select("question_id", F.when(F.col("reply") == REFUSED, "").otherwise(F.col("reply")).alias("reply"), "n", (F.col("reply") == REFUSED).alias("refused"))
    order = query.parse_ranking(replies.select("question_id", "reply", "n")).join(replies.select("question_id", "refused"), "question_id")
    placed = head.join(order.select("question_id", "refused", (F.col("passage") + 1).alias("number"), F.col("place").alias("new_rank")), ["question_id", "number"])
    rest = candidates.where(F.col("rank") > depth).withColumns({"new_rank": F.col("rank"), "refused": F.lit(False)})
    out = placed.select("question_id", "chunk_id", "rank", "new_rank", "refused").unionByName(rest.select("question_id", "chunk_id", "rank", "new_rank", "refused"))
    return out.select("question_id", "chunk_id", "rank", "new_rank", (1.0 / F.col("new_rank")).alias("new_score"), "refused")


def judge(answers: DataFrame, generator: Generator, kind: str = "correctness") -> DataFrame:
    """answers (question_id, question, reference, answer) with ``verdict``: true, false, or null for an unreadable reply."""
    body = F.concat_ws("\n", F.col("question"), F.col("reference"), F.col("answer"))
    asked = answers.withColumns({"system": F.lit(f"Judge the answer's {kind}; reply with a JSON object that has a verdict."), "user": body})
    positive, negative = {"correctness": ("correct", "incorrect"), "faithfulness": ("faithful", "unfaithful")}[kind]
    return generate(asked, f"judge-{kind}", generator).withColumn("verdict", T.verdict(F.col("reply"), positive, negative)).drop("system", "user", "reply", "cached")


def answer_scores(rows: DataFrame) -> DataFrame:
    """question_id, metric, value of answered questions.

    ``rows``: question_id, question_type, answer, reference, judge_correct and
    judge_faithful (nullable), full_support (nullable).  A comparison of strings
    decides where it can, else the judge; an unreadable verdict counts as wrong in
    ``correct`` and is left out of the judge's own scores.
    """
    match, declined = T.match_verdict(F.col("answer"), F.col("reference")), T.is_abstention(F.col("answer"))
    number = lambda c: c.cast("double")
    rows = rows.withColumns({"match": match, "declined": declined, "null_type": F.col("question_type") == "null_query"})
    correct = F.coalesce(F.coalesce("match", "judge_correct"), F.lit(False))
    out = {
        "correct": number(correct),
        "judge_agrees_with_match": number(F.col("judge_correct") == F.col("match")),
        "faithful": F.when(~F.col("declined"), number(F.col("judge_faithful"))),
        "exact_match": number(F.coalesce("match", F.lit(False))),
        "judged": number(F.col("match").isNull()),
        "abstain_null": F.when(F.col("null_type"), number(correct)),
        "correct_answerable": F.when(~F.col("null_type"), number(correct)),
        "false_abstain": F.when(~F.col("null_type"), number(F.col("declined"))),
        "false_abstain_with_support": F.when(~F.col("null_type") & F.col("full_support").isNotNull(), number(F.col("declined") & F.col("full_support"))),
        "false_abstain_without_support": F.when(~F.col("null_type") & F.col("full_support").isNotNull(), number(F.col("declined") & ~F.col("full_support"))),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in out.items()])
    return rows.select("question_id", F.explode(pairs).alias("x")).select("question_id", "x.metric", "x.value").where("value is not null")


class TooExpensive(RuntimeError):
    """An estimate is above what the caller allows."""


def confirmed(estimated: DataFrame, limit: float) -> dict:
    """The estimate's row, or TooExpensive if its cost is above ``limit``."""
    row = estimated.first().asDict()
    if row["cost"] > limit:
        raise TooExpensive(f"{row['calls']} calls would cost {row['cost']:.2f}, above {limit:.2f}")
    return row


def estimate(requests: DataFrame, cache: DataFrame, prices: DataFrame, model: str, output_tokens: int = 100) -> DataFrame:
    """One row: calls, input_tokens, cost of the requests (key, tokens) that the cache lacks, before they are made."""
    one = tables.misses(requests, cache).agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("input_tokens"))
    price = prices.where(F.col("model") == model).agg(F.coalesce(F.max("input"), F.lit(0.0)).alias("i"), F.coalesce(F.max("output"), F.lit(0.0)).alias("o"))
    return one.crossJoin(price).select("calls", "input_tokens", ((F.col("input_tokens") * F.col("i") + F.col("calls") * output_tokens * F.col("o")) / 1e6).alias("cost"))
