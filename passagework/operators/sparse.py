"""BM25 over an inverted index of plain tables, and search without a shuffle of scores.

Postings hold term frequencies and lengths, never scores, so k1 and b are chosen
per query.  ``scores`` and ``best`` work on postings; they shuffle a row for every
question and chunk that share a term.

``search`` does not: the asked terms travel to the chunks, each chunk's term
frequencies are counted once into a forward index (a table), and the questions'
terms with their idf travel to that.  A chunk's scores for all questions are then
known where the chunk is, as a block of a sparse product, and a task sends on its
k best per question.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import tables

#: Decimals on which scores are ranked, so that sums in another order give the same list.
RANK_DECIMALS = 9
#: Asked terms of which so many travel to the chunks.
BROADCAST_TERMS = 200_000
#: Questions that travel at once, at most about, and chunks that are scored at once.
QUESTIONS, CHUNKS = 4096, 512


def postings(chunks: DataFrame, key: str, terms: Column, only: DataFrame | None = None) -> DataFrame:
    """key, term, tf, length: how often each term is in each chunk, and the chunk's terms with repeats.

    ``only``: the terms (term) that are wanted; the others go before anything is
    shuffled if the wanted ones are few enough to travel.
    """
    rows = chunks.select(F.col(key), terms.alias("terms"))
    long = rows.select(key, F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term"))
    if only is not None:
        wanted = only.select("term").distinct()
        few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        long = long.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    return long.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def collection(chunks: DataFrame, terms: Column) -> DataFrame:
    """n, avg_length: one row over all chunks, those without terms included."""
    return chunks.select(F.size(terms).alias("s")).agg(F.count("*").alias("n"), F.avg("s").alias("avg_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_statistics(posted: DataFrame, size: DataFrame) -> DataFrame:
    """term, df, cf, idf.  ``size`` is one row."""
    counted = posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return counted.crossJoin(F.broadcast(size)).select("term", "df", "cf", idf(F.col("n"), F.col("df")).alias("idf"))


def scores(questions: DataFrame, posted: DataFrame, size: DataFrame, key: str, settings: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """question_id, key, score of every chunk that has an asked term.

    ``questions``: question_id, terms; a term counts once per question.
    ``settings``: k1 and b, one row each for a whole grid in one job; they are
    returned too.
    """
    asked = questions.select("question_id", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = posted.join(asked.select("term").distinct(), "term", "left_semi")
    statistics = wanted.groupBy("term").agg(F.count("*").alias("df"))
    found = asked.join(statistics, "term").join(wanted, "term").crossJoin(F.broadcast(size))
    grid = ["k1", "b"] if settings is not None else []
    if settings is not None:
        found = found.crossJoin(F.broadcast(settings))  # a handful of literal rows
    else:
        found = found.withColumns({"k1": F.lit(k1), "b": F.lit(b)})
    part = idf(F.col("n"), F.col("df")) * F.col("tf") / (F.col("tf") + F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("length") / F.col("avg_length")))
    return found.groupBy(*grid, "question_id", key).agg(F.sum(part).alias("score"))


def best(scored: DataFrame, k: int, key: str, by: tuple[str, ...] = ("question_id",), decimals: int = RANK_DECIMALS) -> DataFrame:
    """The ``k`` best of each group with score over 0, ranked from 1, ties by ``key``."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", decimals)), key)
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def asked_terms(questions: DataFrame) -> DataFrame:
    return questions.select(F.explode("terms").alias("term")).distinct()


def forward_index(chunks: DataFrame, key: str, terms: Column, vocabulary: list[str], stem: Callable[[str], str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, length, ids, times and the columns of ``carry``: for each chunk how often it has the terms of ``vocabulary``, by their places in it.

    The JVM finds the terms; equal ones are counted by Arrow and numpy, so Python
    sees each distinct term of a batch once.
    """
    place = chunks.sparkSession.sparkContext.broadcast({t: n for n, t in enumerate(vocabulary)})

    def run(batches):
        get, size, known = place.value.get, max(1, len(place.value)), {}

        def number(term: str) -> int:
            if term not in known:
                if len(known) > 1_000_000:
                    known.clear()
                known[term] = get(stem(term) if stem else term, -1)
            return known[term]

        for batch in batches:
            own = batch.column(1)
            lengths = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = own.flatten().dictionary_encode()
            ids = np.array([number(t) for t in coded.dictionary.to_pylist()], np.int64)
            found = ids[coded.indices.to_numpy(zero_copy_only=False)] if len(ids) else np.zeros(0, np.int64)
            pair, times = np.unique((np.repeat(np.arange(len(lengths)), lengths) * size + found)[found >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(len(lengths) + 1) * size), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pair % size, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), *columns, *batch.columns[2:]], [key, "length", "ids", "times", *carry])

    kinds = dict(chunks.dtypes)
    more = "".join(f", {c} {kinds[c]}" for c in carry)
    return chunks.select(F.col(key), terms.alias("terms"), *carry).mapInArrow(run, f"{key} {kinds[key]}, length long, ids array<int>, times array<int>{more}")


def _best_of(rows: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each question and setting, by rounded score and key."""
    rows = rows.take(pc.sort_indices(rows, [("place", "ascending"), ("rounded", "descending"), ("key", "ascending")]))
    place = rows.column("place").to_numpy()
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    within = np.arange(len(place)) - np.repeat(first, np.diff(np.r_[first, len(place)]))
    return rows.filter(pa.array(within < k))


def _scorer(travelling, key: str, settings: list[tuple[float, float]], average: float, k: int, ids_type, decimals: int):
    """Scores of the forward index's rows for all travelling questions; a task's ``k`` best of each."""

    def run(batches):
        names, first, holder, idf = travelling.value
        n, kept, kind = len(names), None, None
        least = np.zeros(n * len(settings))  # what a chunk needs to be among the best so far

        def merged(found):
            nonlocal kept
            kept = _best_of(pa.concat_tables([found] if kept is None else [kept, found]), k)
            place, score = kept.column("place").to_numpy(), kept.column("rounded").to_numpy()
            full = np.flatnonzero(np.bincount(place, minlength=len(least)) >= k)
            last = np.searchsorted(place, full, "right") - 1
            least[full] = score[last]

        waiting, rows = [], 0
        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, CHUNKS):
                batch = whole.slice(at, CHUNKS)
                keys, length, ids, times = (batch.column(c) for c in range(4))
                size = batch.num_rows
                length = length.to_numpy(zero_copy_only=False).astype(float)
                row = np.repeat(np.arange(size), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
                term, tf = ids.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(float)
                fan = first[term + 1] - first[term]
                if not fan.sum():
                    continue
                entry = np.repeat(np.arange(len(term)), fan)
                cell = holder[np.arange(len(entry)) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(first[term], fan)] * size + row[entry]
                for number, (k1, b) in enumerate(settings):
                    part = idf[term] * tf / (tf + k1 * (1 - b + b * length[row] / average))
                    score = np.bincount(cell, part[entry], n * size).reshape(n, size)
                    need = least[number * n : number * n + n]
                    if size > k:
                        need = np.maximum(need, np.partition(score, size - k, 1)[:, size - k])
                    q, c = np.nonzero((score > 0) & (score >= need[:, None] - 2 * 10.0**-decimals))
                    own = score[q, c]
                    waiting.append(pa.table([pa.array(number * n + q), pa.array(np.round(own, decimals)), keys.take(pa.array(c)), pa.array(own)], ["place", "rounded", "key", "score"]))
                    rows += len(q)
                if rows > 4 * k * len(least) + 100_000:
                    merged(pa.concat_tables(waiting))
                    waiting, rows = [], 0
        if waiting:
            merged(pa.concat_tables(waiting))
        if kept is None:
            return
        place = kept.column("place").to_numpy()
        for at in range(0, len(place), 50_000):
            own, part = place[at : at + 50_000], kept.slice(at, 50_000)
            one = lambda c: part.column(c).combine_chunks()  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(own // n, pa.int32()), pa.array([names[i] for i in (own % n).tolist()], ids_type), one("key").cast(kind), one("score")], ["setting", "question_id", key, "score"])

    return run


def grid_search(questions: DataFrame, chunks: DataFrame, key: str, terms: Column, k: int, settings: list[tuple[float, float]], stem: Callable[[str], str] | None = None, decimals: int = RANK_DECIMALS, carry: tuple[str, ...] = ()) -> DataFrame:
    """setting (its place in ``settings``, pairs of k1 and b), question_id, key, score, rank: the ``k`` best chunks of each question, ties by key; with the chunks' columns ``carry``.

    ``questions``: question_id, terms; a term counts once per question, and a
    question without a term that any chunk has gets no rows.  Questions travel
    about QUESTIONS at a time; the corpus is read once if all asked terms are at
    most BROADCAST_TERMS, and else once for each such part.
    """
    spark = chunks.sparkSession
    tables.bounded_batches(spark)
    kind, key_kind = dict(questions.dtypes)["question_id"], dict(chunks.dtypes)[key]
    ids_type = to_arrow_type(questions.schema["question_id"].dataType)
    order = Window.partitionBy("setting", "question_id").orderBy(F.desc(F.round("score", decimals)), key)
    parts = max(1, -(-questions.count() // QUESTIONS))
    shared = parts == 1 or asked_terms(questions).limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    index, place = None, {}
    out = None
    for part in range(parts):
        rows = questions.select("question_id", "terms").where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == part).collect()  # about QUESTIONS
        stemmed = lambda t: stem(t) if stem else t
        asked = [(r["question_id"], sorted({stemmed(t) for t in r["terms"] or []})) for r in rows]
        if index is None or not shared:
            every = sorted({t for _, own in asked for t in own}) if parts == 1 or not shared else sorted({stemmed(r[0]) for r in asked_terms(questions).collect()})  # at most BROADCAST_TERMS
            place = {t: n for n, t in enumerate(every)}
            index = tables.checkpointed(forward_index(chunks, key, terms, every, stem, carry))
            size = index.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
            holding = np.zeros(len(every))
            counted = index.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()  # a row for each asked term
            holding[counted.column("id").to_numpy()] = counted.column("count").to_numpy()
            weight = np.log(1 + (size["n"] - holding + 0.5) / (holding + 0.5))
        asks = np.array([[place[t], q] for q, (_, own) in enumerate(asked) for t in own], np.int64).reshape(-1, 2)
        asks = asks[np.lexsort((asks[:, 1], asks[:, 0]))]
        first = np.searchsorted(asks[:, 0], np.arange(len(place) + 1))
        travelling = spark.sparkContext.broadcast(([i for i, _ in asked], first, asks[:, 1].copy(), weight))
        run = _scorer(travelling, key, settings, float(size["average"] or 1.0) or 1.0, k, ids_type, decimals)
        found = index.select(key, "length", "ids", "times").mapInArrow(run, f"setting int, question_id {kind}, {key} {key_kind}, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = found.join(index.select(key, *carry), key).select(*found.columns, *carry) if carry else found
        if parts > 1:
            found = tables.checkpointed(found)
            travelling.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def search(questions: DataFrame, chunks: DataFrame, key: str, terms: Column, k: int = 10, k1: float = 1.2, b: float = 0.75, stem: Callable[[str], str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """question_id, key, score, rank of one setting, and the columns of ``carry``."""
    return grid_search(questions, chunks, key, terms, k, [(k1, b)], stem, carry=carry).drop("setting")
