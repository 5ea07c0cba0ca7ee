"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Both classes have a model of order six over a word's characters (with marks for
its beginning and end).  The highest order has the class's own counts; all lower
orders are one Kneser-Ney model of the continuation counts of both classes
together, so that an expression that one class has rarely or never is smoothed
towards the same distribution in both:

    P_c(x | h) = (max(c_c(hx) - D, 0) + D n_c(h) P(x | h')) / c_c(h)

Where ``hx`` was seen in neither class P cancels in the difference of the two log
likelihoods, so a model is two tables: a log ratio per seen ``hx`` and one per
seen context ``h``.

An expression is a word.  Its toxic and ordinary log likelihoods are normalised
by its length and compared; a text's evidence is the largest difference that any
of its words has (over a whole text a few expressions would be lost in the mean),
and one logistic function, fitted on documents that the counts have not seen,
maps it to a score.  The evidence counts up to a bound, chosen by likelihood, so
that a few wrongly labelled documents with very telling words don't flatten it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_texts, bucket_of, discard, documents, hash_sample, id_and_text, materialize

#: Bounds of what is learned: labelled documents per class, those with the smallest hash of the id, and their characters.
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 24_000_000
ORDER, DISCOUNT = 6, 0.75
#: Counts by fold and class.
COUNTS = ("n00", "n01", "n10", "n11")
BEGIN, END = "\x02", "\x03"
#: Score from which a text counts as toxic.
THRESHOLD = 0.7
EDGES = " \t\r\n.,;:!?\"'()[]{}*#%&$|<>-_/\\"


def words(text: str | None) -> list[str]:
    """Lower-cased words without the punctuation at their ends."""
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


def grams(word: str) -> list[str]:
    """For each character of the word and its end, the character with up to ORDER - 1 before it."""
    s = BEGIN + word + END
    return [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]


def log_ratios(names: list[str], ordinary: list[int], toxic: list[int]) -> tuple[dict[str, float], dict[str, float]]:
    """The two tables, from the counts of each gram in ordinary and in toxic text."""
    own = [{g: n for g, n in zip(names, counts, strict=True) if n} for counts in (ordinary, toxic)]
    seen = own[0].keys() | own[1].keys()
    lower: list[Counter] = []  # continuation counts, from order ORDER - 1 down to 1
    above = seen
    for _ in range(ORDER - 1):
        lower.append(Counter(g[1:] for g in above if len(g) > 1))
        above = lower[-1].keys()
    totals = []
    for c in lower:
        t: defaultdict[str, list[int]] = defaultdict(lambda: [0, 0])
        for g, n in c.items():
            x = t[g[:-1]]
            x[0] += n
            x[1] += 1
        totals.append(t)
    alphabet = len({g[-1] for g in seen}) + 1  # and one for all others

    def backed(h: str, x: str, level: int) -> float:
        if level == len(lower):
            return 1 / alphabet
        rest = backed(h[1:], x, level + 1) if h else 1 / alphabet
        total, types = totals[level].get(h, (0, 0))
        return (max(lower[level].get(h + x, 0) - DISCOUNT, 0) + DISCOUNT * types * rest) / total if total else rest

    sums, back = [], []
    for c in own:
        total, types = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        sums.append(total)
        back.append({h: DISCOUNT * types[h] / total[h] for h in total})
    contexts = {h: math.log(back[1].get(h, 1.0)) - math.log(back[0].get(h, 1.0)) for h in back[0].keys() | back[1].keys()}
    table = {}
    for g in seen:
        h, p = g[:-1], backed(g[1:-1], g[-1], 0)
        a, b = ((max(own[k].get(g, 0) - DISCOUNT, 0) / sums[k][h] if sums[k][h] else 0.0) + back[k].get(h, 1.0) * p for k in (0, 1))
        table[g] = math.log(b) - math.log(a)
    return table, contexts


class Scorer:
    """Evidence and scores of texts.  ``weights``: of the constant and of the evidence, and the bound up to which that counts."""

    def __init__(self, table: dict, contexts: dict, weights: list[float] | None):
        self.table, self.contexts, self.weights = table, contexts, weights
        self.difference = Memo(self.of_token, 300_000)

    def of_token(self, token: str) -> float:
        """Toxic less ordinary log likelihood of a lower-cased token's word, each divided by the word's length with its end; -inf without a word."""
        word = token.strip(EDGES)
        if not word:
            return -math.inf
        out, get, of = 0.0, self.table.get, self.contexts.get
        for g in grams(word):
            r = get(g)
            out += of(g[:-1], 0.0) if r is None else r
        return out / (len(word) + 1)

    def evidence(self, text: str | None) -> float:
        """The largest difference of a word of the text; 0 without words."""
        best = max(map(self.difference.__getitem__, set((text or "").lower().split())), default=-math.inf)
        return best if best > -math.inf else 0.0

    def score(self, text: str | None) -> float:
        z = self.weights[0] + self.weights[1] * min(self.evidence(text), self.weights[2])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, shrink: float = 0.03, rounds: int = 50) -> list[float]:
    """Weights by Newton's method; a small ridge keeps them finite where the evidence separates the classes."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w)), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def calibrated(x: np.ndarray, y: np.ndarray) -> list[float]:
    """The two weights and the bound of the evidence, of those at every fortieth of the upper half and none, that make the labels likeliest."""
    best, out = -math.inf, [0.0, 0.0, math.inf]
    for bound in [math.inf, *np.unique(np.quantile(x, np.linspace(0.5, 1, 41))).tolist()]:
        rows = np.stack([np.ones(len(x)), np.minimum(x, bound)], 1)
        w = logistic(rows, y)
        z = rows @ np.array(w)
        likelihood = -float((np.logaddexp(0, -z) * y + np.logaddexp(0, z) * (1 - y)).sum())
        if likelihood > best + 1e-9:
            best, out = likelihood, [*w, bound]
    return out


def labelled(docs: DataFrame, labels: DataFrame, train, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """label (0 or 1), id, text of the training sample: of each class at most SAMPLE_DOCS documents, of SAMPLE_CHARS characters together.

    Rows whose label is neither 0 nor 1 are not used; a document labelled twice is
    used with each label, and one whose row is repeated once.
    """
    rows = labels.where(train & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull())
    texts = docs.where(train).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded_texts(texts, materialize(hash_sample(rows, "label", "id", SAMPLE_DOCS)), ["id"], "label", SAMPLE_CHARS)


def packed(tables: tuple[dict, dict]) -> list:
    """The tables in little room, to travel."""
    return [("\n".join(t), np.fromiter(t.values(), np.float32, len(t))) for t in tables]


def unpacked(tables: list) -> list[dict]:
    return [dict(zip(names.split("\n"), numbers.tolist(), strict=True)) if len(numbers) else {} for names, numbers in tables]


def fit(docs: DataFrame, labels: DataFrame, train, **columns) -> tuple[list, list[float]]:
    """The two tables (packed), from the whole sample, and the weights.

    The weights are fitted on the evidence of each half by the tables of the other
    half, as a text's own words would look more telling than they are.  With no
    document of one class the second weight is 0, and the first says which class
    there is.  Grams are counted by the executors; the driver gets a row for each
    distinct gram of the bounded sample.
    """
    sample = materialize(labelled(docs, labels, train, **columns).select("label", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).cast("int").alias("fold"), "text"))

    def count(batches):
        total = [Counter() for _ in COUNTS]
        for batch in batches:
            for label, fold, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = total[2 * fold + label]
                for w, n in Counter(words(text)).items():
                    for g in grams(w):
                        own[g] += n
        names = list(set().union(*total))
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[g] for g in part], pa.int64()) for c in total)], ["gram", *COUNTS])

    counted = sample.mapInArrow(count, "gram string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])
    found = counted.toArrow()
    names = found.column("gram").to_pylist()
    n00, n01, n10, n11 = (found.column(c).to_numpy() for c in COUNTS)
    ordinary, toxic = int((n00 + n10).sum()), int((n01 + n11).sum())
    if not ordinary or not toxic:
        discard(sample)
        return packed(({}, {})), [0.0 if ordinary == toxic else 20.0 if toxic else -20.0, 0.0, math.inf]
    # fold 0 is read with fold 1's counts
    halves = docs.sparkSession.sparkContext.broadcast([packed(log_ratios(names, a.tolist(), b.tolist())) for a, b in ((n10, n11), (n00, n01))])

    def describe(batches):
        scorers = [Scorer(*unpacked(tables), None) for tables in halves.value]
        for batch in batches:
            x = [scorers[fold].evidence(t) for fold, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["label", "x"])

    seen = sample.mapInArrow(describe, "label int, x double").collect()  # a row per sampled document
    weights = calibrated(np.array([r[1] for r in seen]), np.array([r[0] for r in seen], float))
    halves.destroy()
    discard(sample)
    return packed(log_ratios(names, (n00 + n10).tolist(), (n01 + n11).tolist())), weights


def score(df: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted.  No shuffle.

    A null or empty text has no evidence either way, and so the score of evidence
    0; repeated rows and rows with a null id are scored like any other, long texts
    whole; other columns than id and text are not read, and an empty table gives
    no rows.
    """
    tables, weights = df.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches):
        scorer = Scorer(*unpacked(tables.value), weights)
        for batch in batches:
            s = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(df: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text scores below THRESHOLD.

    Rows are judged one by one, so repeated rows go or stay together, and null ids
    don't matter; a null or empty text is judged as by ``score``.
    """
    at = df.columns.index(text_col)
    tables, weights = df.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches):
        scorer = Scorer(*unpacked(tables.value), weights)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < THRESHOLD for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def training(column: str = "doc_id"):
    return bucket_of(column, 3) != 1


def op9_toxicity(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training())
    return score(docs, model).select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
