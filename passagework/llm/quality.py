"""Repetition rules from a word-level suffix array.

The words of many documents are laid end to end; a word counts together with
its document, and every document ends in a symbol of its own, so that no match
leaves a document.  Prefix doubling sorts the suffixes (positions whose rank is
already unique are not sorted again), and the ranks of every doubling round give
the longest common prefixes of neighbours.  The deepest LCP interval around a
suffix is as deep as the larger of its two neighbour values, so the spans of all
maximal repeated substrings are ``[i, i + that)``; their union is the covered
part of a document and the largest value its longest repeat.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, id_and_text

#: Words of which a repeat has at least so many.
MIN_REPEAT = 8
#: Per cent of a document's words that repeats may cover (the base rule allows 30), and that its longest repeat may have (if that has LONG_WORDS words).
MAX_COVERED, MAX_LONGEST, LONG_WORDS = 25, 25, 30
#: Words whose suffixes are sorted together; a longer document is sorted alone.
SORT_WORDS = 150_000
SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\x0b\x0c\r "


def suffix_levels(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and the ranks of the prefixes of length 1, 2, 4, ...  The last symbol must be unique."""
    n = len(symbols)
    at = np.arange(n)
    order = np.argsort(symbols)
    fresh = np.r_[True, np.diff(symbols[order]) != 0][:n]
    starts = np.maximum.accumulate(np.where(fresh, at, 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    levels, active, step = [rank], order[np.bincount(starts, minlength=n)[starts] > 1], 1
    while active.size:
        key = rank[active] * n + rank[active + step]
        by = np.argsort(key)
        active, key = active[by], key[by]
        group = rank[active]
        i = at[: len(active)]
        first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], i, 0))
        sub = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], i, 0))
        rank = rank.copy()
        rank[active] = group + sub - first
        levels.append(rank)
        active = active[np.bincount(sub, minlength=len(active))[sub] > 1]
        step *= 2
    array = np.empty(n, np.int64)
    array[rank] = at
    return array, levels


def deepest(symbols: np.ndarray) -> np.ndarray:
    """Per position, the length of the longest substring that starts there and occurs elsewhere too."""
    array, levels = suffix_levels(symbols)
    a, b = array[:-1], array[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    length = np.zeros(len(near), np.int64)
    for k in reversed(range(len(levels))):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    out = np.zeros(len(symbols), np.int64)
    np.maximum.at(out, a, length)
    np.maximum.at(out, b, length)
    return out


def repeats(texts_words: list[list[bytes]], least: int = MIN_REPEAT) -> list[tuple[int, int]]:
    """Per document: words covered by repeats of at least ``least`` words, and the words of the longest repeat."""
    out: list[tuple[int, int]] = []
    batch: list[list[bytes]] = []

    def flush():
        number = defaultdict(count().__next__)
        ends = np.cumsum([len(w) + 1 for w in batch])
        ids = np.full(ends[-1], -1, np.int64)
        doc = np.zeros(ends[-1], np.int64)
        start = 0
        for k, words in enumerate(batch):
            ids[start : ends[k] - 1] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            doc[start : ends[k]] = k
            start = ends[k]
        deep = deepest(doc * (len(number) + 1) + ids + 1)
        long = np.flatnonzero(deep >= least)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, long, 1)
        np.add.at(edge, long + deep[long], -1)
        covered = np.cumsum(edge)[:-1] > 0
        begin = np.r_[0, ends[:-1]]
        out.extend(zip(np.add.reduceat(covered.astype(np.int64), begin).tolist(), np.maximum.reduceat(deep, begin).tolist(), strict=True))
        batch.clear()

    size = 0
    for words in texts_words:
        if batch and size + len(words) > SORT_WORDS:
            flush()
            size = 0
        batch.append(words)
        size += len(words) + 1
    if batch:
        flush()
    return out


def measure(texts: list[str | None]) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat, base_failed, kept of each text."""
    texts = [t or "" for t in texts]
    words = [t.encode().split() for t in texts]
    rows = []
    for text, w, (covered, longest) in zip(texts, words, repeats(words), strict=True):
        n = len(w)
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        failed = n < 20 or 100 * covered > 30 * n
        kept = not failed and 100 * covered <= MAX_COVERED * n and (longest < LONG_WORDS or 100 * longest <= MAX_LONGEST * n)
        rows.append((n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), covered, longest, failed, kept))
    return rows


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of ``FIELDS`` for every row.

    A null or empty text has no words and fails the base rules.  Rows with a
    null id and repeated rows are judged like any other, long texts whole; other
    columns than id and text are not read, and an empty table gives no rows.  No
    shuffle; memory is bounded by one Arrow batch and the suffixes that are sorted
    together.
    """

    def run(batches):
        types = [pa.int64()] * 6 + [pa.bool_()] * 2
        for batch in batches:
            columns = list(zip(*measure(batch.column(1).to_pylist()), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])

    return id_and_text(df, id_col, text_col).mapInArrow(run, f"doc_id long, {FIELDS}")


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text the rules keep.

    A null or empty text has no words and goes.  Rows are judged one by one, so
    repeated rows go or stay together, and null ids don't matter.
    """
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([x[-1] for x in measure(batch.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op2_quality(spark, sf_dir) -> DataFrame:
    return repetition_rules(documents(spark, sf_dir))
