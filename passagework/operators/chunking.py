"""Cutting documents into chunks with exact offsets.

A chunk is chunk_id, doc_id, text, start_char, end_char: spans tile the document,
separators stay with the piece before them, white space alone makes no chunk, and
only kept chunks are numbered.  Fixed windows and lines are found by the JVM, and
Arrow adds up their lengths; splitters that look at sentences scan a text once for
the places where it may be cut.  One document is cut at a time, without a shuffle,
in time that grows with its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Span = tuple[int, int]

# Words before a full stop that ends no sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs inc ltd co corp no gen sen rep gov u.s u.k e.g i.e a.m p.m jan feb mar apr jun jul aug sep sept oct nov dec".split())
# Fixed value: closing punctuation with closing quotes or brackets and white space, or a line break.
SENTENCE = re.compile(r"""[.!?]+["'”’)\]]*\s+|\s*\n\s*""")
LOOK_BACK = 12


def numbered(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds chunk_id, ``doc:0000`` by start, to spans that are not blank."""
    kept = rows.where(F.col("text").rlike(r"(?U)\S"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("start_char", "end_char")) - 1
    return kept.withColumn("chunk_id", F.format_string("%s:%04d", F.col(key).cast("string"), n))


def placed(rows: DataFrame) -> DataFrame:
    """doc_id, n, start_char, text, total: one row per element of ``texts``, which begin where the ``lengths`` before them end.

    ``rows``: doc_id, total, texts, lengths (in code points).  Running sums over
    whole batches, so the time is linear in the pieces.
    """
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            doc, total, texts, lengths = (batch.column(k) for k in range(4))
            sizes = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            own = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            before = np.cumsum(own) - own
            row = np.repeat(np.arange(len(sizes)), sizes)
            start = before - before[first[row]] if len(own) else before
            n = np.arange(len(own)) - first[row]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([doc.take(at), pa.array(n, pa.int32()), pa.array(start, pa.int32()), texts.flatten(), total.take(at)], ["doc_id", "n", "start_char", "text", "total"])

    return rows.select("doc_id", F.col("total").cast("int"), "texts", "lengths").mapInArrow(run, f"doc_id {kind}, n int, start_char int, text string, total int")


def chunk_name(doc: Column, n: Column) -> Column:
    return F.format_string("%s:%04d", doc.cast("string"), n)


def fixed(docs: DataFrame, size: int = 512, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` tokens (a run of visible characters with the space before it), step ``size - overlap``.

    A window that the one before covers is left out.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    run = lambda least, most: F.lit(rf"(?:\s*+\S++){{{least},{most}}}+(?:\s+\z)?")  # noqa: E731  possessive: no stack per token
    # units of step tokens tile the text; a window is a unit and the first tokens of those after it
    units = docs.select("doc_id", F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), run(1, step), F.lit(0)).alias("u")).where(F.size("u") > 0)
    total = (F.size("u") - 1) * step + F.regexp_count(F.element_at("u", -1), F.lit(r"\S+"))
    more = -(-overlap // step)

    def window(unit: Column, n: Column) -> Column:
        return F.concat(unit, F.coalesce(F.regexp_substr(F.array_join(F.slice("u", n + 2, F.lit(more)), ""), run(1, overlap)), F.lit(""))) if overlap else unit

    texts, lengths = F.transform("u", window), F.transform("u", F.length)
    rows = placed(units.select("doc_id", total.alias("total"), texts.alias("texts"), lengths.alias("lengths"))).where((F.col("n") == 0) | (F.col("n") * step + overlap < F.col("total")))
    made = rows.select("doc_id", chunk_name(F.col("doc_id"), F.col("n")).alias("chunk_id"), "start_char", "text", F.least(F.col("total") - F.col("n") * step, F.lit(size)).alias("n_tokens"))
    return made.withColumn("end_char", F.col("start_char") + F.length("text"))


def lines(docs: DataFrame) -> DataFrame:
    """One chunk per line; blank lines stay with the line before them."""
    t = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\s*\S[^\n]*(?:\n(?:[^\S\n]*\n)*(?:[^\S\n]+$)?)?"), F.lit(0))
    rows = placed(docs.select("doc_id", t.alias("texts")).where(F.size("texts") > 0).select("doc_id", F.lit(0).alias("total"), "texts", F.transform("texts", F.length).alias("lengths")))
    return rows.select("doc_id", chunk_name(F.col("doc_id"), F.col("n")).alias("chunk_id"), "start_char", (F.col("start_char") + F.length("text")).alias("end_char"), "text")


def with_text(spans: DataFrame, docs: DataFrame, few: int = 1_000_000) -> DataFrame:
    """``spans`` (doc_id, start_char, end_char, ...) with their text, cut from the documents; up to ``few`` spans travel."""
    travels = spans.limit(few + 1).count() <= few
    cut = F.substring(F.col("_text"), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    return docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(spans) if travels else spans, "doc_id").withColumn("text", cut).drop("_text")


# --- splitters over one text -------------------------------------------------------------

#: Kinds of places where a text may be cut.
PARAGRAPH, LINE, SENTENCE_END, WORD = "paragraph", "line", "sentence", "word"


class Scan:
    """One text: where its tokens (runs of visible characters) begin and end, and after which separators it may be cut."""

    def __init__(self, text: str):
        self.text = text
        self.begin, self.end = [], []
        for m in re.finditer(r"\S+", text):
            self.begin.append(m.start())
            self.end.append(m.end())
        self._cuts: dict[str, list[int]] = {}

    def cuts(self, kind: str) -> list[int]:
        """All places of a kind, in order."""
        if kind not in self._cuts:
            if kind == WORD:
                own = self.begin[1:]
            elif kind == LINE:
                own = [m.end() for m in re.finditer("\n", self.text)]
            elif kind == PARAGRAPH:
                own = [m.end() for m in re.finditer(r"\n\s*\n", self.text)]
            else:
                own = [m.end() for m in SENTENCE.finditer(self.text) if "\n" in m[0] or m[0][0] != "." or self.closes(m.start(), m.end())]
            self._cuts[kind] = own
        return self._cuts[kind]

    def closes(self, stop: int, after: int) -> bool:
        """Whether a full stop ends a sentence: not before a lower-case letter, nor after an abbreviation or an initial."""
        if self.text[after : after + 1].islower():
            return False
        words = self.text[max(0, stop - LOOK_BACK) : stop].split()
        word = words[-1].lower().lstrip("(\"'“‘") if words else ""
        return not (word in ABBREVIATIONS or len(word) == 1 and word.isalpha())

    def tokens(self, span: Span) -> tuple[int, int]:
        """The numbers of the span's first token and of the one after its last."""
        return bisect_left(self.begin, span[0]), bisect_left(self.begin, span[1])

    def count(self, span: Span) -> int:
        first, last = self.tokens(span)
        return last - first

    def divided(self, span: Span, places: Sequence[int]) -> list[Span]:
        """``span`` cut at those of ``places`` that have a token of it on both sides.

        Of several places between two tokens the last one counts, so that white
        space stays with what is before it.
        """
        first, last = self.tokens(span)
        before: dict[int, int] = {}  # number of a token -> the last place before it
        for place in places[bisect_right(places, span[0]) : bisect_left(places, span[1])]:
            before[bisect_left(self.begin, place)] = place
        edges = [span[0], *(place for n, place in before.items() if first < n < last), span[1]]
        return list(zip(edges, edges[1:], strict=False)) if span[1] > span[0] else []

    def by_tokens(self, span: Span, size: int) -> list[Span]:
        """``span`` cut before every ``size``-th token."""
        first, last = self.tokens(span)
        return self.divided(span, [self.end[n - 1] for n in range(first + size, last, size)])

    def packed(self, span: Span, size: int, overlap: int, kinds: Sequence[str]) -> list[Span]:
        """Pieces of the first kind, neighbours joined while they fit; a piece beyond ``size`` is cut by the other kinds in turn, at last by tokens."""
        if not kinds:
            return self.by_tokens(span, size)
        out: list[Span] = []
        fitting: list[Span] = []
        for piece in [*self.divided(span, self.cuts(kinds[0])), None]:
            if piece and self.count(piece) <= size:
                fitting.append(piece)
                continue
            out += pack(fitting, [self.count(p) for p in fitting], size, overlap)
            fitting = []
            if piece:
                out += self.packed(piece, size, overlap, kinds[1:])
        return out

    def visible(self, span: Span) -> bool:
        return self.count(span) > 0


def pack(pieces: Sequence[Span], sizes: Sequence[int], size: int, overlap: int = 0) -> list[Span]:
    """Neighbours joined while they fit; with overlap, a chunk begins with the whole tail pieces that fit into it and leave room."""
    out: list[Span] = []
    i, n = 0, len(pieces)
    first = 0
    while i < n:
        total = sum(sizes[first:i])
        while i < n and (i == first or total + sizes[i] <= size):
            total += sizes[i]
            i += 1
        out.append((pieces[first][0], pieces[i - 1][1]))
        if i == n:
            break
        tail, back = 0, i
        while overlap and back - 1 > first and tail + sizes[back - 1] <= overlap and tail + sizes[back - 1] + sizes[i] <= size:
            back -= 1
            tail += sizes[back]
        first = back
    return out


LEVELS = {"recursive": (PARAGRAPH, LINE, SENTENCE_END, WORD), "paragraph": (PARAGRAPH, SENTENCE_END, WORD), "sentence": (SENTENCE_END, WORD)}


def _emit(docs: DataFrame, cut: Callable[[str], list[tuple]], extra: str = "") -> DataFrame:
    """chunk_id, doc_id, text, start_char, end_char and what ``cut`` adds to each span."""
    kind = dict(docs.dtypes)["doc_id"]
    fields = f"chunk_id string, doc_id {kind}, text string, start_char int, end_char int{extra}"
    names = [f.strip().split()[0] for f in fields.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                for start, end, *more in cut(text or ""):
                    if text[start:end].strip():
                        rows.append((f"{doc}:{n:04d}", doc, text[start:end], start, end, *more))
                        n += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.string(), batch.column(0).type, pa.string(), pa.int32(), pa.int32(), *([pa.string(), pa.int32(), pa.int32(), pa.string()] if extra else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def structure_chunks(docs: DataFrame, kind: str = "recursive", size: int = 512, overlap: int = 0) -> DataFrame:
    """``recursive`` (paragraph, line, sentence, word, token), ``paragraph`` or ``sentence``."""
    levels = LEVELS[kind]
    return _emit(docs, lambda text: Scan(text).packed((0, len(text)), size, overlap, levels))


def parent_child(docs: DataFrame, parent_size: int = 512, child_size: int = 128, kind: str = "recursive") -> DataFrame:
    """One row per child: text and offsets of its parent, the child in embed_text, child_start and child_end; ids ``parent:00``."""
    if not child_size < parent_size:
        raise ValueError("children must be smaller than their parent")
    levels = LEVELS[kind]

    def cut(text: str) -> list[tuple]:
        scan, out = Scan(text), []
        for n, parent in enumerate(filter(scan.visible, scan.packed((0, len(text)), parent_size, 0, levels))):
            children = filter(scan.visible, scan.packed(parent, child_size, 0, levels))
            out += [(*parent, text[c[0] : c[1]], *c, f"{n:04d}:{k:02d}") for k, c in enumerate(children)]
        return out

    rows = _emit(docs, cut, ", embed_text string, child_start int, child_end int, place string")
    own = F.concat_ws(":", F.col("doc_id").cast("string"), "place")
    return rows.withColumn("chunk_id", own).withColumn("parent_id", F.regexp_replace(own, r":\d+$", "")).drop("place")


def hashed_vectors(texts: list[str], dimensions: int = 256) -> np.ndarray:
    """Counts of words by crc32, one row per text; the offline stand-in for an embedder."""
    from zlib import crc32

    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts, strict=True):
        for w in re.findall(r"\w+", text.lower()):
            row[crc32(w.encode()) % dimensions] += 1
    return out


def breakpoints(vectors: np.ndarray, percentile: float) -> list[int]:
    """Where the distance of neighbours is strictly above the percentile of all."""
    if len(vectors) < 2:
        return []
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    gap = 1 - (rows[:-1] * rows[1:]).sum(1)
    return np.flatnonzero(gap > np.percentile(gap, percentile)).tolist()


def semantic(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_vectors, percentile: float = 90, max_size: int = 512, window: int = 1) -> DataFrame:
    """Segments between the largest jumps in meaning of neighbouring sentences (each embedded with ``window`` neighbours), packed to ``max_size``."""

    def cut(text: str) -> list[Span]:
        scan = Scan(text)
        whole = (0, len(text))
        own = [s for s in scan.divided(whole, scan.cuts(SENTENCE_END)) if scan.visible(s)]
        wide = [text[own[max(0, i - window)][0] : own[min(len(own) - 1, i + window)][1]] for i in range(len(own))]
        ends = [own[i][1] for i in breakpoints(embed(wide), percentile)] if own else []
        out: list[Span] = []
        for segment in scan.divided(whole, ends):
            out += scan.packed(segment, max_size, 0, LEVELS["sentence"])
        return out

    return _emit(docs, cut)


def profile(chunks: DataFrame, tokens: Column, limit: int) -> DataFrame:
    """n_chunks, n_docs, mean, least, most, at_limit, short (below 100 tokens) in one pass."""
    rows = chunks.withColumn("_t", tokens)
    return rows.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.avg("_t").alias("mean_tokens"), F.min("_t").alias("least"), F.max("_t").alias("most"), F.count_if(F.col("_t") >= limit).alias("at_limit"), F.count_if(F.col("_t") < 100).alias("short"))
