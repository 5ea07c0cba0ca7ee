"""Best-fit packing of token sequences by patterns.

Every document is encoded and cut into pieces of at most ``CAPACITY`` tokens.
Only the histogram of piece lengths (at most ``CAPACITY`` numbers) reaches the
driver, which plans how often each pattern of lengths is used:

1. all patterns of one to three lengths that fill a sequence exactly are
   enumerated, and non-negative least squares fits their repeat counts to the
   histogram (coordinate descent; long pieces weigh more, as short ones are
   easier to place);
2. the counts are rounded, never beyond the pieces that there are;
3. the residual histogram is packed best-fit decreasing.

A plan says for each length which ranks among the pieces of that length go to
which sequences.  Ranks are counted per task while encoding and made global by
a join with the running totals of the tasks, so no group is ever collected.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet, packed
from .common import Memo, documents, id_and_text, materialize, tokenizer_path

CAPACITY = 2048
#: Distinct chunks of text whose ids a worker remembers.
MEMO = 1_000_000
#: Rounds of the least-squares fit, and coordinates that change in one.
ROUNDS, WIDTH = 400, 128
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE = re.compile(f"[^{SPACES}]+")


#: The printable stand-ins of bytes, by code.
STAND_INS = {b: c for c, b in byte_alphabet().items()}
#: Beyond the Latin letters that have one form each in either case, without combining marks.
BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]")


class ChunkEncoder:
    """Encodes whole texts with a word-level BPE file of the tokenizers library.

    Such a file drops white space and joins nothing across it, so a text's ids
    are those of its chunks between white space, each encoded once and then
    remembered.  A chunk that is one word, with a full stop or comma or without,
    goes to the library's merges straight away; any other takes all its steps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.words = Memo(self.word, MEMO // 2)
        self.chunks = Memo(self.chunk, MEMO)

    def word(self, word: str) -> bytes:
        """Ids of one piece, straight from the merges."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(STAND_INS)
        return packed([t.id for t in self.model.tokenize(word)])

    def chunk(self, chunk: str) -> bytes:
        if not BEYOND.search(chunk):  # beyond, lower-casing and normalising might not commute
            word = chunk.lower()
            stop = word[-1] if word[-1] in ".," else ""
            word = word[: len(word) - len(stop)]
            if word.isalpha():  # one piece, and the stop another
                return self.words[word] + self.words[stop] if stop else self.words[word]
        return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        # str.split() also splits at the four separators, which are no white space in Unicode's sense
        parts = WHITE.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))


def pieces(df: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, task_rank: the pieces of each document, ranked per task and length."""

    def run(batches):
        encoder = ChunkEncoder(tokenizer_path(vocabulary))
        task, seen = TaskContext.get().partitionId(), np.zeros(CAPACITY + 1, np.int64).tolist()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), (encoder.encode(t or "") for t in batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    own = ids[at : at + 4 * CAPACITY]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), task, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long")


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of lengths that sum to ``capacity``; 0 stands for no piece."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    out = []
    for a in lengths[lengths * 3 >= capacity]:
        b = np.arange((capacity - a + 1) // 2, min(a, capacity - a) + 1)
        c = capacity - a - b
        ok = there[b] & there[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit_counts(histogram: np.ndarray, patterns: np.ndarray, capacity: int) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squares of histogram - A x, by block coordinate descent."""
    weight = np.linspace(0.1, 1.0, capacity + 1)
    weight[0] = 0.0
    rest, x = histogram.astype(float), np.zeros(len(patterns))
    rest[0] = 0.0
    size = weight[patterns].sum(1) + 2 * (weight[patterns[:, 1]] * (patterns[:, 0] == patterns[:, 1]) + weight[patterns[:, 2]] * (patterns[:, 1] == patterns[:, 2]))
    for _ in range(ROUNDS if len(patterns) else 0):
        step = np.maximum((weight * rest)[patterns].sum(1) / size, -x)
        gain = step * step * size
        best = np.argpartition(-gain, min(len(gain) - 1, 8 * WIDTH))[: 8 * WIDTH]
        best = best[np.argsort(-gain[best], kind="stable")]
        if abs(step[best[0]]) < 0.25:
            break
        used, done = set(), 0
        for p in best.tolist():
            own = {*patterns[p].tolist()} - {0}
            if own & used or abs(step[p]) < 0.25:
                continue
            used |= own
            x[p] += step[p]
            for part in patterns[p].tolist():
                rest[part] -= step[p]
            done += 1
            if done == WIDTH:
                break
    return x


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Pattern -> count, best-fit decreasing; sequences with the same contents are handled together."""
    spaces: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            fits = min((s for s in spaces if s >= length and spaces[s]), default=None)
            if fits is None:
                each = capacity // length
                full, odd = divmod(n, each)
                if full:
                    spaces[capacity - each * length][(length,) * each] += full
                if odd:
                    spaces[capacity - odd * length][(length,) * odd] += 1
                break
            pattern, there = next(iter(spaces[fits].items()))
            take = min(n, there)
            if take == there:
                del spaces[fits][pattern]
            else:
                spaces[fits][pattern] -= take
            spaces[fits - length][(*pattern, length)] += take
            n -= take
    out: Counter = Counter()
    for patterns in spaces.values():
        out.update(patterns)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Pattern (lengths, falling) -> number of sequences."""
    out: Counter = Counter()
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    if histogram.get(capacity):
        out[(capacity,)] = histogram[capacity]
    have = np.zeros(capacity + 1, np.int64)
    for n, c in left.items():
        have[n] = c
    patterns = exact_patterns(np.array(sorted(left), np.int64), capacity)
    counts = np.rint(fit_counts(have, patterns, capacity)).astype(np.int64)
    for p in np.argsort(-counts, kind="stable"):
        if counts[p] <= 0:
            break
        pattern = tuple(x for x in patterns[p].tolist() if x)
        need = Counter(pattern)
        n = min(int(counts[p]), *(int(have[x]) // k for x, k in need.items()))
        if n > 0:
            out[pattern] += n
            for x, k in need.items():
                have[x] -= n * k
    out.update(best_fit({n: int(have[n]) for n in left if have[n]}, capacity))
    return out


def slots(planned: Counter) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks, first sequences and offsets of the runs of equal slots."""
    runs: dict[int, list[list[int]]] = defaultdict(lambda: [[0], [], []])
    sequence = 0
    for pattern, n in sorted(planned.items()):
        at = 0
        for length in pattern:
            first, base, offset = runs[length]
            base.append(sequence)
            offset.append(at)
            first.append(first[-1] + n)
            at += length
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in r) for length, r in runs.items()}


def pack(df: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is the end id alone.  Rows with a null id and repeated
    rows are packed like any other; an empty table gives an empty table.  Very
    long texts are encoded whole and cut into pieces; which of several pieces of
    one length goes where is a tie, and is decided by their order in the table.
    Other columns than id and text are not read.
    """
    cut = materialize(pieces(df, vocabulary, end_id, id_col, text_col))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most CAPACITY rows
    places = slots(plan(histogram))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("task", "length").count().select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(totals, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("task_rank")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, base, at = places[int(n)]
                k = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = base[k] + rank[own] - first[k]
                offset[own] = at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark, sf_dir) -> DataFrame:
    return pack(documents(spark, sf_dir))
