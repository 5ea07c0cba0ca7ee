"""Removal of passages that occur twice, found by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  Two equal windows, wherever they
start, have a common offset at which both are at a cover position modulo
``PERIOD`` (that is what a difference cover is), and there begins an equal anchor of
``ANCHOR`` words.  So only anchors at cover positions are hashed (5 of 21), and only
windows that hold an anchor that occurs twice are then extended to full length
and compared by 128-bit hashes.

Both comparisons are the same distributed step.  A task hashes the texts of a
chunk and sends each distinct hash once, packed, to the bucket of its value; a
hash that is in a third of all texts so reaches its bucket once per chunk.  The
bucket answers with the places whose hash came twice, and per chunk these become
one bitmap per text.  Bitmaps are keyed by the checksum of the whole text, so
equal texts share one.  A chunk's places are numbers, so a task that is run again
must see its rows in the same order: rows that don't come from a scan are
sorted by their key first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, discard, documents, in_file_order, input_bytes, materialize

WINDOW, PERIOD = 35, 21
#: Fixed value: a difference cover modulo 21 (every residue is a difference of two of them).
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
#: Hashes that a task gathers before it sends them, and bytes of input per bucket.
CHUNK, BUCKET_BYTES = 1_500_000, 8 << 20
#: Bitmaps of at most so many bytes in all are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 24 << 20
NONE = 2**32 - 1
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses


class Windows:
    """Hashes of all windows of a text, from running sums of its words' hashes times powers of a base."""

    def __init__(self):
        self.digest = Memo(xxhash.xxh3_128_digest, 500_000)
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASE]

    def grow(self, n: int) -> None:
        if len(self.powers[0][0]) <= n:
            size = max(2 * n, 4096)
            self.powers = []
            for base in _BASE:
                both = []
                for b in (base, pow(base, -1, 2**64)):
                    p = np.full(size, b, np.uint64)
                    p[0] = 1
                    both.append(np.multiply.accumulate(p))
                self.powers.append(tuple(both))

    def words(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.digest.__getitem__, words)), "<u8").reshape(-1, 2)

    def hashes(self, hashed: np.ndarray, length: int, starts: np.ndarray, lanes: int) -> np.ndarray:
        """(len(starts), lanes) hashes of the windows of ``length`` words."""
        self.grow(len(hashed) + 1)
        out = np.empty((len(starts), lanes), np.uint64)
        for k in range(lanes):
            up, down = self.powers[k]
            sums = np.zeros(len(hashed) + 1, np.uint64)
            np.cumsum(hashed[:, k] * up[: len(hashed)], out=sums[1:])
            x = (sums[starts + length] - sums[starts]) * down[starts]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[:, k] = x ^ (x >> np.uint64(32))
        return out


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


_cover = np.zeros(PERIOD, bool)
_cover[list(COVER)] = True


def anchor_starts(n: int) -> np.ndarray:
    """The cover positions of a text of ``n`` words at which an anchor begins."""
    at = np.arange(max(0, n - ANCHOR + 1))
    return at[_cover[at % PERIOD]]


def anchors(windows: Windows, text: str, _):
    words = split(text)
    if len(words) < WINDOW:
        return None
    starts = anchor_starts(len(words))
    return windows.hashes(windows.words(words), ANCHOR, starts, 1), np.arange(len(starts)), len(starts)


def candidates(windows: Windows, text: str, bits: bytes):
    """The windows that hold an anchor that occurs twice, at an offset below PERIOD."""
    words = split(text)
    n = len(words) - WINDOW + 1
    starts = anchor_starts(len(words))
    starts = starts[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(starts)).astype(bool)]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.maximum(starts - PERIOD + 1, 0), 1)
    np.add.at(edge, starts + 1, -1)
    own = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    return (windows.hashes(windows.words(words), WINDOW, own, 2), own, n) if len(own) else None


def runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, the sorted position at which each row's run of equal hashes begins, and the beginnings."""
    order = np.lexsort(hashes.T[::-1]) if hashes.shape[1] > 1 else np.argsort(hashes[:, 0])
    own = hashes[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]).any(1)
    first = np.flatnonzero(fresh)
    return order, np.repeat(first, np.diff(np.r_[first, len(own)])), first


def occurring_twice(rows: DataFrame, find, lanes: int, buckets: int, steady: bool) -> DataFrame:
    """key, bits: for each text of ``rows`` (key, text, bits) which of its slots have a hash that another slot of any row has.

    ``find(windows, text, bits)`` gives the hashes, their slots and the number of slots, or None.
    ``steady``: whether a task that is run again sees its rows in the same order; if not they are sorted
    (rows with equal keys are equal).
    """

    def emit(batches):
        windows, task, number = Windows(), TaskContext.get().partitionId(), 0
        keys, starts, hashes, slots, total, size = [], [], [], [], 0, 0

        def flush():
            chunk = task << 24 | number
            h, i = np.concatenate(hashes), np.concatenate(slots)
            order, begin, first = runs(h)
            count = np.diff(np.r_[first, len(h)])
            own = i[order]
            local = own[count[np.searchsorted(first, begin)] > 1]
            sent, place = h[order[first]], np.where(count > 1, NONE, own[first]).astype("<u4")
            bucket = ((sent[:, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = [*cut[1:].tolist(), len(sent)]
            a = [sent[x:y].tobytes() for x, y in zip(cut.tolist(), ends, strict=True)] + [b"".join(keys)]
            b = [place[x:y].tobytes() for x, y in zip(cut.tolist(), ends, strict=True)] + [np.array([*starts, total], "<u4").tobytes()]
            c = [None] * len(cut) + [local.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([*bucket[cut].astype(np.int64).tolist(), -1 - chunk], pa.int64()), pa.array([chunk] * len(a), pa.int64()), *(pa.array(x, pa.binary()) for x in (a, b, c))], ["bucket", "chunk", "a", "b", "c"])

        for batch in batches:
            for key, text, bits in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                got = find(windows, text, bits)
                if got is None:
                    continue
                if size and (size + len(got[0]) > CHUNK or total + got[2] >= NONE):
                    yield flush()
                    number += 1
                    for x in (keys, starts, hashes, slots):
                        x.clear()
                    total = size = 0
                keys.append(key)
                starts.append(total)
                hashes.append(got[0])
                slots.append(got[1].astype(np.uint32) + np.uint32(total))
                total += got[2]
                size += len(got[0])
        if size:
            yield flush()

    def match(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["chunk", "a", "b", "c"])
        h = [np.frombuffer(x, "<u8").reshape(-1, lanes) for x in table.column("a").to_pylist()]
        place = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("b").to_pylist()])
        source = np.repeat(chunk, [len(x) for x in h])
        order, begin, first = runs(np.concatenate(h))
        place, source = place[order], source[order]
        twice = np.diff(np.r_[first, len(order)]) > 1
        twice |= np.bitwise_or.reduceat(place == NONE, first)
        hit = twice[np.searchsorted(first, begin)] & (place != NONE)
        place, source = place[hit], source[hit]
        by = np.argsort(source, kind="stable")
        place, source = place[by], source[by]
        cut = np.flatnonzero(np.r_[True, source[1:] != source[:-1]][: len(source)])
        blobs = [place[x:y].tobytes() for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(place)], strict=True)] if len(cut) else []
        none = pa.nulls(len(blobs), pa.binary())
        return pa.table([pa.array(source[cut], pa.int64()), none, none, pa.array(blobs, pa.binary())], ["chunk", "a", "b", "c"])

    def bitmaps(table: pa.Table) -> pa.Table:
        keys = starts = None
        places = []
        for a, b, c in zip(*(table.column(x).to_pylist() for x in "abc"), strict=True):
            if a is not None:
                keys, starts = a, np.frombuffer(b, "<u4")
            places.append(np.frombuffer(c, "<u4"))
        hit = np.zeros(int(starts[-1]), bool)
        hit[np.concatenate(places)] = True
        some = [k for k in np.flatnonzero(np.add.reduceat(hit, starts[:-1]) if len(hit) else []).tolist() if starts[k] < starts[k + 1]]
        return pa.table([pa.array([keys[16 * k : 16 * k + 16] for k in some], pa.binary()), pa.array([np.packbits(hit[starts[k] : starts[k + 1]]).tobytes() for k in some], pa.binary())], ["key", "bits"])

    blobs = "chunk long, a binary, b binary, c binary"
    rows = rows.select("key", "text", "bits")
    sent = (rows if steady else rows.sortWithinPartitions("key")).mapInArrow(emit, f"bucket long, {blobs}")
    matched = materialize(sent.groupBy("bucket").applyInArrow(match, blobs))
    maps = matched.groupBy("chunk").applyInArrow(bitmaps, "key binary, bits binary")
    out = materialize(maps.groupBy("key").agg(F.first("bits").alias("bits")))
    discard(matched)
    return out


def few(maps: DataFrame) -> bool:
    """Whether the bitmaps may be broadcast."""
    return (maps.agg(F.sum(F.length("bits") + 48)).first()[0] or 0) <= BROADCAST_BYTES


def with_bits(rows: DataFrame, maps: DataFrame, how: str, small: bool) -> DataFrame:
    """``rows`` joined with their bitmaps, which are broadcast if they are ``small``."""
    return rows.join(F.broadcast(maps) if small else maps, "key", how)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """key, bits: which windows of a text (rows: key, text) start with the same words anywhere else."""
    buckets = max(8, input_bytes(rows) // BUCKET_BYTES)
    steady = in_file_order(rows)
    first = occurring_twice(rows.select("key", "text", F.lit(None).cast("binary").alias("bits")), anchors, 1, buckets, steady)
    small = few(first)
    found = occurring_twice(with_bits(rows, first, "inner", small), candidates, 2, buckets, steady and small)
    discard(first)
    return found


def remaining(text: str | None, bits: bytes | None) -> tuple[int, int, str]:
    """Words, removed words, and the kept words joined by one space."""
    words = split(text)
    removed = 0
    if bits is not None:
        n = len(words) - WINDOW + 1
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))
        edge = np.zeros(len(words) + 1, np.int64)
        edge[at] += 1
        edge[at + WINDOW] -= 1
        keep = np.cumsum(edge)[:-1] == 0
        kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        removed, words = len(words) - len(kept), kept
    return len(words) + removed, removed, b" ".join(words).decode()


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("key"), F.col(text_col).cast("string").alias("text")).where("text is not null")


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row.

    A null text has no words, and a text without a window keeps all.  A row that
    is there twice repeats itself, so each of the two loses its windows.  Null
    ids are like any other; long texts count whole, an empty table gives no rows,
    and other columns than id and text are not read.
    """
    maps = repeated_windows(keyed(df, text_col))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("key"))

    def run(batches):
        for batch in batches:
            out = [remaining(t, b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept"])

    return with_bits(rows, maps, "left", few(maps)).select("doc_id", "text", "bits").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df``, with each text replaced by the words that are kept; null stays null."""
    maps = repeated_windows(keyed(df, text_col))
    names, at = df.columns, df.columns.index(text_col)
    hidden = [f"_{k}" for k in range(len(names))]
    rows = df.toDF(*hidden).withColumn("key", F.unhex(F.md5(F.col(hidden[at]).cast("binary"))))
    joined = with_bits(rows, maps, "left", few(maps)).select(*hidden, "bits")

    def run(batches):
        for batch in batches:
            new = [None if t is None else remaining(t, b)[2] for t, b in zip(batch.column(at).to_pylist(), batch.column(len(hidden)).to_pylist(), strict=True)]
            columns = [*batch.columns[: len(hidden)]]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, df.schema)


def op8_substring(spark, sf_dir) -> DataFrame:
    out = drop_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
