"""Near-duplicate documents by min-max hashing.

A document's set is its distinct two-word shingles (ASCII lower-cased).  Under
each permutation both the minimum and the maximum of the set are kept, so one
hash evaluation gives two signature values; groups of them are band keys.

1. Equal sets are one class, represented by its smallest doc_id; only
   representatives take part from here on.
2. Representatives that share a band key form a bucket.  The first pass compares
   each member only with the smallest one of its bucket.
3. Every candidate link is confirmed on the full sets; confirmed links give
   components.  The texts of one doc_id are linked too.
4. Members of a bucket that are not in its largest component are compared with a
   few members of that, chosen at random per bucket.
5. What is in different components of a bucket even then is compared with all
   members, in blocks of bounded size: an inverted index of a block's full sets
   gives the exact size of every intersection at once.

A candidate is a pair that shares a band key, and none that would join two
components is left unconfirmed; but a group of n copies costs about n
comparisons and not n squared.  Sets travel as the 64-bit hashes of their
shingles, made once per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, discard, documents, id_and_text, materialize

#: Permutations (each gives two values), bands and rows: a pair of similarity 0.8 shares no band with probability 3e-6.
PERMUTATIONS, BANDS, ROWS = 80, 32, 5
#: Links have at least so many hundredths in common.
SIMILAR = 80
#: Ids of at most so many rows are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket's largest component with which the others are compared.
CENTERS = 4
#: Members, and shingles of members, in one block; and members that meet one copy of a star's center.
BLOCK, BLOCK_SHINGLES, STAR = 2048, 1 << 20, 1024
#: Sets below so many shingles are similar to no other set: their neighbours have 3 of 4 in common at most.
LEAST_SHINGLES = 4

_rng = np.random.Generator(np.random.PCG64(20240607))
_A = (_rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)[:, None]
_ROW = (_rng.integers(0, 1 << 63, ROWS, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)
_LEFT, _RIGHT, _ALONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers without structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self):
        self.hash = Memo(xxhash.xxh64_intdigest, 600_000)

    def set(self, text: str | None) -> np.ndarray:
        """The sorted 64-bit hashes of the distinct shingles; one for a text of one word, none without words."""
        words = (text or "").encode().lower().split()
        h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        if len(h) < 2:
            return mixed(h * _ALONE)
        return np.unique(mixed(h[:-1] * _LEFT + mixed(h[1:] * _RIGHT)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minima or maxima."""
    least, most = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(shingles), 2048):
        permuted = _A * shingles[None, k : k + 2048] + _B
        np.minimum(least, permuted.min(1), out=least)
        np.maximum(most, permuted.max(1), out=most)
    signature = mixed(np.concatenate([least, most])[: BANDS * ROWS]).reshape(ROWS, BANDS)
    return mixed((signature * _ROW).sum(0, dtype=np.uint64) + _BAND).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < SIMILAR * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SIMILAR * (small + large - common)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (of equal sets; null for the empty set) and bands (null for sets that only equal ones are similar to)."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler.set(text)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(s) if len(s) >= LEAST_SHINGLES else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """node, set: the packed hashes of the shingles of each row of ``texts`` (node, text)."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler.set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set binary")


def few_or_all(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it has few rows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar.  ``sets``: node, set.

    The set of a node that is the first of many pairs is copied, so that at most
    about STAR pairs meet each copy.
    """

    def run(batches):
        for batch in batches:
            sa, sb = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            good = [similar(x, y) for x, y in zip(sa, sb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    hot = few_or_all(materialize(pairs.groupBy("a").count().where(F.col("count") > STAR).select("a", F.ceil(F.col("count") / STAR).cast("int").alias("copies"))))
    salted = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "copies"), F.lit(0)).cast("int").alias("copy"))
    first = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")).join(hot, "a", "left").select("a", "sa", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    both = salted.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(first, ["a", "copy"])
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that is reachable by ``links`` (a, b), for the nodes that have links.

    Labels move along links and then jump to their label's label, until none changes.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")))
    labels = old = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = materialize(moved.join(jump, "label", "left").select("node", "was", F.least("label", "next").alias("label")))
        changed = moved.where("label <> was").limit(1).count()
        discard(old)
        old, labels = moved, moved.select("node", "label")
        if not changed:
            discard(edges)
            labels._passagework_path = old._passagework_path
            return labels


def compared(rows: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between a bucket's components.  ``rows``: key, node, label, main, homes, visits.

    The members outside the main component visit all members, both in blocks
    (``visits`` and ``homes`` of them in the bucket); a task has one block of each.
    For each visitor and component one link is returned, if there is any.  A pair
    that shares several buckets is compared in that of its first band.
    """
    block = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    columns = ["key", "i", "j", "home", "node", "label", "main"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    visiting = rows.where("label <> main").withColumns({"i": block(11, "visits"), "home": F.lit(False)}).withColumn("j", every("homes")).select(columns)
    home = rows.withColumns({"j": block(12, "homes"), "home": F.lit(True)}).withColumn("i", every("visits")).select(columns)
    dealt = visiting.unionByName(home).join(classes.where("bands is not null").select("node", "bands"), "node").join(sets.where(F.length("set") >= 8 * LEAST_SHINGLES), "node")

    def compare(table: pa.Table) -> pa.Table:
        node, label, main, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "main", "home"))
        key, bands = table.column("key")[0].as_py(), table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        own = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        there = np.flatnonzero(home)
        sizes = np.array([len(own[x]) for x in there.tolist()], np.int64)
        values = np.concatenate([own[x] for x in there.tolist()]) if len(there) else np.zeros(0, np.uint64)
        order = np.argsort(values)
        values, holder = values[order], np.repeat(np.arange(len(there)), sizes)[order]
        a, b = [], []
        for k in np.flatnonzero(~home).tolist():
            low, high = np.searchsorted(values, own[k], "left"), np.searchsorted(values, own[k], "right")
            times = high - low
            total = int(times.sum())
            if not total:
                continue
            at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(total)
            common = np.bincount(holder[at], minlength=len(there))
            x = there[100 * common >= SIMILAR * (sizes + len(own[k]) - common)]
            x = x[(label[x] != label[k]) & ((label[x] == main[x]) | (node[x] > node[k]))]
            x = x[bands[k][(bands[x] == bands[k]).argmax(1)] == key] if len(x) else x
            for y in np.unique(label[x], return_index=True)[1].tolist():
                a.append(int(node[k]))
                b.append(int(node[x[y]]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of the texts of one doc_id."""
    several = materialize(signed.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("doc_id"))
    own = signed.join(few_or_all(several), "doc_id", "left_semi").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node").distinct()
    return own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Texts without words are linked with nothing (but an id that has other texts is
    linked through those).  A row with a null id takes no
    part in linking: its component_id is null and it is kept.  Rows that repeat a
    doc_id count as one document, linked through each of its texts, and are all
    returned, with the same component_id.  Ties don't arise: a component is named
    by its smallest doc_id.  Long texts count whole; an empty table gives no rows;
    other columns than id and text are not read.
    """
    table = id_and_text(df, id_col, text_col)
    signed = materialize(signatures(df, id_col, text_col))
    there = signed.where("doc_id is not null and set_key is not null")
    classes = materialize(there.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    entries = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last"), F.count("*").alias("size")).where("center <> last").select("key", "center", "size")
    members = materialize(entries.join(shared, "key"))
    nodes = few_or_all(members.select("node").distinct())
    sets = materialize(full_sets(table.join(nodes, table.doc_id == nodes.node, "left_semi").select(F.col("doc_id").alias("node"), "text")))

    links = labels = None
    written: list[DataFrame] = []

    def joined_by(more: DataFrame) -> None:
        """Bring the components up to date."""
        nonlocal links, labels
        more = materialize(more)
        written.append(more)
        if links is None or not more.isEmpty():
            links = more if links is None else links.union(more)
            before, labels = labels, components(links)
            discard(before)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels.select("node", F.col("label").alias("found")), "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found")

    stars = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    joined_by(confirmed(stars, sets).unionByName(same_document(there, classes)))
    chosen = [F.min_by("node", F.xxhash64("node", "key", F.lit(k))).alias(f"c{k}") for k in range(CENTERS)]
    for last in (False, True):
        open_ = labelled(members.where("size > 2").select("key", "node", "n", "size"))
        shares = open_.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), *chosen)
        largest = F.max_by(F.struct("label", "rows", "shingles", F.array(*[f"c{k}" for k in range(CENTERS)]).alias("centers")), F.struct("rows", "label"))
        main = shares.groupBy("key").agg(largest.alias("m"), F.count("*").alias("parts"), F.sum("shingles").alias("shingles")).where("parts > 1")
        rows = materialize(open_.join(main.select("key", "m", "shingles"), "key").select("key", "node", "label", "size", "shingles", F.col("m.label").alias("main"), F.col("m.rows").alias("inside"), F.col("m.shingles").alias("within"), "m.centers"))
        written.append(rows)
        if rows.isEmpty():
            break
        if last:
            blocks = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")
            joined_by(compared(rows.withColumns({"homes": blocks(F.col("size"), F.col("shingles")), "visits": blocks(F.col("size") - F.col("inside"), F.col("shingles") - F.col("within"))}), classes, sets))
        else:
            random = rows.where("label <> main").select(F.col("node").alias("a"), F.explode(F.array_distinct("centers")).alias("b"))
            pairs = random.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            joined_by(confirmed(pairs.join(stars, ["a", "b"], "left_anti"), sets))
    discard(members, sets, *written)

    found = labelled(classes.select("set_key", "node")).select("set_key", "label")
    # a doc_id with texts and empty ones: its empty rows are in the component of its texts
    blank = few_or_all(signed.where("doc_id is not null and set_key is null").select("doc_id").distinct())
    of_blank = few_or_all(materialize(there.select("doc_id", "set_key").join(blank, "doc_id", "left_semi").join(found, "set_key").groupBy("doc_id").agg(F.min("label").alias("other"))))
    out = signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left").join(of_blank, "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "other", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_minhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
