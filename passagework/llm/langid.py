"""Language by compression: the smallest zstandard encoding wins.

For every learned language a raw-content dictionary is made from a bounded
sample of its documents.  Lower-cased, a text is cut into blocks, every block is compressed
with every dictionary, and the language with the smallest sum is predicted.
Where the runner-up is nearly as small the prediction is not ``accepted``.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, bucket_of, discard, documents, hash_sample, id_and_text, materialize

#: The bounds of what is learned, for each language: documents, their characters, and bytes of the dictionary.  Every language is learned.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 300, 2_000_000, 64 << 10
#: Bytes that are compressed at once, so that a dictionary helps in all of a long text.
BLOCK, LEVEL = 1024, 6
#: Share of the smallest size by which the runner-up must be larger for a prediction to be accepted.
MARGIN = 0.02
LETTER = regex.compile(r"\p{L}")


def learn(df: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary bytes of each language, from the rows where ``train`` holds and the language is not null.

    The sample of a language is the rows with the smallest hash of the id, found
    without reading a text.  Dictionaries are made on the executors, a language in
    one task: of each half of the sample first; what the other half's
    dictionaries take for another language is left out of the final one (unless
    that leaves nothing).  Equal lines count once.  The driver gets
    DICTIONARY_BYTES at most for each language and half.
    """
    rows = df.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sample = materialize(hash_sample(rows.where("id is not null"), "lang", "id", SAMPLE_DOCS))
    texts = materialize(bounded_texts(rows.where(F.col("text").rlike(r"\p{L}")), sample, ["lang", "id"], "lang", SAMPLE_CHARS).withColumn("half", (F.crc32(F.col("id").cast("string").cast("binary")) % 2).cast("int")))
    found: list[dict[str, bytes]] = [{}, {}]
    for r in texts.groupBy("lang", "half").applyInArrow(_contents, "lang string, half int, content binary").collect():
        found[r["half"]][r["lang"]] = bytes(r["content"])

    def judge(batches):
        models = [Classifier(x) for x in found[::-1]]  # each half by the other's
        for batch in batches:
            langs, halves, own = (batch.column(k).to_pylist() for k in range(3))
            clean = [int(models[half].predict(t)[0] == lang) for lang, half, t in zip(langs, halves, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.int32()), batch.column(2)], ["lang", "half", "text"])

    judged = texts.select("lang", "half", "text").mapInArrow(judge, "lang string, half int, text string")  # half: 1 where the text is clean
    final: dict[str, bytes] = {}
    for r in sorted(judged.groupBy("lang", "half").applyInArrow(_contents, "lang string, half int, content binary").collect(), key=lambda r: r["half"]):
        final[r["lang"]] = bytes(r["content"])  # the clean one replaces the other
    discard(sample, texts)
    return final


def _contents(table: pa.Table) -> pa.Table:
    return pa.table([table.column("lang")[:1], table.column("half")[:1], pa.array([content(table.column("text").to_pylist())], pa.binary())], ["lang", "half", "content"])


def content(texts: list[str]) -> bytes:
    """DICTIONARY_BYTES of the distinct lines of all the texts, in the order of their checksums."""
    lines = {x for t in texts for x in t.lower().split("\n") if x.strip()}
    chosen, size = [], 0
    for x in sorted((x.encode() for x in lines), key=lambda x: (zlib.crc32(x), x)):
        if size >= DICTIONARY_BYTES:
            break
        chosen.append(x)
        size += len(x) + 1
    return b"\n".join(chosen)[:DICTIONARY_BYTES]


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages, self.compressors = sorted(dictionaries), []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[lang].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the text with each dictionary; all of the text is compressed."""
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1, accepted."""
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0, False
        sizes = self.sizes(text)
        best = min(sizes)
        score = 1 / sum(math.exp(max(-700.0, (best - s) / 2)) for s in sizes)
        rest = sorted(sizes)[1:2]
        return self.languages[sizes.index(best)], score, not rest or rest[0] - best > MARGIN * best


def classify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted.  No shuffle.

    ``und`` with score 0 for a text that is null or has no letter, and for every
    text if no language was learned.  Equal sizes go to the language that sorts
    first, and are not accepted.  Repeated rows and null ids are kept; long texts
    are compressed whole; other columns than id and text are not read, and an
    empty table gives no rows.
    """

    def run(batches):
        model = Classifier(dictionaries)
        for batch in batches:
            rows = [model.predict(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True))], ["doc_id", "lang_pred", "score", "accepted"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op10_langid(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = classify(docs, learn(docs, bucket_of("doc_id", 4) != 2))
    return out.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
