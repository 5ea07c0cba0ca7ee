import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import langid, toxicity
from passagework.llm.common import bucket_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_buckets(spark):
    rows = spark.range(50).select("id", bucket_of("id", 10).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 10 for r in rows)


def gram_counts(words):
    """names, ordinary, toxic of a table word -> (ordinary, toxic)."""
    own = {}
    for w, both in words.items():
        for g in toxicity.grams(w):
            for k in (0, 1):
                own.setdefault(g, [0, 0])[k] += both[k]
    return list(own), [n[0] for n in own.values()], [n[1] for n in own.values()]


def test_kneser_ney_ratios():
    counts = {"good": (50, 48), "fine": (40, 41), "vile": (0, 30), "vilely": (0, 5), "rare": (1, 0)}
    scorer = toxicity.Scorer(*toxicity.log_ratios(*gram_counts(counts)), None)
    of = lambda w: scorer.of_token(w) * (len(w) + 1)
    assert of("vile") > 2 and of("viler") > 1
    assert abs(of("good")) < 0.5 and abs(of("xyzzy")) < 1
    assert scorer.evidence("good (Vile) fine") == scorer.of_token("vile") and scorer.evidence(" ... ") == 0.0


def slow_model(words, k):
    """P(x | h) of class ``k`` by its definition, with tables made anew at each call."""
    grams = [(g, both[k]) for w, both in words.items() for g in toxicity.grams(w)]
    types = {g for w, both in words.items() if sum(both) for g in toxicity.grams(w)}
    alphabet = {g[-1] for g in types}

    def lower(h, x, order):
        """Kneser-Ney of the continuation counts at ``order`` characters, shared by the classes."""
        if order == 0:
            return 1 / (len(alphabet) + 1)
        level = list(types)
        for _ in range(toxicity.ORDER - order):
            level = [g[1:] for g in dict.fromkeys(level) if len(g) > 1]
        follows = [g for g in level if g[:-1] == h]
        rest = lower(h[1:], x, order - 1) if h else 1 / (len(alphabet) + 1)
        if not follows:
            return rest
        return (max(follows.count(h + x) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(set(follows)) * rest) / len(follows)

    def p(h, x):
        own = Counter()
        for g, n in grams:
            if g[:-1] == h and n:
                own[g[-1]] += n
        rest = lower(h[1:], x, toxicity.ORDER - 1)
        if not own:
            return rest
        return (max(own[x] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(own) * rest) / sum(own.values())

    return p, alphabet


def test_against_the_formula():
    """The tables' log ratios are those of the two models as they are defined, for seen and unseen words, and both are distributions."""
    words = {"ab": (3, 1), "ac": (2, 0), "abc": (1, 4), "abcdefgh": (2, 5), "bcdefghi": (1, 0), "vile": (0, 7)}
    scorer = toxicity.Scorer(*toxicity.log_ratios(*gram_counts(words)), None)
    (ordinary, alphabet), (toxic, _) = slow_model(words, 0), slow_model(words, 1)
    for w in [*words, "abd", "vil", "zz", "cdefghab", "a"]:
        want = sum(math.log(toxic(g[:-1], g[-1])) - math.log(ordinary(g[:-1], g[-1])) for g in toxicity.grams(w))
        assert math.isclose(scorer.of_token(w), want / (len(w) + 1), rel_tol=1e-9, abs_tol=1e-9)
    for p in (ordinary, toxic):
        for h in ("\x02", "\x02a", "bcdef", "\x02v", "qq"):
            assert math.isclose(sum(p(h, x) for x in [*alphabet, "other"]), 1, rel_tol=1e-9)


@tables
def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, toxicity.training()))
    rows = scored.join(labels, "doc_id").where(bucket_of("doc_id", 3) == 1).select("toxic", "score", "predicted").collect()
    wrong = sum((r["predicted"] == 1) != (r["toxic"] == 1) for r in rows)
    assert len(rows) > 100 and wrong <= 0.05 * len(rows)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(rows)
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(toxic) >= 0.7 * len(toxic)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_odd(odd, none, spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, None), (5, 0, 7), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels, F.lit(True))).count() == 0
    assert toxicity.drop_toxic(odd, (toxicity.packed(({}, {})), [-9.0, 0.0, math.inf])).columns == odd.columns


def test_wrong_labels_do_not_flatten_the_calibration():
    """Three of 26 telling documents are labelled wrongly, two of them the most telling ones of all."""
    x = np.array([0.2] * 100 + [0.5] * 40 + [0.7] * 23 + [0.7, 1.5, 1.5])
    y = np.array([0.0] * 140 + [1.0] * 23 + [0.0] * 3)
    w0, w1, bound = toxicity.calibrated(x, y)
    score = lambda e: 1 / (1 + math.exp(-(w0 + w1 * min(e, bound))))
    assert bound < 1.5 and score(0.7) > toxicity.THRESHOLD and score(0.5) < 0.1 and score(9.0) >= score(0.7)
    w0, w1, bound = toxicity.calibrated(np.array([0.1] * 50 + [0.9] * 50), np.array([0.0] * 50 + [1.0] * 50))
    assert w1 > 5 and math.isfinite(w0)


def test_the_sample_is_bounded(spark, monkeypatch):
    """A row that is repeated many times counts once, and a text beyond the bound of characters is passed over."""
    docs = spark.createDataFrame([(1, "vile " * 3)] * 500 + [(2, "good words"), (3, "long " * 50), (4, "fine words"), (5, "kind")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 30)
    rows = sorted((r["label"], r["id"]) for r in toxicity.labelled(docs, labels, F.lit(True)).collect())
    assert rows == [(0, 2), (0, 4), (0, 5), (1, 1)]
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 2)
    assert toxicity.labelled(docs, labels, F.lit(True)).where("label = 0").count() <= 2


@tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.classify(docs, langid.learn(docs, bucket_of("doc_id", 4) != 2))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where(bucket_of("doc_id", 4) == 2).select("lang", "lang_pred", "accepted").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.94 * len(rows)
    sure = [r for r in rows if r["accepted"]]
    assert len(sure) > 0.8 * len(rows)


def test_against_plain_compression(odd):
    """The prediction is the language whose dictionary compresses the text's blocks to the fewest bytes."""
    import zstandard

    samples = {"q": "the cat sat on the mat", "r": "der hund lag auf dem boden", "s": "el gato duerme en la casa"}
    dictionaries = {k: langid.content([v, v.upper()]) for k, v in samples.items()}
    texts = [*samples.values(), "the dog lay on der mat", "x", "Auf dem Boden " * 300, "123", "", None, "ab\0c\n"]
    model = langid.Classifier(dictionaries)
    for text in texts:
        data = (text or "").lower().encode()
        sizes = {}
        for lang, raw in sorted(dictionaries.items()):
            sizes[lang] = 0
            for i in range(0, len(data), langid.BLOCK):
                own = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[lang] += len(own.compress(data[i : i + langid.BLOCK]))
        lang, score, accepted = model.predict(text)
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score, accepted) == ("und", 0.0, False)
            continue
        best, second = sorted(sizes.values())[:2]
        assert lang == min(sizes, key=lambda k: (sizes[k], k)) and 0 <= score <= 1
        assert accepted == (second - best > langid.MARGIN * best)
    tied = langid.Classifier({"b": b"same", "a": b"same"})
    assert tied.predict("text")[0] == "a" and not tied.predict("text")[2]


def test_seventy_languages(spark):
    """None is left out, however many there are and however rare."""
    rows = []
    for k in range(70):
        word = lambda n, k=k: "".join(chr(0x4E00 + 40 * k + (7 * n + 3 * j) % 40) for j in range(6))
        rows += [(200 * k + i, f"l{k:02d}", " ".join(word(i + j) for j in range(12))) for i in range(3 if k else 150)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learned = langid.learn(docs, F.lit(True))
    assert len(learned) == 70
    found = langid.classify(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] for r in found)


def test_language_odd(odd, none):
    known = odd.withColumn("lang", F.when(F.col("doc_id") > 5, F.lit("q")))
    got = langid.classify(odd, langid.learn(known, F.lit(True))).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got} <= {"q", "und"}
    assert sum(r["lang_pred"] == "und" for r in got) == 3
    assert {r["lang_pred"] for r in langid.classify(odd, langid.learn(known.limit(0), F.lit(True))).collect()} == {"und"}
    assert langid.classify(none, {"q": b"text"}).count() == 0
