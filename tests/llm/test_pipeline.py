import os
import random
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from passagework.llm import quality, toxicity

from .test_minhash import brute as components
from .test_substring import brute as passages

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A corpus with toxic, repetitive, copied and clean documents, and one repeated passage."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 6)))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    docs, labels = [], []
    for i in range(260):
        kind = ("clean", "toxic", "repeats", "copy", "passage")[i % 5] if i % 3 else "clean"
        t = text(rng.randint(60, 200))
        if kind == "toxic":
            parts = t.split()
            for _ in range(6):
                parts.insert(rng.randrange(len(parts)), rng.choice(["zzurk", "xxogg", "wwipp"]))
            t = " ".join(parts)
        elif kind == "repeats":
            t = text(12) + "\n" + (text(10) + "\n") * 9
        elif kind == "copy" and docs:
            t = docs[rng.randrange(len(docs))][1] + " end"
        elif kind == "passage":
            t = f"{t} {passage} {text(20)}"
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(kind == "toxic")))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_brute_force(spark, small):
    folder, docs = small
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet"), toxicity.training())
    scorer = toxicity.Scorer(*toxicity.unpacked(model[0]), model[1])
    left = [(d, t) for d, t, *_ in docs if scorer.score(t) < toxicity.THRESHOLD]
    assert 0 < len(left) < len(docs)
    good = [(d, t) for (d, t), m in zip(left, quality.measure([t for _, t in left]), strict=True) if m[-1]]
    assert len(good) < len(left)
    of = components(good)
    single = [(d, t) for d, t in good if of[d] == d]
    assert len(single) < len(good)
    kept = passages([t for _, t in single])
    assert any(n for _, n, _ in kept)
    rows, frame = {}, table
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        if name != "packing":
            assert frame.columns == table.columns
        rows[name] = frame
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in rows["passages"].collect()} == {(d, t, len(t)) for (d, _), (_, _, t) in zip(single, kept, strict=True)}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == {d for d, _ in single}
    load = Counter()
    for r in out:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 2048


def test_empty(spark, small, tmp_path):
    folder, _ = small
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()])
def test_queries_run(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    assert got.count() > 0


def test_one_row_of_each(spark):
    """Repeated rows, null ids and a doc_id with two texts are decided row by row, and what stays keeps its text."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(1, a), (1, a), (2, b), (None, c), (None, c), (5, b), (5, d), (7, e), (6, e + " end"), (None, f), (8, f), (9, None), (9, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter([(1, a), (2, b), (None, c), (5, d), (6, e + " end"), (8, f), (9, None), (9, None), (None, ""), (None, "")])
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.own_passages(spark, kept, "").collect()) == want


def test_stages_with_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows and columns with the operators' names: each stage has a defined result and keeps the columns."""
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    good = [text(40) for _ in range(24)]
    rows = [(i, t) for i, t in enumerate(good)] + [(None, text(40)), (90, None), (91, ""), (92, "zzurk " + text(30)), (93, text(9000)), (94, "same line again and again it goes here\n" * 30), (95, good[0]), (3, good[3])]
    rows += [(100 + i, text(30) + " zzurk wwipp") for i in range(12)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, label int"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", 0.5, 7) for i, t in rows], columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i is not None and 100 <= i)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.materialize(stage(spark, frame, str(tmp_path)))
        assert frame.columns == docs.columns
        left[name] = Counter((r["doc_id"], r["text"]) for r in frame.collect())
    assert (90, None) in left["toxicity"] and (91, "") in left["toxicity"] and not any(i is not None and i >= 92 and "zzurk" in (t or "") for i, t in left["toxicity"])
    ids = Counter(i for i, _ in left["quality"].elements())
    assert not {90, 91, 94} & set(ids) and ids[3] == 2 and ids[None] == 1 and ids[93] == 1
    assert Counter(i for i, _ in left["near_duplicates"].elements()) == Counter([*range(24), None, 93])
    assert left["passages"] == left["near_duplicates"]
    pieces = corpus_pipeline.packed(spark, frame, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {*range(24), None, 93} and sum(r["piece"] > 0 for r in pieces if r["doc_id"] == 93) > 0
