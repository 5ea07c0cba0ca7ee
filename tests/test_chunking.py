import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.operators import chunking as C

ARTICLE = 'The U.S. team met Dr. Lee. "It was late!" he said.\n\nJ. Smith left. Was it? Yes, it was. a lower start.\n\nLast one'


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_fixed(spark):
    rows = C.fixed(frame(spark, "one two three four five six seven", "", None, "  \n "), 3).orderBy("start_char").collect()
    assert [(r["start_char"], r["end_char"]) for r in rows] == [(0, 13), (13, 27), (27, 33)]
    assert [r["chunk_id"] for r in rows] == ["0:0000", "0:0001", "0:0002"]
    over = C.fixed(frame(spark, "a b c d e"), 3, 1).orderBy("start_char").collect()
    assert [r["text"] for r in over] == ["a b c", " c d e"]
    with pytest.raises(ValueError):
        C.fixed(frame(spark, "a"), 3, 3)


def test_lines(spark):
    rows = C.lines(frame(spark, "\n one\n\n \ntwo\nthree  ")).orderBy("start_char").collect()
    assert [r["text"] for r in rows] == ["\n one\n\n \n", "two\n", "three  "]


def test_sentences():
    scan, whole = C.Scan(ARTICLE), (0, len(ARTICLE))
    spans = scan.divided(whole, scan.cuts(C.SENTENCE_END))
    assert [ARTICLE[a:b].strip() for a, b in spans] == ["The U.S. team met Dr. Lee.", '"It was late!"', "he said.", "J. Smith left.", "Was it?", "Yes, it was. a lower start.", "Last one"]
    assert len(scan.divided(whole, scan.cuts(C.PARAGRAPH))) == 3
    assert C.Scan(" \n ").divided((0, 3), [2]) == [(0, 3)] and C.Scan("").packed((0, 0), 3, 0, C.LEVELS["recursive"]) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!?\n\t'\"J", max_size=120), st.integers(1, 7), st.sampled_from(sorted(C.LEVELS)))
def test_tiling(text, size, kind):
    """Spans begin where the text begins, each where the one before ended, and end at the end; none is over the size."""
    scan = C.Scan(text)
    spans = scan.packed((0, len(text)), size, 0, C.LEVELS[kind])
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(scan.count(s) <= size and (scan.visible(s) or len(spans) == 1) for s in spans)


def test_long_texts(spark):
    """Ten million characters in one text take seconds, as the time grows with the length and not with its square."""
    import time

    text = "word and\n" * 1_100_000
    began = time.time()
    docs = frame(spark, text)
    assert C.lines(docs).agg({"end_char": "max"}).first()[0] == len(text)
    assert C.fixed(docs, 128, 32).count() == 22917
    assert C.structure_chunks(docs, "recursive", 128).count() == 17188
    assert time.time() - began < 60


def test_text_of_spans(spark):
    docs = spark.createDataFrame([("a", "één two 😀 three"), ("b", "x"), ("c", None)], "doc_id string, text string")
    spans = C.fixed(docs, 2).drop("text")
    for few in (10, 0):
        assert {(r["doc_id"], r["start_char"]): r["text"] for r in C.with_text(spans, docs, few).collect()} == {("a", 0): "één two", ("a", 7): " 😀 three", ("b", 0): "x"}


TWO = "One two. Three four five.\n\nSix seven eight nine.\nTen."


def test_spans_by_hand(spark):
    """Every kind of splitter on a text whose spans are plain to see."""
    docs = frame(spark, TWO)
    spans = lambda rows: [(r["start_char"], r["end_char"]) for r in rows.orderBy("start_char", "chunk_id").collect()]
    small, large = [(0, 9), (9, 27), (27, 49), (49, 53)], [(0, 27), (27, 53)]
    for kind in ("recursive", "paragraph", "sentence"):
        assert spans(C.structure_chunks(docs, kind, 4)) == small and spans(C.structure_chunks(docs, kind, 5)) == large
    assert spans(C.structure_chunks(docs, "sentence", 5, 3)) == [(0, 27), (27, 53)]  # the tail of three words leaves no room for four
    assert spans(C.structure_chunks(docs, "sentence", 7, 3)) == [(0, 27), (9, 49), (49, 53)]
    assert spans(C.structure_chunks(docs, "recursive", 2)) == [(0, 9), (9, 20), (20, 27), (27, 37), (37, 49), (49, 53)]
    rows = C.parent_child(docs, 5, 3).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["start_char"], r["end_char"], r["child_start"], r["child_end"]) for r in rows] == [("0:0000:00", 0, 27, 0, 9), ("0:0000:01", 0, 27, 9, 27), ("0:0001:00", 27, 53, 27, 43), ("0:0001:01", 27, 53, 43, 49), ("0:0001:02", 27, 53, 49, 53)]


def test_pack():
    pieces = [(i, i + 1) for i in range(6)]
    assert C.pack(pieces, [2, 2, 2, 2, 2, 2], 4) == [(0, 2), (2, 4), (4, 6)]
    assert C.pack(pieces, [2, 2, 2, 2, 2, 2], 6, 2) == [(0, 3), (2, 5), (4, 6)]
    assert C.pack(pieces, [9, 1, 1, 1, 1, 9], 4) == [(0, 1), (1, 5), (5, 6)]


def test_parents_and_kinds(spark):
    docs = frame(spark, ARTICLE, None)
    rows = C.parent_child(docs, 12, 5).collect()
    for r in rows:
        assert ARTICLE[r["child_start"] : r["child_end"]] == r["embed_text"] and r["start_char"] <= r["child_start"] and r["child_end"] <= r["end_char"]
        assert r["chunk_id"].startswith(r["parent_id"] + ":") and r["text"] == ARTICLE[r["start_char"] : r["end_char"]]
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    for made in (C.structure_chunks(docs, "sentence", 6), C.semantic(docs, max_size=6)):
        got = made.orderBy("start_char").collect()
        assert "".join(r["text"] for r in got) == ARTICLE
    assert C.breakpoints(C.hashed_vectors(["a b", "a b", "c", "c"]), 50) == [1]
