import random
from collections import Counter

import numpy as np
import pytest

from passagework.llm import substring


def brute(texts, n=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


@pytest.mark.parametrize("chunk", [1_500_000, 60])
def test_brute_force(spark, chunk):
    rng = random.Random(3)
    word = lambda: rng.choice("the of a to and in is it on as".split()) if rng.random() < 0.5 else f"w{rng.randrange(4000)}"
    passage = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 80)]
    texts = []
    for _ in range(80):
        t = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            t += rng.choice(passage) + [word() for _ in range(rng.randint(0, 40))]
        texts.append(" ".join(t))
    texts += [texts[5], "x " * 100, "a b c d e " * 12, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    substring.CHUNK = chunk
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.drop_repeats(df).collect()}
    substring.CHUNK = 1_500_000
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_rows_in_another_order(spark):
    """A task that is run again may see a join's rows in another order; they are sorted before their places are numbered."""
    from passagework.llm.common import in_file_order

    rows = spark.createDataFrame([(bytes([k]), f"text {k}") for k in range(9)], "key binary, text string")
    path = substring.materialize(rows)
    assert in_file_order(path.where("key is not null").select("key"))
    assert not in_file_order(path.join(rows, "key")) and not in_file_order(path.repartition(3)) and not in_file_order(path.orderBy("key"))


@pytest.mark.parametrize("broadcast", [0, 24 << 20])
def test_maps_joined_or_broadcast(spark, broadcast, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", broadcast)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"{passage} own {k}" if k % 3 else " ".join(f"w{k}x{j}" for j in range(90)) for k in range(40)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_odd_rows(odd, none):
    rows = odd.collect()
    got = substring.drop_repeats(odd).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(brute([r["text"] for r in rows]))
    out = substring.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(rows) and out.where("text is null").count() == 1
    assert substring.drop_repeats(none).count() == 0 and substring.without_repeats(none).count() == 0


def test_window_hashes():
    windows = substring.Windows()
    words = [b"a", b"b", b"c", b"a", b"b", b"c", b"a"]
    h = windows.hashes(windows.words(words), 3, np.arange(5), 2)
    assert (h[0] == h[3]).all() and (h[1] == h[4]).all() and len({tuple(x) for x in h.tolist()}) == 3
