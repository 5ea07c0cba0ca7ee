import random

import numpy as np
import pytest

from passagework.llm import minhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w}


def brute(rows):
    """component of each doc_id, by all pairs."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return {d: root(d) for d in parent}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for size, edits in ((120, 9), (40, 3), (3, 1), (2, 0), (60, 14)):
        base = [word() for _ in range(rng.choice([30, 90]))]
        for _ in range(size):
            own = base[:]
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n + i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2048, 9])
def test_brute_force(spark, corpus, block):
    minhash.BLOCK = block
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    minhash.BLOCK = 2048
    want = brute(corpus)
    texts = dict(corpus)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(texts[d])) and r["kept"] == (want[d] == d) for d, r in got.items())


def test_band_keys_of_similar_sets():
    """Pairs of similarity 0.8 share a third of the band keys, unrelated ones none."""
    rng = np.random.default_rng(1)
    shared = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**63, n, np.uint64) for n in (400, 50, 50))
        x, y = (minhash.band_keys(np.unique(np.r_[common, z])) for z in (a, b))
        shared.append((x == y).mean())
        assert not (minhash.band_keys(np.unique(a)) == minhash.band_keys(np.unique(b))).any()
    assert min(shared) > 0 and abs(np.mean(shared) - 0.8**5) < 0.08


def test_a_repeated_id_is_one_document(spark):
    """Its texts may have different links; all its rows are in one component."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (7, c), (8, c), (8, None), (6, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (6, 6, True), (7, 7, True), (8, 7, False), (8, 7, False), (9, 3, False)]


def test_repeated_ids_against_brute_force(spark, corpus):
    rng = random.Random(3)
    rows = [(d if rng.random() < 0.9 else rng.choice(corpus)[0], t) for d, t in corpus]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in got)


def test_stars_are_split(spark, corpus):
    star, minhash.STAR = minhash.STAR, 4
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    minhash.STAR = star
    assert got == brute(corpus)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
    assert minhash.near_duplicates(none).count() == 0
