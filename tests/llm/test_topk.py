import numpy as np

from passagework.llm import topk


def brute(rows, k, every):
    v = {i: np.floor(np.array(x, np.float32).astype(float) * 256) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    out = set()
    for q in v:
        if q % every == 0:
            best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_brute_force(spark):
    rng = np.random.default_rng(5)
    scale = rng.choice([0.1, 1.0, 8.0], 600)
    rows = [(i, (rng.normal(size=6) * s).tolist()) for i, s in enumerate(scale)]
    rows += [(i, rows[7][1]) for i in range(600, 660)]  # one common vector
    rows += [(700, [0.0] * 6), (701, None), (702, [1.0, None] + [0.0] * 4), (703, [float("nan")] * 6), (704, [float("inf")] * 6), (None, [1.0] * 6), (710, [1.0, 2.0]), (720, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    before = topk.BUCKET, topk.QUERIES, topk.RANGE, topk.QUERY_BYTES
    for size in (before, (50, 7, 100, 64 << 20), (50, 7, 100, 900)):  # the last: queries travel in several batches
        topk.BUCKET, topk.QUERIES, topk.RANGE, topk.QUERY_BYTES = size
        got = [tuple(r) for r in topk.top_products(df, 5, 10).collect()]
        assert set(got) == brute(rows, 5, 10) and len(got) == len(set(got))
    topk.BUCKET, topk.QUERIES, topk.RANGE, topk.QUERY_BYTES = before
    assert topk.top_products(df.limit(0)).count() == 0


def test_few_and_large(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 0.0]), (2, [-3.0, 0.5])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).collect()}
    assert got.keys() == {(0, 1), (0, 2)} and got[(0, 1)] == 2**63 - 1


def test_pruning_keeps_ties():
    v = np.array([[3, 4], [4, 3], [5, 0], [0, 5], [-5, 0]], float)
    bucket = topk.Bucket(np.arange(5, dtype=np.int64).tobytes(), v.tobytes(), 2)
    ids, score = bucket.search(9, np.array([1.0, 0.0]), 4.0, 3)
    assert ids.tolist() == [2, 1] and score.tolist() == [5, 4]
