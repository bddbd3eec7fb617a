"""Top-k search against numpy: ties, large numbers, odd vectors, several dimensions."""

import numpy as np

from logrill.llm.topk import integer_vectors, top_k


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 6)]) for i in range(400)]  # few values: many ties
    rows += [(1000 + i, [1, 2, 3, 1, 2, 3]) for i in range(60)]
    rows += [(2000 + i, [int(x) for x in rng.integers(-10**9, 10**9, 4)]) for i in range(30)]
    rows += [(3000, []), (3001, [])]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(5)
    asked = [r for r in rows if r[0] % 50 == 0]
    got = top_k(df.where("id % 50 = 0"), df, k=7, bins=16, query_rows=3, vector_rows=50)
    assert sorted(map(tuple, got.collect())) == brute(rows, asked, 7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0009, -0.0009]), (None, [1.0, 1.0]),
            (6, [1.0, 0.5]), (6, [1.0, 0.5])]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert sorted((r["id"], r["v"]) for r in v.collect()) == [(0, [1024, 512]), (5, [0, -1]), (6, [1024, 512]), (6, [1024, 512])]
    got = [tuple(r) for r in top_k(v.where("id = 0"), v, k=10).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 1310720), (0, 2, 6, 1310720), (0, 3, 5, -512)]
    assert top_k(v.where("id = 99"), v).count() == 0 and top_k(v.where("id = 99"), v.where("id = 99")).count() == 0
