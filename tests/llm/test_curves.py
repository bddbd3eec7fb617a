"""Shifted Hilbert curves against brute force: recall, distances, ties, copies, odd vectors, the fit."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrill.llm import curves
from logrill.llm.curves import fitted, hilbert, nearest, real_vectors


def brute(rows, asked, k):
    """Each query's k nearest ids, an id at its nearest vector."""
    out = {}
    for q, v in asked:
        near = {}
        for i, w in rows:
            if i != q and len(w) == len(v):
                d = float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum()))
                near[i] = min(d, near.get(i, d))
        out[q] = sorted((d, i) for i, d in near.items())[:k]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_is_a_path(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    order = np.argsort(keys := hilbert(cells, bits))
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_fit_takes_the_cheapest():
    assert fitted(np.array([[0, 0, 0, 40]]), 100, 0.75) == (1, 0)
    assert fitted(np.array([[9, 0, 40, 0], [0, 9, 0, 0]]), 100, 1.0) == (2, 0)
    assert fitted(np.array([[90] * 9, [80] * 9]), 100, 0.9) == (1, 90) and fitted(np.zeros((2, 0), int), 7, 0.9) == (1, 7)


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall(spark, kind):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(60, 16)) * 5
    v = rng.normal(size=(3000, 16)) * 0.3 + middles[rng.integers(0, 60, 3000)] if kind == "clusters" else rng.normal(size=(3000, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = by_query(nearest(df.where("id % 25 = 0"), df, per_segment=64, sample=40))
    want = brute(rows, rows[::25], 10)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    near = {(q, i): d for q in want for d, i in want[q]}
    assert all(abs(d - near.get((q, i), d)) < 1e-12 for q in got for d, i in got[q])


def test_structure_needs_short_windows(spark, monkeypatch):
    """In clusters the fitted windows hold a small part of the curve."""
    rng, seen = np.random.default_rng(4), []
    monkeypatch.setattr(curves, "fitted", lambda a, n, r, f=fitted: seen.append((f(a, n, r), n)) or seen[-1][0])
    v = rng.normal(size=(80, 8)).repeat(50, axis=0) * 9 + rng.normal(size=(4000, 8)) * 0.05
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    assert nearest(df.where("id % 40 = 0"), df, per_segment=50, sample=60).count() == 1000
    ((used, reach), n), = seen
    assert used * (2 * reach + 1) <= n / 4


def test_ties_copies_and_repeated_ids(spark):
    """Whole windows are exact: copies beyond counting, ties, ids with several vectors, two dimensions."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 1.0]) for i in range(400)] + [(7, [2.0, 2.0, 2.0]), (7, [9.0, 9.0, 9.0]), (8, rows[8][1])]
    rows += [(2000 + i, [float(i), 0.5]) for i in range(15)]
    rows = [r for r in rows if any(r[1])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    least = {}
    for i, v in rows:
        least[i] = min(v, least.get(i, v))
    asked = [(i, v) for i, v in least.items() if i % 20 == 7 or i % 50 == 0]
    got = by_query(nearest(df.where("id % 20 = 7 or id % 50 = 0"), df, k=6, per_segment=40, recall=1.0, sample=10**6))
    assert {q: [(round(d, 9), i) for d, i in x] for q, x in got.items()} == \
        {q: [(round(d, 9), i) for d, i in x] for q, x in brute(rows, asked, 6).items()}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, -0.0]), (None, [1.0, 1.0]),
            (6, [1.0, 0.5]), (6, [1.0, 0.5]), (7, []), (8, [4.0, 4.5])]
    v = real_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert sorted(r["id"] for r in v.collect()) == [0, 6, 6, 8]
    assert by_query(nearest(v.where("id = 0"), v)) == {0: [(0.0, 6), (5.0, 8)]}
    assert nearest(v.where("id = 99"), v).count() == 0 and nearest(v.where("id = 99"), v.where("id = 99")).count() == 0
    assert nearest(v.where("id = 0"), v.where("id = 0")).count() == 0


def test_whole_table(spark):
    from logrill.llm.q_curves import query
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = by_query(query(spark, "/root/testdata/sf0.01"))
    assert set(got) == set(want)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 9 * len(want)


def test_samples_are_cut_before_the_driver_orders_them(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h0"), F.xxhash64(F.lit(1), "id").alias("h1"), "id").repartition(8)
    for n, first, second in ((40, "h0", "h1"), (1, "h1", "h0"), (6000, "h0", "h1")):
        want = [r.id for r in rows.orderBy(first, second).limit(n).collect()]
        assert [r["id"] for r in curves._least(rows, n, first, second, "id")] == want
    same = spark.range(300).select(F.lit(1 << 62).alias("h0"), "id")  # nothing below the bound: it is widened
    assert [r["id"] for r in curves._least(same, 5, "h0", "id", "id")] == list(range(5))
    assert curves._least(rows.where("id < 0"), 5, "h0", "h1", "id") == []


@pytest.mark.parametrize("stretch", [1, 4, 100])
def test_blocks_move_once_per_stretch(spark, stretch):
    blocks = spark.createDataFrame([(i, 3 * i, 3 * i + i % 5) for i in range(9)], "q long, first long, last long")
    segments = spark.createDataFrame([(at,) for at in range(30)], "at long")
    pairs = curves._beside(blocks, segments, stretch)
    got = sorted((r.q, r["at"]) for r in pairs.collect())
    assert got == [(i, at) for i in range(9) for at in range(3 * i, 3 * i + i % 5 + 1) if at < 30]
    assert "SortMergeJoin" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan
