"""The word index and the vector index against brute force, and how little of them a search reads or sends."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrill.operators import retrieval, vectorindex, wordindex


def brute_bm25(docs, queries, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    mean = sum(len(words[i]) for i, t in docs if t is not None) / sum(t is not None for _, t in docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, text in queries:
        scores = {}
        for w, n in Counter(re.findall(r"[^\W_]+", (text or "").lower())).items():
            idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
            for i, ws in words.items():
                if w in ws:
                    tf = ws.count(w)
                    scores[i] = scores.get(i, 0) + n * idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        out[q] = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
    return {q: [(i, -s) for s, i in x] for q, x in out.items() if x}


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 5, 30, 200))))) for i in range(700)]
    docs += [(1000, None), (1001, ""), (1002, "?!"), (1003, docs[3][1]), (1004, docs[3][1]), (1005, "w1 " * 3000)]
    queries = [(q, " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 40))))) for q in range(60)]
    return docs, queries + [(100, ""), (101, None), (102, "nowhere"), (103, "w1 w1 w1 w2")]


@pytest.mark.parametrize("segment_docs,words,lanes", [(4096, 2_000_000, 500_000), (64, 2_000_000, 10), (100, 900, 500_000)])
def test_bm25_is_exact_however_the_index_is_cut(spark, texts, monkeypatch, segment_docs, words, lanes):
    monkeypatch.setattr(wordindex, "SEGMENT_DOCS", segment_docs)
    monkeypatch.setattr(wordindex, "SEGMENT_WORDS", words)
    monkeypatch.setattr(wordindex, "BROADCAST_WORDS", lanes)
    monkeypatch.setattr(wordindex, "QUERY_ROWS", 16)
    docs, queries = (spark.createDataFrame(x, f"{n} long, text string").repartition(3) for x, n in zip(texts, ("doc_id", "query_id")))
    index = wordindex.word_index(docs)
    assert by_query(wordindex.search(index, queries, 7)) == brute_bm25(*texts, 7)
    assert index.select(F.explode("doc_ids")).count() == len(texts[0]) and (segment_docs == 4096) == (index.count() <= 3)


def test_ranges_out_of_reach_are_not_read(texts):
    """One rare word: the ranges that only hold frequent words are passed over."""
    import pyarrow as pa
    rng = random.Random(1)
    lists = [["common"] * rng.randint(1, 9) + (["rare"] if i < 40 else []) for i in range(4000)]
    words = pa.array(lists)
    s = wordindex._segment(pa.array(range(4000)), words)
    reader = wordindex._Reader({k: v for k, v in s.items() if isinstance(v, bytes)}, s["words"], 1.2, 0.75, 5.0)
    at = np.array([s["words"].to_pylist().index(w) for w in ("common", "rare")])
    read, slices = [], wordindex._slices
    try:
        wordindex._slices = lambda a, b: read.append(int(np.sum(b))) or slices(a, b)
        docs, _ = reader.top(at, np.array([0.1, 8.0]), 10, np.arange(4000))
    finally:
        wordindex._slices = slices
    assert set(docs.tolist()) <= set(range(40)) and max(read) < 400


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert retrieval.bm25(docs, queries).count() == 0
    assert retrieval.bm25(queries.withColumnRenamed("query_id", "doc_id"), queries.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_knn_approx_compares_few_vectors(spark, kind, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 24))
    if kind == "clusters":
        v = v * 0.1 + rng.normal(size=(40, 24))[rng.integers(0, 40, 4000)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 24), (5002, v[0].tolist()), (5003, v[0].tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(4)
    queries = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    exact = by_query(retrieval.knn_exact(docs.where("embedding is not null"), queries.where("embedding is not null")))
    assert by_query(retrieval.knn_approx(docs, queries)) == exact
    compared = vectorindex.candidates(docs, queries).count()
    assert compared < 0.03 * len(rows) * len(exact)
    few = by_query(retrieval.knn_approx(docs, queries, probes=6))
    hits = sum(len({d for d, _ in few[q]} & {d for d, _ in exact[q]}) for q in exact)
    assert hits >= (0.9 if kind == "clusters" else 0.3) * 10 * len(exact)


def test_one_vector_may_be_most_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    queries = docs.where("doc_id % 500 < 2").withColumnRenamed("doc_id", "query_id")
    assert by_query(retrieval.knn_approx(docs, queries)) == by_query(retrieval.knn_exact(docs, queries))
    assert vectorindex.candidates(docs, queries).count() <= 12 * 10 * 12


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert retrieval.knn_approx(none, one).count() == 0
    assert retrieval.knn_approx(one.withColumnRenamed("query_id", "doc_id"), one).count() == 1
