"""Components of the Jaccard join against all pairs, at two similarities, and odd rows."""

import random

import numpy as np
import pytest

from logrill.llm.common import components
from logrill.llm.jaccard import (
    Bands, _families, _pack_signatures, _reduced, _unpack_signatures, differing, jaccard_components, linked, shingle_sets, signatures, sketch)


def brute(docs, words, num, den):
    sets = {}
    for i, text in docs:
        w = [x.lower() if x.isascii() else x for x in (text or "").split()]
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("words, num, seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_against_all_pairs(spark, words, num, seed):
    random.seed(seed)
    vocab = [f"w{k}" for k in range(300)]
    docs = []
    for family in range(25):
        base = [random.choice(vocab) for _ in range(random.choice([2, 4, 9, 30, 80, 200, 600]))]
        for _ in range(random.randrange(1, 12)):
            w = list(base)
            for _ in range(random.randrange(0, 1 + len(w) // 12)):
                k = random.randrange(len(w))
                w[k:k + 1] = random.choice([[], [random.choice(vocab)], [w[k], random.choice(vocab)]])
            docs.append((len(docs), " ".join(w)))
    docs += [(1000, docs[3][1]), (1001, docs[3][1].upper()), (1002, ""), (1003, None), (1004, " \n")]
    want = brute(docs, words, num, 100)
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words=words, num=num,
                             block_elements=2000, block_sets=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_block_of_many_sets_is_exact():
    random.seed(4)
    base = list(range(100))
    texts = [" ".join(f"s{x}" for x in base if x != skip) for skip in range(60)]
    sets = shingle_sets(texts, 1)
    assert len(linked(sets, 98, 100)) == 59 and len(linked(sets, 985, 1000)) == 0


def test_odd_rows(odd, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(odd).collect()}
    assert (1, 0, 1) in got and (5, 1, 5) in got and (None, 0, None) in got and (None, 1, None) in got
    assert [c for i, _, c in got if i == 4] == [3] and (7, 0, 7) in got
    assert jaccard_components(empty).count() == 0


def test_copies_beyond_counting_and_keys_with_several_sets(spark):
    """Copies come back to their component whatever batch they sign in; a key with two texts links the copies of both."""
    rng = random.Random(8)
    text = [" ".join(f"{c}{x}" for x in range(40)) for c in "abcde"]
    near = [" ".join([*t.split()[:-1], "other"]) for t in text]
    docs = [(i, t) for i, t in enumerate(rng.choices(text[:2] + near[:1], k=600))]
    docs += [(1000, text[2]), (1001, text[2]), (1001, text[3]), (1002, text[3]), (999, text[3]), (1003, near[3]), (1004, text[4])]
    rng.shuffle(docs)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), words=2).collect()}
    least = {t: min(i for i, x in docs if x == t) for t in text}
    near_least = min(i for i, x in docs if x in (text[0], near[0]))
    for i, t in docs:
        want = near_least if t in (text[0], near[0]) else 999 if t in (text[2], text[3], near[3]) else least[t]
        assert got[i] == want


def test_packed_signatures_come_back():
    rng = np.random.default_rng(5)
    for low, high in ((0, 1), (7, 300), (-5, 1 << 40), (-(1 << 63), (1 << 63) - 1)):
        sig = np.sort(rng.integers(0, 1 << 48, 1000))
        ids = rng.integers(low, high, 1000)
        many = rng.random(1000) < 0.3
        back = _unpack_signatures(_pack_signatures(sig, ids, many))
        assert all((x == y).all() for x, y in zip(back, (sig, ids, many)))
    one = _unpack_signatures(_pack_signatures(np.array([3]), np.array([9]), np.array([True])))
    assert [x.tolist() for x in one] == [[3], [9], [True]]


def test_signatures_reduced_in_any_steps():
    """However the entries are dealt, three or more become a connected star and two stay a pair."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        sig, ids = rng.integers(0, 12, 40), rng.integers(0, 15, 40)
        held, edges = (sig[:0], ids[:0], np.zeros(0, bool)), []
        cuts = np.sort(rng.integers(0, 41, 3))
        for s, i in zip(np.split(sig, cuts), np.split(ids, cuts)):
            local = _reduced(s, i, np.zeros(len(s), bool))  # as a signing task does
            edges.append(local[3])
            *held, new, pairs = _reduced(*(np.concatenate([x, y]) for x, y in zip(held, local[:3])))
            edges.append(new)
        stars, two = {tuple(e) for e in np.concatenate(edges).tolist()}, {tuple(e) for e in pairs.tolist()}
        for k in set(sig.tolist()):
            bucket = sorted(set(ids[sig == k].tolist()))
            if len(bucket) == 2:
                assert tuple(bucket) in two
            reached, grew = {bucket[0]}, True
            while grew and len(bucket) > 2:
                more = {y for e in stars for x, y in (e, e[::-1]) if x in reached}
                grew, reached = not more <= reached, reached | more
            assert len(bucket) < 3 or set(bucket) <= reached


def test_sketches_never_rule_out_more_than_the_sets_differ_in():
    rng = np.random.default_rng(7)
    for n in (1, 30, 64, 65, 500, 2000):
        one = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for kept in (0, n // 2, n - n // 10, n):
            two = np.concatenate([one[:kept], rng.integers(0, 1 << 63, rng.integers(1, n + 1)).astype(np.uint64)])
            apart = len(np.setxor1d(one, two))
            assert differing(sketch(one), sketch(two)) <= apart
        assert differing(sketch(one), sketch(one)) == 0
    assert differing(sketch(one), sketch(two[::-1])) == differing(sketch(two), sketch(one))


def test_large_families_that_sign_again_lose_no_link(spark):
    """Chains of shared passages make one family of many blocks; copies of a text with two texts under a key are among them."""
    rng = random.Random(9)
    passages = [[f"p{k}x{i}" for i in range(30)] for k in range(12)]
    docs = []
    for k in range(60):
        words = [f"d{k}y{i}" for i in range(rng.randrange(4, 20))] + passages[k % 12] + passages[(k * 5 + 1) % 12]
        docs.append((len(docs), " ".join(words)))
        for _ in range(rng.randrange(0, 3)):
            docs.append((len(docs), " ".join(w for w in words if rng.random() > 0.04)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(
        spark.createDataFrame(docs, "doc_id long, text string"), words=2, num=80, block_elements=400, block_sets=8).collect()}
    assert got == brute(docs, 2, 80, 100)


@pytest.mark.parametrize("bound", [1, 7, 60, 1 << 18])
def test_components_of_any_bound(spark, bound):
    """Chains, stars and repeated edges, whether tasks end the graph or rounds do; few jobs where it is small."""
    rng = random.Random(bound)
    edges = [(k, k + 1) for k in range(-40, 0)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 200), (200, 300)]
    edges += [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(50)] + [(1 << 62, -(1 << 62))]
    rng.shuffle(edges)
    parent = {i: i for e in edges for i in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    frame = spark.createDataFrame(edges, "a long, b long").repartition(6)
    spark.sparkContext.setJobGroup(f"components {bound}", "")
    got = [tuple(r) for r in components(frame, "test_components", bound).collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {bound}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got) == sorted((i, root(i)) for i in parent)
    assert bound < 1 << 18 or jobs <= 6


def test_components_of_no_edge(spark):
    none = spark.createDataFrame([(3, 3), (None, 4)], "a long, b long")
    assert components(none, "test_components").collect() == []


def test_a_slice_tells_of_a_document_once(spark):
    """Near copies that share signatures in many ways are one tree a slice, and no pair within it is told."""
    rng, slices = random.Random(10), 4
    docs = [(i, " ".join(f"w{k}" for k in range(400) if rng.random() > 0.01)) for i in range(60)]
    frame = spark.createDataFrame(docs, "id long, text string").repartition(6)
    rows = _families(frame, 1, 80, 100, 400, slices, np.zeros(0, np.uint64)).collect()
    trees = [(r["a"], r["b"]) for r in rows if r["many"]]
    assert all(a < b for a, b in trees) and len(trees) <= slices * 59
    assert {i for r in rows for i in (r["a"], r["b"])} == set(range(60))


def test_a_set_leaves_out_its_emptiest_partitions():
    rng = np.random.default_rng(6)
    bands, plans, none = Bands(80, 100, 1000), {}, np.zeros(0, np.uint64)
    for left in (150, 60):  # so many of 300 elements are not common, and partitions are nearly empty
        base = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        common, own = np.sort(base[left:]), bands.band(300)
        near = [np.sort(np.concatenate([np.delete(base, rng.integers(0, left, 12)), rng.integers(0, 1 << 62, 12).astype(np.uint64)]))
                for _ in range(20)]
        sent = [set(signatures(s, bands, plans, common).tolist()) for s in [base, *near]]
        n, slack = np.array([bands.partitions(b)[:2] for b in (own, own + 1)]).T
        assert len(signatures(base, bands, plans, common)) == (n - slack).sum() < n.sum()
        assert all(sent[0] & s for s in sent[1:])
    assert len(signatures(base, bands, plans, none)) <= n.sum()


def test_named_copies_do_not_sign(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, text + " x" * (i % 2)) for i in range(60)], "id long, text string").repartition(6)
    edges = _families(docs, 3, 90, 100, 100, 4, np.zeros(0, np.uint64), copies=np.arange(2, 60)).collect()
    assert {i for r in edges for i in (r.a, r.b)} == {0, 1}
    found = jaccard_components(docs.withColumnRenamed("id", "doc_id")).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 60
