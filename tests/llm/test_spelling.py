"""Spelling variants against plain Python: every pair of words compared, forms followed one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from logrill.llm import spelling
from logrill.llm.spelling import near_words, spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs, drop, least_length, least_count):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_length:
                counts[run] += 1
    return judged({w: n for w, n in counts.items() if n >= least_count})


def judged(counts):
    near = {w: sorted((-counts[x], x) for x in counts if x != w and one_edit(w, x)) for w in counts}
    form = {w: x[0][1] if x and -x[0][0] >= 2 * counts[w] else None for w, x in near.items()}
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = ["letter", "Letters", "litter", "better", "straße", "straéße", "ÀÉÎõü", "àéîõü", "aaaaa", "aaaaaa", "aaaaaaaaa",
             "stale", "least", "steal", "slate", "stalk", "étude", "étuder", "x" * 300, "x" * 299 + "y"]
    return [(i if i % 9 else None, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=60))) for i in range(150)]


@pytest.mark.parametrize("drop", [5, 97])
def test_against_brute_force(spark, docs, drop):
    got = spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), drop=drop)
    want = brute(docs, drop, 5, 3)
    assert rows(got) == want and any(r[1] for r in want) and (drop > 5 or any(r[1] and r[2] != r[1] for r in want))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 97, 5, 3)
    assert rows(spelling_variants(docs)) == want and len(want) > 100


def test_many_buckets_and_heavy_branches(spark):
    """Anagrams and near copies of one word: one branch holds nearly all words and is dealt to many buckets."""
    rng = random.Random(1)
    counts = {"".join(rng.sample("stonebird", 9)): rng.randint(3, 99) for _ in range(150)}
    for w in list(counts):
        for _ in range(3):
            at = rng.randrange(9)
            counts[w[:at] + rng.choice(["", "a", "s", w[at] * 2]) + w[at + 1:]] = rng.randint(3, 99)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {(w, near) for w, _, _, _, near, _ in judged(counts) if near}
    for branch, bucket in ((20_000, 16_384), (7, 40), (3, 5)):
        got = near_words(words, branch=branch, bucket=bucket).collect()
        assert {(r["word"], r["n_near"]) for r in got} == want
        assert all(one_edit(r["word"], r["form"]) and counts[r["form"]] == r["form_n"] for r in got)


def test_counts_leave_the_task_in_parts(spark, docs):
    df = spark.createDataFrame(docs * 2, "doc_id long, text string").repartition(2)
    got = spelling.word_counts(df, "doc_id", "text", 97, 5, 3, held=4)
    assert sorted(map(tuple, got.collect())) == [(r[0], r[3]) for r in brute(docs * 2, 97, 5, 3)]


def test_chains_are_followed(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w3")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert set(got.values()) == {"w13"} and len(got) == 14


def test_odd_rows(spark, odd, empty):
    assert rows(spelling_variants(empty)) == []
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], 97, 5, 3)
    assert rows(spelling_variants(odd.withColumnRenamed("lang", "word").withColumnRenamed("row", "form"))) == want
