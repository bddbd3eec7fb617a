"""Removal of repeated strings against a direct computation, over several units and slices."""

import hashlib
import random

import numpy as np
import pytest

from logrill.llm import suffixes
from logrill.llm.suffixes import LoserTree, front_coded, front_decoded, repeated


def brute(docs, span=50):
    seen, out = {}, {}
    for i, text in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            w = data[p:p + span]
            if seen.setdefault(w, i) < i:
                gone[p:p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(data, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.setdefault(i, set()).add((len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("unit_bytes", [3_000, 1 << 20])
def test_against_brute_force(spark, unit_bytes):
    random.seed(unit_bytes)
    words = ["alpha", "beta", "gam", "de", "epsilon", "zeta", "é"]
    passage = [" ".join(random.choice(words) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(random.choice(words) for _ in range(random.randrange(40)))]
        parts += [random.choice(passage)[random.randrange(20):random.randrange(60, 160)] for _ in range(random.randrange(4))]
        random.shuffle(parts)
        rows.append((i, "|".join(parts)))
    rows += [(200, rows[5][1]), (201, "x" * 500), (202, "x" * 300), (203, None), (204, ""), (205, "short")]
    want = brute(rows)
    got = repeated(spark.createDataFrame(rows, "doc_id long, text string"), unit_bytes=unit_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] in want[r["doc_id"]]
    assert sum(r["n_removed"] for r in got) > 1000


def test_slices_join_up(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    whole = suffixes.Unit(np.array([1]), np.array([True]), np.array([4000]), data).anchors(50, 16)
    covered = {p for _, lo, hi, _ in zip(*whole) for p in range(lo, hi + 1)}
    monkeypatch.setattr(suffixes, "SLICE", 700)
    cut = suffixes.Unit(np.array([1]), np.array([True]), np.array([4000]), data).anchors(50, 16)
    assert covered == set(range(3951)) == {p for _, lo, hi, _ in zip(*cut) for p in range(lo, hi + 1)}
    assert {(a, p) for a, lo, hi, _ in zip(*whole) for p in range(lo, hi + 1)} == {
        (a, p) for a, lo, hi, _ in zip(*cut) for p in range(lo, hi + 1)}


def test_loser_tree_merges_front_coded_runs():
    random.seed(2)
    runs = [sorted("".join(random.choice("ab") for _ in range(6)).encode() for _ in range(random.randrange(30))) for _ in range(7)]
    coded = [front_coded(np.array([list(x) for x in r], np.uint8).reshape(-1, 6)) for r in runs]
    merged = list(LoserTree([front_decoded(c, rest, 6) for c, rest in coded]))
    assert [row for _, _, row in merged] == sorted(x for r in runs for x in r)
    for (_, _, a), (n, _, b) in zip(merged, merged[1:]):
        assert n == next((k for k in range(6) if a[k] != b[k]), 6)


def test_odd_rows(odd, empty):
    got = repeated(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[3][0]["n_removed"] == 0 and by[4][0]["n_removed"] == by[4][0]["n_bytes"] and by[4][0]["n_spans"] == 1
    assert all(r["n_removed"] == 0 for r in by[None] + by[5])
    assert repeated(empty).count() == 0


def test_rows_are_sorted_by_all_words():
    """Ties of the first two words are ordered by the others, equal rows stay as they came."""
    rng = np.random.default_rng(3)
    for n, width in ((0, 11), (1, 11), (2, 2), (3000, 1), (3000, 2), (3000, 5), (3000, 11)):
        words = rng.integers(0, 4, (n, width)).astype(np.uint64)
        want = np.lexsort(words.T[::-1]) if n else np.zeros(0, np.int64)
        assert suffixes.sorted_rows(words).tolist() == want.tolist()


def test_parts_are_front_coded_by_themselves():
    rng = np.random.default_rng(4)
    rows = np.unique(rng.integers(97, 100, (500, 9)).astype(np.uint8), axis=0)
    cuts = np.array([1, 2, 40, len(rows) - 1])
    parts = list(suffixes.front_coded_parts(rows, cuts))
    assert parts == [front_coded(part) for part in np.split(rows, cuts)]
    for (common, rest), part in zip(parts, np.split(rows, cuts)):
        assert [row for _, row in front_decoded(common, rest, 9)] == [x.tobytes() for x in part]


def test_rows_that_known_prefixes_tell_apart_are_not_read(monkeypatch):
    """Each row becomes a number once, however many rounds of the tree it plays."""
    random.seed(5)
    runs = [sorted("".join(random.choice("ab") for _ in range(12)).encode() for _ in range(40)) for _ in range(16)]
    coded = [front_coded(np.array([list(x) for x in r], np.uint8)) for r in runs]
    made = []

    class Counted(int):
        @classmethod
        def from_bytes(cls, x):
            made.append(x)
            return int.from_bytes(x)

    monkeypatch.setattr(suffixes, "int", Counted, raising=False)
    merged = [row for _, _, row in LoserTree([front_decoded(c, rest, 12) for c, rest in coded])]
    assert merged == sorted(x for r in runs for x in r) and len(made) == len(merged)
