"""Fill-in-middle against plain Python: cuts by rank, both forms, units by pattern, odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrill.llm.infill import SkipList, fill_in_middle, restore, unit_widths


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 64, 65, 1000, 20_000])
def test_skip_list_finds_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 9, n)
    found, sums = SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
    assert [found.code_points(r) for r in range(0, n + 1, max(1, n // 500))] == sums[::max(1, n // 500)].tolist()
    assert found.code_points(n) == sums[-1]
    assert n < 20_000 or len(found.lanes) >= 4 and len(found.lanes[1][1]) < n / 5


def test_units_by_pattern():
    assert unit_widths("ab cd  e!", r"\w+").tolist() == [2, 3, 4]
    assert unit_widths("  ", r"\w+").tolist() == [2] and unit_widths("", r"\w+").tolist() == []
    assert unit_widths("aé😀", None).tolist() == [1, 1, 1] and unit_widths("a\nb", r"x*").tolist() == [3]


def brute(key, text, unit):
    text = text or ""
    units = list(text) if unit is None else re.findall(unit, text)
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return key, len(units), "plain", None, None, text, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return key, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("unit", [None, r"\s*\S+\s*|\s+"])
def test_against_brute_force(spark, odd, unit):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [(100 + i, t) for i, t in enumerate(["<P", "a<P>b", "x<S", "<<S>", "é😀𝒳 ß\x00 z"] * 40)]
    rows += [(1000 + i, "wörter 😀 und <P <S Zeichen\n" * i) for i in range(120)]
    got = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit)
    got = got.withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted((brute(*r, unit) for r in rows), key=key)
    assert all(r["back"] == r["text"] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_clashing_names(odd, empty):
    assert fill_in_middle(empty).count() == 0
    clash = odd.withColumnRenamed("spans", "output").withColumnRenamed("row", "n").withColumnRenamed("lang", "cut")
    assert fill_in_middle(clash).count() == odd.count()
