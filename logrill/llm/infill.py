"""Fill-in-middle: cut every text at two ranks and move the middle to the end.

The ranks count units: code points, or matches of a pattern. An indexable skip
list over the units of a text turns a rank into a code point: lane 0 holds a
node for each unit, every further lane about one node in eight of the lane
below, and each link knows how many units and how many code points it passes.
A search walks the sparsest lane while the link stays within the rank, then goes
down a lane, so it adds up widths only. Texts are cut by Spark's own functions.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrill.llm.common import mixed

SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
LIFT = 3  # a node rises to the next lane with a chance of one in 2 ** LIFT


@functools.lru_cache(maxsize=32)
def _risen(size: int) -> list[np.ndarray]:
    """For each lane above 0 the nodes below `size` that reach it, ascending; node 0 is the head and reaches all."""
    heights, lanes = mixed(np.arange(size, dtype=np.uint64) + np.uint64(0x9E37)), []
    nodes = np.arange(size)
    while len(nodes) > 1:
        up = (heights[nodes] >> np.uint64(LIFT * len(lanes) % 63)) & np.uint64((1 << LIFT) - 1) == 0
        up[0] = True
        if up.all():
            break
        nodes = nodes[up]
        lanes.append(nodes)
    return lanes


class SkipList:
    """Units of given code-point widths, found by rank.

    Node i stands before unit i. Lane l is three arrays: the place of each of
    its nodes in the lane below, and the units and code points its link passes.
    """

    def __init__(self, widths: np.ndarray):
        n = self.n = len(widths)
        ones = np.ones(n, np.int64)
        self.lanes = [(None, ones, widths)]
        below = None
        for nodes in _risen(1 << max(n - 1, 1).bit_length()) if n else []:
            nodes = nodes[:np.searchsorted(nodes, n)]
            down = nodes if below is None else np.searchsorted(below, nodes)
            _, units, points = self.lanes[-1]
            self.lanes.append((down, np.add.reduceat(units, down), np.add.reduceat(points, down)))
            below = nodes
            if len(nodes) == 1:
                break

    def code_points(self, rank: int) -> int:
        """How many code points the first `rank` units take, 0 <= rank <= n."""
        node, units, points = 0, 0, 0
        for down, unit_widths, point_widths in reversed(self.lanes):
            while node < len(unit_widths) and units + unit_widths[node] <= rank:
                units += unit_widths[node]
                points += point_widths[node]
                node += 1
            if down is not None:
                if node == len(down):  # past the last node of this lane only at the end of the text
                    return int(points)
                node = down[node]
        return int(points)


def unit_widths(text: str, unit: str | None) -> np.ndarray:
    """Code points of each unit: 1 each, or matches of `unit` with what stands unmatched before them.

    What stands after the last match belongs to the last unit; a text without a
    match is one unit, an empty text none. Empty matches are passed over.
    """
    if unit is None or not text:
        return np.ones(len(text), np.int64)
    ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()]
    if not ends or ends[-1] < len(text):
        ends[-1:] = [len(text)]
    return np.diff(np.array(ends, np.int64), prepend=0)


def _cuts(text: Column, h1: Column, h2: Column, unit: str | None) -> Column:
    """A struct per row: number of units, and code points before each of the two cuts."""

    @F.arrow_udf("n long, first long, second long")
    def cuts(texts: pa.Array, ones: pa.Array, twos: pa.Array) -> pa.Array:
        found = np.zeros((3, len(texts)), np.int64)
        for i, (t, a, b) in enumerate(zip(texts, ones.to_pylist(), twos.to_pylist())):
            units = SkipList(unit_widths(t.as_py(), unit))
            ranks = sorted((a % (units.n + 1), b % (units.n + 1)))
            found[:, i] = units.n, units.code_points(ranks[0]), units.code_points(ranks[1])
        return pa.StructArray.from_arrays([pa.array(x) for x in found], names=["n", "first", "second"])

    return cuts(text, h1, h2)


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from SHA-256 of `seed:key`; a null key counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that fill_in_middle turned into `output`."""
    p, s, m = (F.lit(SENTINELS[x]) for x in ("prefix", "suffix", "middle"))
    first, second = F.when(form == "psm", p).otherwise(s), F.when(form == "psm", s).otherwise(p)

    # no part holds a sentinel, and no sentinel begins as it ends: the first place of each is its own
    at2, at3 = F.instr(output, second), F.instr(output, m)
    one = F.substr(output, F.length(first) + 1, at2 - F.length(first) - 1)
    two = F.substr(output, at2 + F.length(second), at3 - at2 - F.length(second))
    middle = F.substr(output, at3 + F.length(m))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(
        F.concat(two, middle, one))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str | None = None, seed: int = 1,
                   share: int = 90, spm_share: int = 20) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output, text: one row per row of docs.

    Of each hundred texts `share` are cut, and of these `spm_share` have the
    suffix first (spm), the others the prefix (psm). The rest, empty texts and
    texts that hold a sentinel stay plain: the output is the text, and the
    numbers of code points are null. A null text counts as empty, a null key as
    the key ''. Repeated rows get equal rows each, other columns are not kept, an
    empty table gives no row. `unit` is a pattern whose matches are the units
    (default: code points); n counts units, prefix_chars and middle_chars code points.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col(key), seed)
    rows = docs.select(F.col(key).alias("key"), held.alias("text"),
                       *(h.alias(f"h{i}") for i, h in enumerate((h1, h2, h3, h4), 1)))
    rows = rows.withColumn("cut", _cuts(F.col("text"), F.col("h1"), F.col("h2"), unit))
    t, first, second = F.col("text"), F.col("cut.first"), F.col("cut.second")
    plain = (t == "") | (F.col("h3") % 100 >= share)
    for mark in SENTINELS.values():
        plain = plain | t.contains(mark)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_share, "spm").otherwise("psm")
    p, s, m = (F.lit(SENTINELS[x]) for x in ("prefix", "suffix", "middle"))
    prefix, middle, suffix = (F.substr(t, F.lit(1), first), F.substr(t, first + 1, second - first),
                              F.substr(t, second + 1))
    output = (F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    kept = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        F.col("key").alias(key), F.col("cut.n").alias("n"), "form", F.when(kept, first).alias("prefix_chars"),
        F.when(kept, second - first).alias("middle_chars"), output.alias("output"), t.alias("text"))
