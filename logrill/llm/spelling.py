"""Spelling variants: words at an edit distance of one, and the word each is a form of.

A word's frequency vector counts its letters by group, GROUPS numbers in a fixed
order. One edit raises one of them, lowers one, or does one of each. The words
are the leaves of a trie whose levels are the numbers; a depth-first search with
a word's own numbers may leave them by a surplus of one and a deficit of one in
all, and the words of the leaves it reaches are compared letter by letter.

The trie is cut below its first PREFIX levels: words of one length with equal
first numbers are a branch, branches are dealt to buckets, and a word asks the
branches that a longer or equally long neighbour can lie in. Branches of more
than `branch` words are dealt to several buckets, each of which is asked, so a
task holds a bounded number of words and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.llm.common import mixed
from logrill.session import materialize

GROUPS, FIRST = 12, ord("e")  # a letter's group: code point less FIRST, modulo GROUPS; e, r, s and t come first
PREFIX = 4
RUNS = re.compile("[a-zÀ-ÿ]+")
PAIRS = 1 << 20  # letters compared at a time


def word_counts(docs: DataFrame, key: str, text: str, drop: int, least_length: int, least_count: int,
                held: int = 200_000) -> DataFrame:
    """word, n: the words of at least `least_length` code points and `least_count` occurrences.

    Counts are summed per task before they are shuffled, `held` words at a time.
    """
    def run(batches):
        total = Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                # bytes.lower changes A to Z only
                for run_, n in Counter(RUNS.findall(t.encode().lower().decode())).items():
                    if len(run_) < least_length:
                        continue
                    h = zlib.crc32(run_.encode(), seed)
                    if h % drop == 0:
                        at = h % len(run_)
                        run_ = run_[:at] + run_[at + 1:]
                        if len(run_) < least_length:
                            continue
                    total[run_] += n
                if len(total) >= held:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    parts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Words:
    """Words as one array of code points, and their frequency vectors."""

    def __init__(self, words: list[str]):
        self.words = np.array(words, object)
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if words else np.zeros(0, np.int64)
        at = np.repeat(np.arange(len(words)), self.sizes) * GROUPS + (self.points - FIRST) % GROUPS
        self.counts = np.bincount(at, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)

    def letters(self, some: np.ndarray, size: int) -> np.ndarray:
        return self.points[self.starts[some][:, None] + np.arange(size)]


def _branch(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each branch: words of one length with equal first numbers."""
    with np.errstate(over="ignore"):
        code = mixed(sizes.astype(np.uint64) + np.uint64(1))
        for i in range(PREFIX):
            code = mixed(code * np.uint64(31) + counts[:, i].astype(np.uint64) + np.uint64(1))
    return code.view(np.int64)


def _steps() -> list[tuple[int, np.ndarray]]:
    """What a neighbour's length and first numbers can have more than a word's own, seen from one of the two."""
    unit = np.eye(PREFIX, dtype=np.int64)
    none = np.zeros(PREFIX, np.int64)
    return [(1, none), *((1, e) for e in unit), (0, none), *((0, e) for e in unit),
            *((0, unit[i] - unit[j]) for i, j in combinations(range(PREFIX), 2))]


def _asked(words: DataFrame) -> DataFrame:
    """word, n, home (the word's branch) and probes (the branches it asks)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w = Words(batch.column(0).to_pylist())
            first = w.counts[:, :PREFIX]
            probes = [_branch(w.sizes + more, first + step) for more, step in _steps()]
            possible = [(first + step >= 0).all(axis=1) for _, step in _steps()]
            probes, possible = np.stack(probes, 1), np.stack(possible, 1)
            offsets = np.concatenate([[0], np.cumsum(possible.sum(axis=1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(_branch(w.sizes, first)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(probes[possible]))],
                names=["word", "n", "home", "probes"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, home long, probes array<long>")


class Trie:
    """Frequency vectors by successive numbers: a level's nodes in order, each known by its parent and its number."""

    def __init__(self, counts: np.ndarray, largest: int):
        self.order = np.lexsort(counts.T[::-1])
        self.span = largest + 3
        ordered, self.levels = counts[self.order], []
        node = np.zeros(len(counts), np.int64)
        for level in range(GROUPS):
            keys, node = np.unique(node * self.span + ordered[:, level], return_inverse=True)
            self.levels.append(keys)
        self.ends = np.searchsorted(node, np.arange(len(keys)), side="right")
        self.begins = np.concatenate([[0], self.ends[:-1]])

    def search(self, counts: np.ndarray):
        """Yields (asking rows, leaves) where the leaf's vector lies within the budget and has no smaller sum.

        Depth first: the last branch found is followed down before any other;
        all rows that are in one state go down together.
        """
        stack = [(0, np.arange(len(counts)), np.zeros(len(counts), np.int64), 0, 0)]
        while stack:
            level, rows, nodes, surplus, deficit = stack.pop()
            if level == GROUPS:
                if surplus >= deficit:
                    yield rows, nodes
                continue
            keys = self.levels[level]
            for step in (-1, 1, 0):
                if (step > 0 and surplus) or (step < 0 and deficit):
                    continue
                want = counts[rows, level] + step
                key = nodes * self.span + want
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[at] == key) & (want >= 0)
                if hit.any():
                    stack.append((level + 1, rows[hit], at[hit], surplus + (step > 0), deficit + (step < 0)))


def _one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether b[j], as long as a[i] or a letter longer, is a[i] with one letter replaced or put in."""
    near = np.zeros(len(i), bool)
    kinds = a.sizes[i] * 2 + (b.sizes[j] - a.sizes[i])
    for kind in np.unique(kinds):
        size, longer = int(kind) // 2, int(kind) % 2
        of_kind = np.flatnonzero(kinds == kind)
        rows = max(1, PAIRS // size)
        for k in range(0, len(of_kind), rows):
            some = of_kind[k:k + rows]
            x, y = a.letters(i[some], size), b.letters(j[some], size + longer)
            if longer:
                head = np.cumprod(x == y[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
                tail = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
                near[some] = head + tail >= size
            else:
                near[some] = (x != y).sum(axis=1) == 1
    return near


def _near(group: pa.Table) -> pa.Table:
    """Near pairs between the words of a bucket and those that ask it: a row per word with their number and the best."""
    table = group.select(["word", "n", "resident"]).to_pandas().drop_duplicates(["word", "resident"])
    here, there = table[table.resident], table[~table.resident]
    kept: dict[str, list] = {}
    if len(here) and len(there):
        a, b = Words(there.word.tolist()), Words(here.word.tolist())
        a_n, b_n = there.n.to_numpy(), here.n.to_numpy()
        trie = Trie(b.counts, int(max(a.counts.max(), b.counts.max())))
        for rows, leaves in trie.search(a.counts):
            sizes = trie.ends[leaves] - trie.begins[leaves]
            for some in np.array_split(np.arange(len(rows)), max(1, int(sizes.sum()) // PAIRS)):
                if not len(some):
                    continue
                i = np.repeat(rows[some], sizes[some])
                within = np.arange(len(i)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
                j = trie.order[np.repeat(trie.begins[leaves[some]], sizes[some]) + within]
                # each pair is found from one side: the shorter word, or the one with the lesser first numbers
                step = b.counts[j, :PREFIX] - a.counts[i, :PREFIX]
                lead = step[np.arange(len(j)), (step != 0).argmax(axis=1)]
                mine = (b.sizes[j] > a.sizes[i]) | (lead > 0)
                tie = np.flatnonzero(~mine & (lead == 0) & (b.sizes[j] == a.sizes[i]))
                mine[tie] = a.words[i[tie]] < b.words[j[tie]]
                i, j = i[mine], j[mine]
                near = _one_edit(a, i, b, j)
                for x, x_n, y, y_n in zip(a.words[i[near]], a_n[i[near]], b.words[j[near]], b_n[j[near]]):
                    for word, other, n in ((x, y, y_n), (y, x, x_n)):
                        best = kept.setdefault(word, [0, -1, ""])
                        best[0] += 1
                        if n > best[1] or n == best[1] and other < best[2]:
                            best[1:] = n, other
    return pa.table({"word": pa.array(list(kept), pa.string()),
                     "n_near": pa.array([x[0] for x in kept.values()], pa.int64()),
                     "form_n": pa.array([x[1] for x in kept.values()], pa.int64()),
                     "form": pa.array([x[2] for x in kept.values()], pa.string())})


def near_words(words: DataFrame, branch: int = 20_000, bucket: int = 16_384) -> DataFrame:
    """word, n_near, form, form_n for words (word, n; each once) that have a near word; form is that of largest n."""
    asked = materialize(_asked(words), "spelling_words")
    buckets = max(1, -(-asked.count() // bucket))
    heavy = (asked.groupBy("home").count().where(F.col("count") > branch)
             .select("home", F.ceil(F.col("count") / branch).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    here = asked.select("word", "n", "home").join(heavy, "home", "left").select(
        "word", "n", F.lit(True).alias("resident"), "home", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"))
    there = asked.select("word", "n", F.explode("probes").alias("home")).join(heavy, "home", "left").select(
        "word", "n", F.lit(False).alias("resident"), "home", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = here.union(there).select("word", "n", "resident", F.pmod(F.xxhash64("home", "part"), F.lit(buckets)).alias("bucket"))
    found = dealt.groupBy("bucket").applyInArrow(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for forms (word, form): pointers are doubled, so rounds grow with the logarithm of the longest chain."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not found.join(further, "root", "left_semi").limit(1).count():
            return found
        found = materialize(found.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "spelling_roots")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int = 97,
                      least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case; of
    every `drop`-th (document, run), by crc32, one code point is left out. A
    word's form is its near word of largest n (ties: the smallest) if that n is
    at least `ratio` times its own, and forms are followed to the root, so a
    chain at least doubles n in each step for a ratio of 2. Null and empty texts have no words, a null
    key counts as the key ''. Repeated rows count each, other columns are not
    looked at, an empty table gives no row.
    """
    words = materialize(word_counts(docs, key, text, drop, least_length, least_count), "spelling_counts")
    near = near_words(words)
    enough = F.col("form_n") >= ratio * F.col("n")
    held = materialize(words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")),
        "spelling_forms")
    ends = roots(held.where("form IS NOT NULL").select("word", "form"))
    return held.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
