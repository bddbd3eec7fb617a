"""Toxicity scores from a lexicon, misspellings and the words around a hit.

The lexicon is learned: words, and stems that many toxic words begin with,
which documents labelled toxic hold far more often than others. Its entries
form a trie. The Levenshtein automata of all entries are intersected with that
trie: a state is the set of (trie node, edits so far) a word can be in, states
and transitions are built when a word first needs them, and a word whose state
is empty is dropped after a few letters. Each hit is weighed by its entry, by
whether it is spelled right, and by a window of words around it: marks of
quotation and verbs of speech lower it, a second person raises it. A logistic
model over these few sums, fitted on labelled rows, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.session import materialize

WORD = re.compile(r"[^\W\d_]+")
STEMS = range(4, 9)
REPORTS = frozenset(
    "said says say saying called calls call word words term terms quote quoted quotes wrote writes written "
    "reported reports phrase dit mot sagte wort dijo palabra".split())
PERSONS = frozenset("you your yours youre u tu toi vous du dich dein ihr usted".split())
QUOTES = "\"'“”„«»‘’`"
N_FEATURES = 8


def terms(text: str) -> set[str]:
    """The distinct words of a text in lower case, and stems of them, marked by a closing *."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    """Weighted entries as a trie, and the lazily built automaton of words within reach of one."""

    def __init__(self, weights: dict[str, float], states: int = 50_000):
        self.most = states
        self.weights = dict(weights)
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach = [0]  # edits that entries below a node may have
        for term in sorted(weights):
            letters = term.rstrip("*")
            edits = 0 if term.endswith("*") or len(letters) < 5 else 1 if len(letters) < 9 else 2
            node = 0
            for letter in letters:
                self.reach[node] = max(self.reach[node], edits)
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                node = self.children[node][letter]
            self.reach[node] = max(self.reach[node], edits)
            (self.stem if term.endswith("*") else self.entry)[node] = term
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0): 0}, None)

    def _state(self, held: dict[tuple[int, int], int], stem: tuple | None) -> int:
        """The number of a state: the fewest edits per (node, ) after skipping letters of entries, and a stem passed."""
        best: dict[int, int] = {}
        todo = [(node, edits) for (node, edits) in held]
        while todo:
            node, edits = todo.pop()
            if edits > self.reach[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]  # a letter of the entry left out
        for node in best:
            term = self.stem[node]
            if term and best[node] == 0:
                stem = max(stem or (0.0, ""), (self.weights[term], term))
        key = (tuple(sorted(best.items())), stem)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.number[key]

    def _move(self, state: int, letter: str) -> int:
        nodes, stem = self.states[state]
        held = {}
        for node, edits in nodes:
            child = self.children[node].get(letter)
            if child is not None:
                held[child, edits] = 0
            held[node, edits + 1] = 0  # a letter too many
            for other, child in self.children[node].items():
                if other != letter:
                    held[child, edits + 1] = 0  # another letter
        to = self._state(held, stem)
        self.moves[state][letter] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The entry that a lower-case word means, and its edits: the fewest, then the heaviest; stems count as exact."""
        if len(self.states) > self.most:
            self._reset()
        state = self.start
        for letter in word:
            to = self.moves[state].get(letter)
            if to is None:
                to = self._move(state, letter)
            state = to
            if not self.states[state][0] and self.states[state][1] is None:
                return None
        nodes, stem = self.states[state]
        found = [(edits, -self.weights[self.entry[n]], self.entry[n]) for n, edits in nodes if self.entry[n]]
        if stem:
            found.append((0, -stem[0], stem[1]))
        if not found:
            return None
        edits, _, term = min(found)
        return term, edits


class Scorer:
    """Features of texts under a lexicon; remembers the outcome for words it has met."""

    def __init__(self, lexicon: Lexicon, window: int = 4, remember: int = 200_000):
        self.lexicon, self.window, self.remember, self.known = lexicon, window, remember, {}

    def features(self, text: str) -> np.ndarray:
        """Sums of the weights of hits: spelled right, misspelled, quoted, reported, addressed; hits; distinct; share."""
        out = np.zeros(N_FEATURES)
        low = text.lower()
        words = WORD.findall(low)
        known = self.known
        distinct = set(words)
        hits = {}
        for word in distinct:
            found = known.get(word, 0)
            if found == 0:
                if len(known) > self.remember:
                    known.clear()
                found = known[word] = self.lexicon.match(word)
            if found is not None:
                hits[word] = found
        if not hits:
            return out
        spans = [m.span() for m in WORD.finditer(low)]
        for i, word in enumerate(words):
            if word not in hits:
                continue
            term, edits = hits[word]
            weight = self.lexicon.weights[term]
            near = words[max(0, i - self.window):i] + words[i + 1:i + 1 + self.window]
            a, b = spans[i]
            left, right = low[max(0, a - 40):a], low[b:b + 40]
            quoted = any(q in left[-1:] for q in QUOTES) and any(q in right[:1] for q in QUOTES) or (
                sum(left.count(q) for q in "\"“„«") % 2 == 1 and any(q in right for q in "\"”“»"))
            reported = any(w in REPORTS for w in words[max(0, i - 3):i])
            if quoted:
                out[2] += weight
            elif reported:
                out[3] += weight
            else:
                out[1 if edits else 0] += weight
            if any(w in PERSONS for w in near):
                out[4] += weight
            out[5] += 1
        out[6] = len({t for t, _ in hits.values()})
        out[7] = out[5] / len(words) * 100
        return np.log1p(out)


def learn_lexicon(docs: DataFrame, support: int = 3, odds: float = 2.0) -> dict[str, float]:
    """Entries and their log odds from (text, label): what toxic rows hold far more often than the others.

    Counts cover all rows given, equal texts of a label once. Terms of at least
    `support` toxic texts whose log odds less two standard errors are at least
    `odds` form the lexicon, however rare they are. A stem stands beside its
    words unless one word makes up most of its rows.
    """
    def count(batches):
        for batch in batches:
            n = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n.update((t, label) for t in terms(text or ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in n], pa.string()), pa.array([n[k] if k[1] == 1 else 0 for k in n], pa.int64()),
                 pa.array([n[k] if k[1] == 0 else 0 for k in n], pa.int64())], names=["term", "n", "m"])

    docs = docs.withColumn("_sha", F.sha2("text", 256)).dropDuplicates(["_sha", "label"])
    totals = dict(docs.groupBy("label").count().collect())
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    held = docs.select("text", "label").mapInArrow(count, "term string, n long, m long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("n") >= support)
    held = materialize(held, "toxic_terms")
    log = F.log((F.col("n") + 0.5) / (ones + 1)) - F.log((F.col("m") + 0.5) / (zeros + 1))
    error = F.sqrt(1 / (F.col("n") + 0.5) + 1 / (F.col("m") + 0.5))
    # the rows of the word that most often begins with a stem
    starts = F.explode(F.array(*(F.concat(F.substring("term", 1, n), F.lit("*")) for n in STEMS))).alias("term")
    most = held.where(~F.endswith("term", F.lit("*"))).select(starts, F.col("n").alias("most")).groupBy("term").agg(F.max("most").alias("most"))
    found = held.withColumn("log", log).where(F.col("log") - 2 * error >= odds).join(most, "term", "left").collect()
    weights = {r["term"]: r["log"] for r in found}
    rows = {r["term"]: (r["n"], r["most"] or 0) for r in found}
    # stems from the shortest: one that a single word explains gives way to the word, others cover longer terms
    chosen: dict[str, float] = {}
    for term in sorted((t for t in weights if t.endswith("*")), key=lambda t: (len(t), t)):
        if rows[term][1] < 0.6 * rows[term][0] and not any(term[:n] + "*" in chosen for n in STEMS if n < len(term) - 1):
            chosen[term] = weights[term]
    chosen |= {word: weight for word, weight in weights.items() if not word.endswith("*")}  # beside the stems: these allow no edits
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0])))


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last number is the bias."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(docs: DataFrame, lexicon, keep: list[str], weights=None, threshold: float = 0.7) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        scorer = Scorer(Lexicon(lexicon.value))
        for batch in batches:
            x = np.array([scorer.features(t or "") for t in batch.column("_text").to_pylist()]).reshape(-1, N_FEATURES)
            rest = [batch.column(c) for c in keep]
            if weights is None:
                yield pa.RecordBatch.from_arrays([*rest, pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])
            else:
                chance = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(chance), pa.array((chance >= threshold).astype(np.int32)), pa.array(np.expm1(x[:, 5]).round().astype(np.int64))],
                    names=[*keep, "score", "predicted", "n_hits"])

    more = "x array<double>" if weights is None else "score double, predicted int, n_hits long"
    return docs.select(*keep, "_text").mapInArrow(run, f"{schema}, {more}")


def toxicity(docs: DataFrame, labels: DataFrame, held_out, keep: list[str], label: str = "toxic", key: str = "doc_id",
             text: str = "text", sample: int = 40_000, **lexicon_options) -> DataFrame:
    """The columns `keep` of each row, score, predicted (1 if score >= 0.7) and n_hits.

    `held_out` is a boolean column over the key; labels of such keys are never
    read. The lexicon and the logistic model are learned from at most `sample`
    labelled rows, those whose key's hash is smallest. A null text
    counts as empty and has no hit. A key labelled twice takes the larger label;
    repeated rows are scored each alike. Without labels of both kinds every row
    has the smoothed share of label 1.
    """
    marked = labels.where(F.col(label).isin(0, 1) & ~held_out).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    given = docs.withColumn("_text", F.col(text))
    picked = marked.orderBy(F.xxhash64(key), key).limit(sample)
    seen = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(picked), key)  # at most `sample` keys
    lexicon = learn_lexicon(seen.select(F.col("_text").alias("text"), "label"), **lexicon_options)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms of at most `sample` rows
    rows = _featured(seen, shared, ["label"]).toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    x = np.array(rows.column("x").to_pylist()).reshape(-1, N_FEATURES)
    if len(set(y.tolist())) < 2:
        weights = np.append(np.zeros(N_FEATURES), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    else:
        weights = fit(x, y)
    return _featured(given, shared, keep, weights)
