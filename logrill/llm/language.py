"""Language identification by interpolated Kneser-Ney character models.

One model per language over letters (lower case; every other stretch is one
space). The counts of character 4-grams of the whole learning set are taken in
Spark; all lower orders follow from them as continuation counts. A model is a
set of sorted arrays of 64-bit hashes with one column per language: of 4-, 3-
and 2-grams with their interpolated log probability, and of their contexts with
the log weight of backing off. The language with the lowest cross-entropy per
character wins. A text is rejected when its cross-entropy is above its language's
cut, which is calibrated on learning texts that the models have not counted: it
lies between what a language's own texts have and what texts of other languages
have that would fall to it.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.llm.byte_bpe import groups
from logrill.llm.common import mixed
from logrill.session import bounded_batches, materialize

CALIBRATED = 64  # learning rows from which a language keeps some back to calibrate with
FOLDS = 8  # one of so many is kept back
DAMPED = 64  # characters at which a text's own noise equals that between texts
BINS = 128  # bins a nat in histograms of excess entropy

NOT_LETTERS = re.compile(r"[\W\d_]+")
SPACE = 32
ORDER = 4


def letters(text: str | None) -> str:
    """Lower-case words separated and closed by one space; empty where the text has no letter."""
    kept = NOT_LETTERS.sub(" ", (text or "").lower()).strip(" ")
    return kept + " " if kept else ""


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-gram that ends at each character of the texts, and where each text's grams start.

    A text is preceded by three spaces. A character is folded into 16 bits.
    """
    codes = np.frombuffer(("   " + "   ".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = ((codes ^ (codes >> 16)) & 0xFFFF).astype(np.uint64)
    packed = folded[ORDER - 1:].copy()
    for back in range(1, ORDER):
        packed |= folded[ORDER - 1 - back:len(folded) - back] << np.uint64(16 * back)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])
    inside = np.zeros(len(packed) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(starts + sizes, len(packed)), -1)
    return packed[np.cumsum(inside[:-1]) > 0], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); counted per task before the shuffle."""

    def run(batches):
        held = defaultdict(list)

        def merged(parts):
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out(most):
            for lang in list(held):
                held[lang] = [merged(held[lang])]
                if len(held[lang][0][0]) > most:
                    keys, n = held.pop(lang)[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang[lang].append(letters(text))
            for lang, texts in by_lang.items():
                for some in groups([t for t in texts if t], 1 << 20):
                    held[lang].append(np.unique(grams(some)[0], return_counts=True))
            yield from out(500_000)
        yield from out(0)

    return (docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Table:
    """Sorted hashes with a row of values each; lookups start at the slot of the leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = mixed(keys)
        order = np.argsort(hashed)
        self.keys, self.values = hashed[order], values[order].astype(np.float32)
        self.bits = max(1, int(len(keys)).bit_length())
        slots = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        self.starts = slots.astype(np.int32)
        self.longest = int(np.diff(slots).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        hashed = mixed(keys)
        slot = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.longest):
            open_ = at < end
            todo, at, end, hashed = todo[open_], at[open_], end[open_], hashed[open_]
            hit = self.keys[at] == hashed
            out[todo[hit]] = at[hit]
            rest = ~hit
            todo, at, end, hashed = todo[rest], at[rest] + 1, end[rest], hashed[rest]
        return out


class Model:
    """Interpolated Kneser-Ney over all languages at once, from packed 4-grams and their counts."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        width = len(langs)
        gram = gram.astype(np.int64).view(np.uint64)
        alphabet = len(np.unique(gram & np.uint64(0xFFFF))) + 1
        self.uniform = -np.log(alphabet)
        # counts by order, the highest first: raw counts of 4-grams, then the number of distinct left extensions
        counts = [(lang, gram, n.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            lang_, gram_, _ = counts[-1]
            tail = gram_ & np.uint64((1 << (16 * order)) - 1)
            pairs, kept = np.unique(np.stack([lang_.astype(np.uint64), tail]), axis=1, return_counts=True)
            counts.append((pairs[0].astype(np.int64), pairs[1], kept.astype(np.float64)))
        self.tables: list[tuple[Table, Table]] = []
        lower = None
        for order in range(1, ORDER + 1):
            lang_, gram_, c = counts[ORDER - order]
            once, twice = (np.bincount(lang_[c == k], minlength=width) for k in (1, 2))
            discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)  # each language's own
            keys, at = np.unique(gram_, return_inverse=True)
            contexts, of_key = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, types = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, (of_key[at], lang_), c)
            np.add.at(types, (of_key[at], lang_), 1)
            back = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            seen = np.zeros((len(keys), width))
            seen[at, lang_] = np.maximum(c - discount[lang_], 0) / total[of_key[at], lang_]
            if order == 1:
                below = np.full((len(keys), width), np.exp(self.uniform))
            else:
                below = np.exp(lower(keys & np.uint64((1 << (16 * (order - 1))) - 1)))
            probability = np.maximum(seen + back[of_key] * below, 1e-12)
            self.tables.append((Table(keys, np.log(probability)), Table(contexts, np.log(back))))
            lower = self._at(order)

    def _at(self, order: int):
        """Log probabilities [key, language] of the last character of packed grams of this order."""
        table, contexts = self.tables[order - 1]
        mask = np.uint64((1 << (16 * order)) - 1) if order < 4 else np.uint64(0xFFFFFFFFFFFFFFFF)

        def look(keys):
            keys = keys & mask
            found = table.find(keys)
            out = table.values[found] if len(table.values) else np.zeros((len(keys), len(self.langs)), np.float32)
            lost = np.flatnonzero(found < 0)
            if len(lost):
                context = contexts.find(keys[lost] >> np.uint64(16))
                back = np.where((context >= 0)[:, None], contexts.values[context], np.float32(0)) if len(contexts.values) else 0
                below = self._at(order - 1)(keys[lost]) if order > 1 else np.float32(self.uniform)
                out[lost] = back + below
            return out

        return look

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Nats per character [text, language]; NaN for a text without letters."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        look = self._at(ORDER)
        some = [i for i, t in enumerate(texts) if t]
        at = 0
        for part in groups([texts[i] for i in some], 1 << 18):
            rows = some[at:at + len(part)]
            at += len(part)
            if len(part) == 1:  # a long text, in windows that overlap by the context
                text, total = part[0], 0.0
                packed, _ = grams([text])
                for k in range(0, len(packed), 1 << 18):
                    total = total + look(packed[k:k + (1 << 18)]).sum(axis=0, dtype=np.float64)
                out[rows[0]] = -total / len(packed)
                continue
            packed, starts = grams(part)
            sums = np.add.reduceat(look(packed).astype(np.float64), starts, axis=0)
            out[rows] = -sums / np.array([len(t) for t in part])[:, None]
        return out


def learn(docs: DataFrame) -> Model | None:
    """The model of (lang, text) rows, or None where no row has both a language and letters.

    All texts are counted, and every (language, 4-gram) pair is in the model, so
    a language keeps its rarest grams beside much larger ones. The model grows
    with the number of distinct pairs; driver and executors must have room for it.
    """
    rows = materialize(gram_counts(docs.where("lang IS NOT NULL")), "language_counts").toArrow()
    if not rows.num_rows:
        return None
    names = rows.column("lang").combine_chunks().dictionary_encode()
    langs = names.dictionary.to_pylist() if hasattr(names, "dictionary") else []
    order = np.argsort(langs)
    rank = np.empty(len(langs), np.int64)
    rank[order] = np.arange(len(langs))
    lang = rank[names.indices.to_numpy()]
    return Model([langs[i] for i in order], lang, rows.column("gram").to_numpy(), rows.column("n").to_numpy())


def _kept_back(text: str):
    """Whether a learning row is kept back to calibrate with; equal texts go one way."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)) == 0


def _first_bin(histogram: DataFrame, share: float, name: str) -> DataFrame:
    """(lang, name): the smallest upper end of a bin at or below which at least `share` of a language's rows lie.

    `histogram` is (lang, bin, n), as large as languages times bins.
    """
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    return (histogram.withColumn("_reached", upto >= share * total).where("_reached")
            .groupBy("lang").agg(((F.min("bin") + 1) / BINS).alias(name)))


def cuts(judged: DataFrame, own: float = 0.999, foreign: float = 0.01) -> DataFrame:
    """(lang, usual, cut) per calibrated language, and a row of lang null for all others.

    `judged` has a row per text kept back: lang, entropy (under its own model),
    n (characters), rival and rival_entropy (the best other language, null where
    there is none). The excess of a text is its entropy above the language's
    mean per character, damped for short texts by sqrt(n / (n + DAMPED)). The cut
    lies midway between the `own` quantile of the language's texts and the
    `foreign` quantile of texts of other languages that would fall to it; where
    no such text is known, or the two overlap, as far above the `own` quantile as this is above
    the mean, but at least a quarter of a nat. The row of lang null has the loosest values.
    """
    usual = judged.groupBy("lang").agg((F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("usual"))

    def histogram(lang, entropy):
        excess = (F.col("entropy") - F.col("usual")) * F.sqrt(F.col("n") / (F.col("n") + DAMPED))
        rows = judged.select(F.col(lang).alias("lang"), F.col(entropy).alias("entropy"), "n").join(F.broadcast(usual), "lang")
        return rows.groupBy("lang", F.floor(excess * BINS).alias("bin")).agg(F.count("*").alias("n"))

    high = _first_bin(histogram("lang", "entropy"), own, "high")
    low = _first_bin(histogram("rival", "rival_entropy"), foreign, "low")
    cut = F.when(F.col("low") > F.col("high"), (F.col("low") + F.col("high")) / 2).otherwise(
        F.col("high") + F.greatest("high", F.lit(0.25)))
    found = usual.join(high, "lang").join(low, "lang", "left").select("lang", "usual", cut.alias("cut"))
    found = materialize(found, "language_cuts")
    return found.union(found.agg(F.lit(None).cast("string").alias("lang"), F.max("usual"), F.max("cut")))


def identify(docs: DataFrame, learning: DataFrame, held_out, keep: list[str], text: str = "text",
             lang: str = "lang") -> DataFrame:
    """The columns `keep` of each row, held_out, lang_pred, score, cross_entropy and rejected.

    `learning` has (lang, text); `held_out` is a boolean column that marks the
    rows of `docs` that calibration leaves out, too. Of languages with at least
    CALIBRATED learning rows one text in FOLDS is not counted, and calibrates where it stands in `docs`.
    lang_pred is the language
    of lowest cross-entropy per character (ties: the first by name), or `und`
    for a null text or one without letters, or if nothing was learned; `und`
    rows are rejected and have the score 0. score is the share of the winner
    among the languages' likelihoods over at most 64 characters. A row is
    rejected when its excess entropy is above the winner's cut (`cuts`); a
    language without calibration has the loosest cut of all, and where no
    language is calibrated only `und` rows are rejected. Repeated rows are
    judged each alike.
    """
    spark = bounded_batches(docs.sparkSession)
    # names of languages only: the model has a column for each
    large = [r.lang for r in learning.where("lang IS NOT NULL").groupBy("lang").count().where(F.col("count") >= CALIBRATED).collect()]
    model = learn(learning.where(~(F.col("lang").isin(large) & F.coalesce(_kept_back("text"), F.lit(False)))))
    shared = spark.sparkContext.broadcast(model)
    calibrates = ~held_out & F.col(lang).isin(large) & _kept_back(text)
    given = docs.select(*keep, held_out.alias("held_out"), F.when(calibrates, F.col(lang)).alias("_own"), F.col(text).alias("_text"))
    passed = [f for f in given.schema if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [letters(t) for t in batch.column("_text").to_pylist()]
            best, score, entropy = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            own, rival_entropy, rival = entropy.copy(), entropy.copy(), [None] * len(texts)
            if model is not None:
                number = {name: k for k, name in enumerate(model.langs)}
                h = model.cross_entropy(texts)
                some = np.flatnonzero(~np.isnan(h[:, 0]))
                pick = np.argmin(h[some], axis=1)
                entropy[some] = h[some, pick]
                sizes = np.minimum(np.array([len(texts[i]) for i in some]), 64)[:, None]
                score[some] = 1 / np.exp(-(h[some] - h[some, pick][:, None]) * sizes).sum(axis=1)
                for i, k in zip(some.tolist(), pick.tolist()):
                    best[i] = model.langs[k]
                for i, name in enumerate(batch.column("_own").to_pylist()):
                    if name in number and not np.isnan(h[i, 0]):
                        own[i], h[i, number[name]] = h[i, number[name]], np.inf
                        if len(number) > 1:
                            rival[i], rival_entropy[i] = model.langs[int(np.argmin(h[i]))], h[i].min()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in passed), pa.array(best), pa.array(score),
                 pa.array(entropy, from_pandas=True), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(own, from_pandas=True), pa.array(rival, pa.string()), pa.array(rival_entropy, from_pandas=True)],
                names=[*(f.name for f in passed), "lang_pred", "score", "cross_entropy", "_n", "_entropy", "_rival", "_rival_entropy"])

    scored = materialize(given.mapInArrow(
        run, f"{schema}, lang_pred string, score double, cross_entropy double, _n long, _entropy double, _rival string, "
             "_rival_entropy double"), "language_scores")
    judged = scored.where("_entropy IS NOT NULL").select(
        F.col("_own").alias("lang"), F.col("_entropy").alias("entropy"), F.col("_n").alias("n"),
        F.col("_rival").alias("rival"), F.col("_rival_entropy").alias("rival_entropy"))
    found = cuts(judged)  # a row per language
    named = found.where("lang IS NOT NULL").select(F.col("lang").alias("lang_pred"), F.col("usual").alias("_usual"), F.col("cut").alias("_cut"))
    loosest = found.where("lang IS NULL").select(F.col("usual").alias("_usual2"), F.col("cut").alias("_cut2"))
    rows = scored.join(F.broadcast(named), "lang_pred", "left").join(F.broadcast(loosest), F.lit(True), "left")
    excess = ((F.col("cross_entropy") - F.coalesce("_usual", "_usual2")) * F.sqrt(F.col("_n") / (F.col("_n") + DAMPED)))
    return rows.select(
        *keep, "held_out", "lang_pred", "score", "cross_entropy",
        ((F.col("lang_pred") == "und") | F.coalesce(excess > F.coalesce("_cut", "_cut2"), F.lit(False))).alias("rejected"))
