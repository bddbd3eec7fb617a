"""Language, quality and toxicity: held-out accuracy, direct computations, odd rows."""

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logrill.llm.common import fold
from logrill.llm.language import cuts, identify, learn, letters
from logrill.llm.quality import features, fit, score, train
from logrill.llm.toxicity import Lexicon, Scorer, learn_lexicon, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    q = entry.queries()
    lang = q["op2_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.98 * lang.count()
    assert lang.where("rejected").count() <= 0.01 * lang.count()
    for name, label in (("op5_quality", "quality"), ("op8_toxicity", "toxic")):
        rows = q[name](spark, SF).join(labels, "doc_id").where("held_out").collect()
        right = sum(r["predicted"] == r[label] for r in rows)
        assert right >= 0.85 * len(rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_kneser_ney_by_definition(spark):
    texts = [("aa", "abab abba bab"), ("aa", "abba"), ("bb", "bcbc cbbc"), ("bb", "ccb")]
    model = learn(spark.createDataFrame(texts, "lang string, text string"))
    grams = {lang: Counter() for lang in ("aa", "bb")}
    for lang, text in texts:
        t = "   " + letters(text)
        grams[lang].update(t[k:k + 4] for k in range(len(t) - 3))
    counts = [{(x, g): n for x, c in grams.items() for g, n in c.items()}]
    for _ in range(3):
        tails = Counter((x, g[1:]) for x, g in counts[-1])
        counts.append(dict(tails))
    discounts = []
    for c in counts:
        discounts.append({})
        for lang in ("aa", "bb"):
            once, twice = (sum(v == n for (x, _), v in c.items() if x == lang) for n in (1, 2))
            discounts[-1][lang] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    alphabet = len({g[-1] for _, g in counts[0]}) + 1

    def p(lang, gram):
        if not gram:
            return 1 / alphabet
        c, d = counts[4 - len(gram)], discounts[4 - len(gram)][lang]
        around = [n for (x, g), n in c.items() if x == lang and g[:-1] == gram[:-1]]
        if not around:
            return p(lang, gram[1:])
        return max(c.get((lang, gram), 0) - d, 0) / sum(around) + d * len(around) / sum(around) * p(lang, gram[1:])

    some = ["abba", "bcb xyz", "q"]
    h = model.cross_entropy([letters(t) for t in some])
    for i, text in enumerate(some):
        t = "   " + letters(text)
        for j, lang in enumerate(model.langs):
            want = -sum(math.log(p(lang, t[k:k + 4])) for k in range(len(t) - 3)) / (len(t) - 3)
            assert abs(h[i, j] - want) < 1e-4


def test_odd_rows(spark, odd, empty):
    held, off = fold("doc_id", 4, 2), F.lit(False)
    got = identify(odd, odd.where("lang IS NOT NULL"), held, ["doc_id", "text"]).collect()
    assert len(got) == odd.count()
    for r in got:
        if not letters(r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in ("en", "fr") and 0 < r["score"] <= 1
    assert {r["lang_pred"] for r in identify(odd, odd.where("false"), off, ["doc_id"]).collect()} == {"und"}
    assert identify(empty, empty, off, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (4, 1, None), (9, 0, 1), (9, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.where("false"), labels.where("quality = 1")):
        assert score(odd.withColumn("held_out", held), train(odd, marks, "quality", held), ["doc_id", "held_out"]).count() == odd.count()
        assert toxicity(odd.withColumn("held_out", held), marks, held, ["doc_id"]).count() == odd.count()
    assert toxicity(empty, labels, off, ["doc_id"]).count() == 0
    assert score(empty, train(empty, labels, "quality", off), ["doc_id"]).count() == 0


def test_features_are_those_of_each_text_alone():
    texts = ["", "one two two", "Ünï  cödé\n!", "a" * 300]
    bucket, bounds = features(texts)
    for k, text in enumerate(texts):
        alone, _ = features([text])
        assert sorted(bucket[bounds[k]:bounds[k + 1]]) == sorted(alone) and len(alone)


def test_descent_separates():
    rows = [(k % 2, np.array([k % 2, 2 + k % 5], np.int32).tobytes(), np.array([0.5, 0.5], np.float32).tobytes()) for k in range(200)]
    logit = fit(rows)
    assert logit[1] > 0 > logit[0]


def test_automaton_against_distances():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _step(row, i, x, b)
        return row[-1]

    def _step(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    terms = {"idiot": 3.0, "worthless": 2.5, "scum": 2.0, "réeux*": 1.0}
    lexicon = Lexicon(terms, states=40)
    words = ["idiot", "idoit", "idit", "idiots", "xidiot", "worthles", "wrthles", "worthlesss", "scum", "scums", "réeuxpa", "éréeuxpa", "the", ""]
    for word in words:
        want = [(distance(word, t), -w, t) for t, w in terms.items() if not t.endswith("*")
                and distance(word, t) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
        want += [(0, -w, t) for t, w in terms.items() if t.endswith("*") and word.startswith(t[:-1])]
        found = lexicon.match(word)
        assert (found[1], found[0]) == (min(want)[0], min(want)[2]) if want else found is None


def test_quotation_lowers():
    scorer = Scorer(Lexicon({"idiot": 3.0}))
    plain, quoted, reported = (scorer.features(t) for t in ("you idiot there", 'the "idiot" there', "she said idiot there"))
    assert plain[0] > 0 and plain[4] > 0 and quoted[0] == 0 < quoted[2] and reported[0] == 0 < reported[3]


def test_rare_terms_stay_in_the_lexicon(spark):
    rows = spark.range(22_000).select(
        F.concat(F.lit("you "), F.when(F.col("id") < 8, "zarquon").when(F.col("id") < 2_000, "idiot").otherwise("friend"), F.lit(" "), F.col("id")).alias("text"),
        (F.col("id") < 2_000).cast("int").alias("label"))
    found = learn_lexicon(rows)
    assert {"zarquon", "idiot"} <= set(found) and not {"you", "friend"} & set(found)
    copies = rows.where("text NOT LIKE '%zarquon%'").union(spark.range(8).select(F.lit("you zarquon 1"), F.lit(1)))
    assert "zarquon" not in learn_lexicon(copies)


def test_misspellings_of_words_with_a_stem(spark):
    rows = spark.range(1_200).select(
        F.concat(F.lit("you "), F.when(F.col("id") >= 600, "friend").otherwise(F.element_at(F.array(*map(F.lit, ("idiot", "idiots", "idiotic"))), (F.col("id") % 3 + 1).cast("int"))),
                 F.lit(" "), F.col("id")).alias("text"), (F.col("id") < 600).cast("int").alias("label"))
    found = learn_lexicon(rows)
    assert {"idiot", "idiots", "idiotic", "idio*"} <= set(found)
    lexicon = Lexicon(found)
    assert [lexicon.match(w) and lexicon.match(w)[1] for w in ("idot", "iddiot", "idiot", "idiotically", "friend")] == [1, 1, 0, 0, None]
    both = Lexicon({"idiot": 3.0, "idiot*": 2.0})
    assert both.match("idiot") == ("idiot", 0) and both.match("idiotenfest") == ("idiot*", 0) and both.match("idot") == ("idiot", 1)


def test_a_large_language_costs_a_small_one_nothing(spark):
    def random_letters(batches):
        for batch in batches:
            for k in batch["id"]:
                drawn = np.random.default_rng(k).integers(0x4E00, 0x9FA5, 100_000).astype(np.uint32)
                yield pd.DataFrame({"lang": ["yy"], "text": [drawn.tobytes().decode("utf-32-le")]})

    large = spark.range(42).mapInPandas(random_letters, "lang string, text string")  # more than 4 million distinct 4-grams
    small = spark.createDataFrame([("zz", "einmal und nie wieder")], "lang string, text string")
    model = learn(large.union(small))
    assert model.langs == ["yy", "zz"]
    h = model.cross_entropy([letters("einmal")])
    assert h[0, 1] < h[0, 0]


def test_a_small_language_has_its_own_discounts(spark):
    small = spark.createDataFrame([("aa", "abab abba bab bb ab ba abaab")], "lang string, text string")
    large = spark.createDataFrame([("bb", "abab " * 50 + "ab ba b a"), ("bb", "bab bab baab")], "lang string, text string")
    alone, beside = learn(small), learn(small.union(large))
    some = [letters("abab abba bab bb ab ba abaab")]
    assert abs(alone.cross_entropy(some)[0, 0] - beside.cross_entropy(some)[0, 0]) < 1e-6  # same letters, so the same floor


def test_rejection_is_calibrated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    held = fold("doc_id", 4, 2)
    noise = spark.createDataFrame([(-1, None, "qqxz zzkk vvww"), (-2, None, "xq zvk jjw qpx " * 20)], docs.schema)
    for unlearned in ("de", "fr"):  # not English: documents of other languages hold English passages
        got = identify(docs.union(noise), docs.where(~held & F.col("lang").isNotNull() & (F.col("lang") != unlearned)),
                       held | (F.col("lang") == unlearned) | (F.col("doc_id") < 0), ["doc_id", "lang"]).cache()
        learned, foreign = got.where((F.col("lang") != unlearned) & F.col("held_out")), got.where(F.col("lang") == unlearned)
        assert learned.where("rejected").count() <= 0.005 * learned.count()
        assert foreign.where("rejected").count() >= 0.9 * foreign.count()
        assert got.where("doc_id < 0 AND rejected").count() == 2


def test_cuts_by_quantiles(spark):
    rows = [("aa", 2.0 + (k - 50) / 1000, 10**6, "bb", 6.0 + k / 1000) for k in range(101)]
    rows += [("bb", 3.0, 10**6, None, None)] * 3
    got = {r.lang: (r.usual, r.cut) for r in cuts(spark.createDataFrame(rows, "lang string, entropy double, n long, rival string, rival_entropy double")).collect()}
    assert abs(got["aa"][0] - 2.0) < 1e-9 and abs(got["aa"][1] - (0.05 + 0.25)) < 0.02  # no text falls to aa
    assert abs(got["bb"][1] - (0.0 + 3.0) / 2) < 0.02  # midway to texts of aa that fall to bb
    assert got[None] == (3.0, got["bb"][1])
