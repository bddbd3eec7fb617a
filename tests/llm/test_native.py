"""Secret scans and decontamination: derived queries, odd rows, planted cases."""

import re

from pyspark.sql import functions as F

from logrill.llm.decontaminate import MARK, NAME, NUMBER, UNIT, UNITS, leaks, template, words
from logrill.llm.secrets import BASE, MORE, Rule, masked, scan, trigram_query


def holds(query, text):
    return query is None or any(all(t in text.lower() for t in x) for x in query)


def test_queries_hold_for_every_match():
    assert trigram_query("[0-9a-f]{32,}") is None and trigram_query("a|bcd") is None and trigram_query("(abc)*") is None
    assert trigram_query("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert trigram_query("(abc|xyz)+q?") == frozenset([frozenset(["abc"]), frozenset(["xyz"])])
    assert trigram_query("ab[cd]e") == frozenset([frozenset(["abc", "bce"]), frozenset(["abd", "bde"])])
    texts = ["PassWord:abcdefgh", "api_key = x", "APIKEY='y", "AKIA0", "ghp_" + "a" * 36, "xoxb-12345678901",
             "-----BEGIN RSA PRIVATE KEY-----", "secret\"=1", "f" * 40]
    for rule in [*BASE, *MORE]:
        for text in texts:
            if re.search(rule.regex, text):
                assert holds(trigram_query(rule.regex), text), (rule, text)


def test_spans_against_re(spark, odd, empty):
    texts = ["token=token:abcdefgh1 secret = 'short' passwd: longenough", "x é 漢 😀 Token=\"abcdefgh\"", "AKIAABCDEFGHIJKL0 AKIA1 " + "a1" * 20,
             "ſecret=abcdefgh toKen=abcdefgh", None, "", "password=" + "a" * 100_000, "token=abcdefgh " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (0, "AKIA" + "Z" * 20)], "doc_id long, text string")
    found = scan(docs, [*BASE, *MORE])
    for r in found.collect():
        text, want = r["row"]["text"] or "", []
        for n, rule in enumerate([*BASE, *MORE]):
            want += [(m.start(), n, m.end(), rule.kind) for m in re.finditer(rule.regex, text) if len(m[rule.group]) >= rule.least]
        assert [tuple(s) for s in r["spans"]] == sorted(want)
    for r in found.select("row.text", masked(found["row.text"], found["spans"]).alias("m"), "spans").collect():
        text, at, out = r["text"] or "", 0, ""
        for s in r["spans"]:
            if s["start"] >= at:
                out += text[at:s["start"]] + f"[{s['kind']}]"
            at = max(at, s["end"])
        assert (r["m"] or "") == out + text[at:]
    assert scan(odd, BASE).count() == odd.count() and scan(empty, BASE).count() == 0
    assert scan(odd, [Rule("any", "[0-9]+")]).count() == odd.count()


QUESTION = ("A train leaves the old station at 9 km from Paris and then Anna rides 9 km more until the small river; "
            "how far did Anna ride on that day before the sun went down over Paris?")


def test_planted_questions(spark, odd, empty):
    again = QUESTION.replace("9 km", "14 miles").replace("Anna", "Bella").replace("Paris", "Rome")
    mixed_up = QUESTION.replace("9 km", "14 miles", 1).replace("Anna", "Bella", 1).replace("Paris", "Rome", 1).replace("Anna", "Cleo")
    docs = spark.createDataFrame([
        (1, "Some words before. " + QUESTION + " Some after."), (2, again), (3, QUESTION.upper()), (4, "nothing of it is here at all, not a bit"),
        (5, " ".join(QUESTION.split()[:9])), (6, None), (7, ""), (1, QUESTION), (None, QUESTION), (8, mixed_up)], "doc_id long, text string")
    items = spark.createDataFrame([(10, QUESTION), (10, QUESTION), (11, None), (12, "too short"), (13, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaks(docs, items).collect()}
    assert {1, 2} <= set(got) and not {4, 5, 6, 7, None} & set(got)
    assert got[1]["share"] == 1.0 and got[1]["slots_equal"] and not got[2]["slots_equal"] and got[2]["share"] == 1.0
    assert 8 not in got or got[8]["share"] < 1.0
    sized = {r["doc_id"] for r in leaks(docs, items, small_windows=0).collect()}
    assert sized == set(got)
    assert leaks(odd, items).count() == leaks(empty, items).count() == leaks(docs, items.limit(0)).count() == 0


def _items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_two_copies_in_one_document(spark):
    item = "Tom had 3 red apples and gave 7 green pears to all of his 3 old friends near the wide river before 7 o'clock"

    def other(three, seven):
        return item.replace("3", three).replace("7", seven)

    docs = spark.createDataFrame([
        (1, item + ". Then: " + other("5", "2")), (2, other("8", "4") + ". " + other("5", "2")), (3, other("5", "2") + ". " + other("8", "4") + ". " + item),
        (4, other("8", "4").replace("and gave", "and then gladly gave") + ". " + other("5", "2").replace("and gave", "and then gladly gave")),
        (5, other("8", "4")), (5, other("5", "2"))], "doc_id long, text string")
    got = {r["doc_id"]: (r["share"], r["slots_equal"]) for r in leaks(docs, _items(spark, item)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1] == got[3] == (1.0, True) and got[2] == got[5] == (1.0, False) and got[4][0] >= 0.5


def test_items_without_a_window(spark):
    items = _items(spark, "What is the capital of France?", "12 + 7 = 19, 8 * 3 = 24, 4 + 4 = 8 and 9 - 2 = 7", "小明有三个苹果，他又买了五个苹果。", "too short")
    docs = spark.createDataFrame([
        (1, "Q: what is the Capital of France? A: Paris"), (2, "so 12 + 7 = 19, 8 * 3 = 24, 4 + 4 = 8 and 9 - 2 = 7 it was"), (3, "题目小明有三个苹果，他又买了五个苹果。问"),
        (4, "What is the capital of Spain, or of France? 12 + 7 = 19, 8 * 3 = 24, 4 + 4 = 8 and 9 - 2 = 6"), (5, "小明有三个苹果，他又买了四个苹果。"), (6, None),
        (None, "too short")], "doc_id long, text string")
    for small in (0, 1000):
        got = leaks(docs, items, small_windows=small).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 0), (2, 1), (3, 2)]
        assert all(r["share"] == 1.0 and r["slots_equal"] for r in got)


def test_items_of_a_word_or_two_count_only_by_themselves(spark):
    """An item "Yes" is no leak wherever the word stands, but it is one as a document, a line or a sentence."""
    docs = [(i, f"Some text number {i} says yes, and yes again, in a sentence of its own.") for i in range(20)]
    docs += [(100, " yes\n"), (101, "a line\nYes\nanother"), (102, "Is it so? Yes. Good"), (103, "yes no"), (104, ""), (105, None)]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), _items(spark, "Yes", "No way")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(100, 0), (101, 0), (102, 0)]


def test_long_verbatim_passage(spark):
    item = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100))
    words = item.split()
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[40:53]) + " z"), (2, "x y " + " ".join(words[40:52]) + " z"), (3, " ".join(words[:13])),
                                  (4, " ".join(words[-13:]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_windows"], r["n_item_windows"]) for r in leaks(docs, _items(spark, item)).collect()}
    assert got == {1: (6, 93), 3: (6, 93), 4: (6, 93)}


def test_template_words_of_odd_texts(spark):
    """Capitals beyond 16 bits, names and units at the edges; and the list of units is searched after numbers only."""
    texts = ["He met Anna in Rome, Bob left. Carla (Dora) 5 km; km Eva 12 Kg G 3 %", "\U00010400\U00010428 x \U00010400\U00010428 a \U0001D400b",
             "x Ä ä Äb \U00010428 Äb 1 Äb,Äb, Äb", "", "Anna", " Anna", "7 C c", None, "1 2 km km 3.5 mi. 4\nKM"]
    marked = F.regexp_replace("text", r"(?<=[\p{L}\d,;)]\x20)(\p{Lu}\p{Ll})", MARK + "$1")
    raw = F.regexp_extract_all(marked, F.lit(rf"\d+(?:[.,]\d+)*|{MARK}?\p{{L}}+|[%$€£]"), F.lit(0))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(words(F.col("text")).alias("raw"), raw.alias("want"))
    for r in docs.withColumn("form", template(F.col("raw"))).collect():
        assert r["raw"] == r["want"]
        if r["raw"] is None:
            continue
        digit = [w[0] in "0123456789" for w in r["raw"]]
        assert r["form"] == [NUMBER if d else UNIT if w.lower() in UNITS and k and digit[k - 1] else NAME if w[0] == MARK else w.lower()
                             for k, (w, d) in enumerate(zip(r["raw"], digit))]
    plan = docs.select(template(F.col("raw")))._jdf.queryExecution().analyzed().toString()
    assert plan.index("get(raw") < plan.index("array_contains(array(mm")
