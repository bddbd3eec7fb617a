"""Benchmark decontamination by template windows, in DataFrame operations only.

Words are canonicalised to a template: numbers, units after a number and names
inside a sentence become typed placeholders, other words are lower-cased. Every
window of `width` template words is hashed; windows of documents meet those of
benchmark items in a hash join. A question that is asked again with other
numbers or names keeps its template, so its windows meet, too. A window counts
only if its slots are consistent: wherever the item repeats a value the document
repeats one, the other way round, and in all windows of one copy alike. Items
that have no window to count are looked for as a whole, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrill.session import materialize

#: Unit words, which count as units right after a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec min h hr hrs ms kb mb gb tb w kw hz khz mhz ghz "
         "v mph kmh c f k usd eur gbp percent % $ € £ inches feet miles meters metres grams kilograms pounds liters litres "
         "seconds minutes hours days weeks months years dollars euros cents degrees").split()
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
#: Scripts without spaces between words.
UNSPACED = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))


MARK = "\uE000"  # stands before a name until it is replaced; no letter


def words(text: Column) -> Column:
    """Array of the text's words as they stand: numbers with their decimals, else stretches of letters, or one sign.

    A name has MARK before it: a capital and a small letter after a letter,
    digit, comma, semicolon or bracket and one space, so not where a sentence
    or a line begins.
    """
    # the look ahead changes nothing but the order: most places are no capital, and what stands before them is not read
    marked = F.regexp_replace(text, r"(?=\p{Lu})(?<=[\p{L}\d,;)]\x20)(\p{Lu}\p{Ll})", MARK + "$1")
    return F.regexp_extract_all(marked, F.lit(rf"\d+(?:[.,]\d+)*|{MARK}?\p{{L}}+|[%$€£]"), F.lit(0))


def template(raw: Column) -> Column:
    """The template word of each word."""
    units = F.array(*map(F.lit, UNITS))

    def number(word):
        return word.between("0", "9~")  # words begin with a digit, a letter, a sign or the mark

    def one(word, i):
        low = F.lower(word)
        return (F.when(number(word), NUMBER)
                # few words come after a number, so the list of units is hardly ever searched
                .when(F.coalesce(number(F.get(raw, i - 1)), F.lit(False)) & F.array_contains(units, low), UNIT)
                .when(F.startswith(word, F.lit(MARK)), NAME).otherwise(low))

    return F.transform(raw, one)


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row, also where a later expression reads it for each element."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def _windows(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, raw, form and hashes: the hash of each window of template words; a text with fewer words has none."""
    spread = _computed(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_whole")), "raw", words(F.col("_whole")))
    spread = _computed(spread.where(F.size("raw") >= width).select(key, "raw"), "form", template(F.col("raw")))
    spread = _computed(spread, "each", F.transform("form", lambda w: F.xxhash64(w)))
    window = F.transform(F.sequence(F.lit(0), F.size("form") - width), lambda i: F.xxhash64(
        *(F.get(F.col("each"), i + n) for n in range(width))))
    return spread.select(key, "raw", "form", window.alias("hashes"))


def _slots(raw: Column, form: Column) -> Column:
    """The values that stand at placeholders, in order."""
    return F.transform(F.filter(F.arrays_zip(raw.alias("r"), form.alias("f")), lambda x: x["f"].isin(NUMBER, UNIT, NAME)), lambda x: F.lower(x["r"]))


def _mappings(pairs: DataFrame, key: str, item: str, width: int) -> DataFrame:
    """Each met window once per mapping `m` of the item's values that it may belong to.

    A mapping is looked for in each alignment (position in the document less
    position in the item, kind 0), in alignments at most `width` apart (1: a copy
    with words put in or left out) and in the whole document (2); the item's own
    values are one, too (3).
    """
    order = Window.partitionBy(key, item, "_copy").orderBy("_shift")
    pairs = pairs.withColumn("_new", F.coalesce(F.col("_shift") - F.lag("_shift").over(order) > width, F.lit(True)).cast("int"))
    pairs = pairs.withColumn("_near", F.sum("_new").over(order))

    def option(kind: int, copy: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), copy.cast("long").alias("copy"), at.cast("long").alias("at"))

    options = F.array(option(0, F.col("_copy"), F.col("_shift")), option(1, F.col("_copy"), F.col("_near")), option(2, F.lit(0), F.lit(0)),
                      F.when(F.col("slots") == F.col("d_slots"), option(3, F.lit(0), F.lit(0))))
    return (pairs.select(key, item, F.explode(options).alias("m"), "hash", "slots", "d_slots", "both", "run").where("m IS NOT NULL")
            .groupBy(key, item, "m", "hash", "slots", "d_slots", "both").agg(F.max("run").alias("run")))


def _plain_words(text: Column) -> Column:
    """Lower-case words; a letter of a script written without spaces is a word of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\d+(?:[.,]\d+)*|[{UNSPACED}]|[\p{{L}}&&[^{UNSPACED}]]+|[%$€£]"), F.lit(0))


def _in_a_row(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, width: int, small_windows: int) -> DataFrame:
    """(key, item) where all words of the item (item, words) stand in the document, one after another.

    The first words, at most `width`, meet in a hash join for each such number
    in use; of the document's words as many as the longest item with that
    beginning has are cut out and compared.
    """
    def start(n: int) -> Column:
        return F.xxhash64(F.lit(n), *(F.get(F.col("each"), F.col("at") + i) for i in range(n)))

    items = items.withColumn("n", F.least(F.size("words"), F.lit(width)))
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most `width`
    if not sizes:
        return None
    hashed = items.withColumn("each", F.transform("words", lambda w: F.xxhash64(w))).withColumn("at", F.lit(0))
    cases = None
    for n in sizes:
        cases = F.when(F.col("n") == n, start(n)) if cases is None else cases.when(F.col("n") == n, start(n))
    asked = hashed.select(item, "words", cases.alias("hash"))
    longest = asked.groupBy("hash").agg(F.max(F.size("words")).alias("longest"))
    if longest.count() <= small_windows:
        longest = F.broadcast(longest)
    spread = _computed(docs.where(F.col(key).isNotNull()).select(key, F.coalesce(F.col(text), F.lit("")).alias("_whole")),
                       "words", _plain_words(F.col("_whole"))).where(F.size("words") > 0).select(key, "words")
    spread = _computed(spread, "each", F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.flatten(F.array(*(F.when(F.size("each") >= n, F.transform(
        F.sequence(F.lit(0), F.size("each") - n), lambda i: F.struct(i.alias("at"), F.xxhash64(
            F.lit(n), *(F.get(F.col("each"), i + k) for k in range(n))).alias("hash")))).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>")) for n in sizes)))
    met = spread.select(key, "words", F.explode(starts).alias("s")).select(key, "words", "s.at", "s.hash").join(longest, "hash")
    met = met.select(key, "hash", F.slice("words", F.col("at") + 1, F.col("longest")).alias("d_words")).distinct()
    return (met.join(asked, "hash").where(F.slice("d_words", F.lit(1), F.size("words")) == F.col("words"))
            .select(key, item).distinct())


def _as_a_part(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, few: int) -> DataFrame:
    """(key, item) where the item (item, words; fewer than `few`) is the whole document, a line or a sentence of it."""
    held = F.coalesce(F.col(text), F.lit(""))
    parts = F.concat(F.array(held), F.split(held, r"[\r\n]+"), F.split(held, r"[\r\n.!?\u3002\uFF01\uFF1F]+"))
    spread = docs.where(F.col(key).isNotNull()).select(key, F.explode(parts).alias("_part"))
    spread = _computed(spread, "words", _plain_words(F.col("_part"))).where((F.size("words") > 0) & (F.size("words") < few))
    return spread.select(key, "words").distinct().join(items.select(item, "words"), "words").select(key, item).distinct()


def _whole(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, width: int, few: int,
           small_windows: int) -> DataFrame | None:
    """(key, item) for items without a countable window, or None where there are none."""
    sizes = [r["short"] for r in items.select((F.size("words") < few).alias("short")).distinct().collect()]  # at most two
    found = []
    if False in sizes:
        found.append(_in_a_row(docs, items.where(F.size("words") >= few), key, text, item, width, small_windows))
    if True in sizes:
        found.append(_as_a_part(docs, items.where(F.size("words") < few), key, text, item, few))
    return found[0].union(found[1]) if len(found) == 2 else found[0] if found else None


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", width: int = 8, fixed: int = 4, share: float = 0.5,
          small_windows: int = 1_000_000, verbatim: int = 13, few: int = 5) -> DataFrame:
    """(key, item, n_windows, n_item_windows, share, slots_equal): documents that hold an item or its template.

    An item is held if at least `share` of its distinct windows stand in the
    document with consistent slots: under one mapping of the item's values to
    the document's, which one copy in the document, or all of it, suggests; that
    with most windows counts. Windows with fewer than `fixed` words that are no
    placeholder, and with fewer than three distinct ones, do not count; an item
    without any other window is held where all its words stand one after
    another, or, if they are fewer than `few`, where they are the whole
    document or a line or sentence of it, and has one window then. `verbatim` words of
    an item as they stand are a leak, too, whatever their share, if a window
    that counts is among them. slots_equal says whether all slot values agree,
    too. Nulls and empty texts hold nothing; rows of a
    repeated key count as one document, repeated items as one. The benchmark's
    windows are broadcast only if there are at most `small_windows`.
    """
    def sides(raw: str) -> list[Column]:
        """The words before a window, the nearest first, and those after it, as many as a verbatim run may have."""
        more = max(verbatim - width, 0)
        bare = [F.reverse(F.slice(raw, F.greatest(F.col("at") + 1 - more, F.lit(1)), F.least(F.col("at"), F.lit(more)))),
                F.slice(raw, F.col("at") + 1 + width, more)]
        return [F.transform(b, lambda w: F.lower(F.ltrim(w, F.lit(MARK)))) for b in bare]

    def alike(a: str, b: str) -> Column:
        return sum(((F.slice(a, 1, n) == F.slice(b, 1, n)) & (F.size(a) >= n)).cast("int") for n in range(1, verbatim - width + 1)) \
            if verbatim > width else F.lit(0)

    benchmark = benchmark.where(F.col(item).isNotNull()).select(item, F.coalesce(F.col(item_text), F.lit("")).alias("_text")).distinct()
    benchmark = benchmark.withColumn("who", F.struct(F.col(item).alias("id"), F.xxhash64("_text").alias("text")))
    asked = _windows(benchmark, "who", "_text", width).select("who", "raw", "form", F.posexplode("hashes").alias("at", "hash"))
    form, raw = (F.slice(c, F.col("at") + 1, width) for c in ("form", "raw"))
    asked = asked.select("who", "hash", "at", *(c.alias(n) for n, c in zip(("before", "after"), sides("raw"))), form.alias("form"), raw.alias("raw"))
    plain = F.filter("form", lambda w: ~w.isin(NUMBER, UNIT, NAME))
    asked = materialize(asked.where((F.size(plain) >= fixed) & (F.size(F.array_distinct(plain)) >= 3)), "leak_items")
    uncounted = benchmark.join(asked.select("who"), "who", "left_anti").select(item, _plain_words(F.col("_text")).alias("words"))
    asked = asked.withColumn(item, F.col("who.id")).groupBy(item, "hash").agg(
        F.min(F.struct("form", "raw", "at", "before", "after")).alias("w")).select(
        item, "hash", "w.form", _slots(F.col("w.raw"), F.col("w.form")).alias("slots"), "w.at", "w.before", "w.after")
    counts = asked.groupBy(item).agg(F.count("*").alias("n_item_windows"))
    hashes = asked.select("hash").distinct()
    if hashes.count() <= small_windows:
        hashes = F.broadcast(hashes)
    named = docs.where(F.col(key).isNotNull()).select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("text")).alias("who"), F.col(text).alias("_text"))
    texts = _windows(named, "who", "_text", width)
    # first the bare hashes meet; the words of a window are cut out only where it met
    met = texts.select("who", "raw", "form", F.posexplode("hashes").alias("at", "hash")).join(hashes, "hash", "left_semi")
    met = met.select(F.col("who.id").alias(key), F.col("who.text").alias("_copy"), "hash", F.col("at").alias("d_at"),
                     F.slice("form", F.col("at") + 1, width).alias("d_form"), F.slice("raw", F.col("at") + 1, width).alias("d_raw"),
                     *(c.alias(n) for n, c in zip(("d_before", "d_after"), sides("raw"))))
    met = met.withColumn("d_slots", _slots(F.col("d_raw"), F.col("d_form"))).drop("d_raw")
    pairs = met.join(asked, "hash").where(F.col("d_form") == F.col("form"))
    # consistent in a window: equal slots of the item have equal values in the document, and the other way round
    both = F.array_distinct(F.arrays_zip(F.col("slots").alias("i"), F.col("d_slots").alias("d")))
    run = (F.col("slots") == F.col("d_slots")) & (F.lit(width) + alike("before", "d_before") + alike("after", "d_after") >= verbatim)
    pairs = pairs.select(key, item, "_copy", (F.col("d_at") - F.col("at")).alias("_shift"), "hash", "slots", "d_slots", both.alias("both"), run.alias("run")).where(
        (F.size(F.array_distinct("slots")) == F.size("both")) & (F.size(F.array_distinct("d_slots")) == F.size("both")))
    # read twice, and few: the windows of documents that an item has, too
    pairs = materialize(_mappings(pairs, key, item, width), "leak_windows")
    # and over all windows of a mapping: each value of the item stands for the value it meets most often (ties: the last)
    votes = pairs.select(key, item, "m", F.explode("both").alias("b")).groupBy(key, item, "m", "b.i", "b.d").agg(F.count("*").alias("n"))
    meant = votes.groupBy(key, item, "m", "i").agg(F.max(F.struct("n", "d")).alias("best"))
    meant = meant.groupBy(key, item, "m").agg(F.map_from_entries(F.collect_list(F.struct("i", "best.d"))).alias("meant"))
    agreed = pairs.join(meant, [key, item, "m"], "left").where(F.forall("both", lambda b: F.col("meant")[b["i"]] == b["d"]))
    held = (agreed.groupBy(key, item, "m", "hash").agg(F.max(F.col("slots") == F.col("d_slots")).alias("same"), F.max("run").alias("run"))
            .groupBy(key, item, "m").agg(F.count("*").alias("n_windows"), F.min("same").alias("slots_equal"), F.max("run").alias("run"))
            .groupBy(key, item).agg(F.max(F.struct("n_windows", "slots_equal")).alias("best"), F.max("run").alias("run")))
    held = (held.join(counts, item).withColumn("share", F.col("best.n_windows") / F.col("n_item_windows"))
            .where((F.col("share") >= share) | F.col("run"))
            .select(key, item, "best.n_windows", "n_item_windows", "share", "best.slots_equal"))
    whole = _whole(docs, uncounted.where(F.size("words") > 0), key, text, item, width, few, small_windows)
    if whole is None:
        return held
    one = F.lit(1).cast("long")
    whole = whole.select(key, item, one.alias("n_windows"), one.alias("n_item_windows"), F.lit(1.0).alias("share"), F.lit(True).alias("slots_equal"))
    return held.union(whole).groupBy(key, item).agg(F.max(F.struct("share", "n_windows", "n_item_windows", "slots_equal")).alias("w")).select(
        key, item, "w.n_windows", "w.n_item_windows", "w.share", "w.slots_equal")
