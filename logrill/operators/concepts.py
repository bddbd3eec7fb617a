"""Free-text topics: their words, programs and counts; checks of claimed numbers."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.functions.clock import col
from logrill.functions.matching import contains_join
from logrill.operators.search import in_range
from logrill.session import materialize

# ---- fixed values: words that name no topic ----
GENERIC_QUESTION_WORDS = (
    "most", "top", "which", "who", "whose", "device", "devices", "vendor", "vendors",
    "highest", "worst", "busiest", "active", "noisiest", "the", "a", "an", "is", "for",
    "with", "by", "of", "has", "have", "give", "me", "what", "show", "and", "to", "in", "that",
    "how", "many", "much", "count", "number", "total", "events", "happened", "occur",
    "occurred", "there", "were", "was", "did", "logs",
    "today", "yesterday", "tomorrow", "week", "month", "year", "this", "last", "next", "ago",
    "right", "now", "currently", "presently", "actually", "really", "just",
    "simply", "basically", "immediately", "still", "please", "overall",
    "same", "before", "after", "date", "dates",
)
GENERIC_MESSAGE_WORDS = (
    "wlan", "wlan1", "wlan2", "info", "debug", "warning", "error", "notice", "the", "and",
    "for", "with", "from", "data", "device", "unknown", "that", "this", "received", "link",
    "sent", "send", "message", "event",
    "vendor", "hostname", "severity", "program", "category", "source", "anomaly",
)
PLACEHOLDERS = ("none", "null", "n/a", "na", "unknown", "any", "unset", "*", "all", "")
COUNT_CLAIM_PATTERN = (
    r"(\d[\d,]*)\D{0,20}?(?:events?|logs?|log lines?|lines?|entries|occurrences?|times?)\b"
    r"|(?:events?|logs?|log lines?|lines?|entries|count(?:ed)?|total(?:\s+of)?)\D{0,12}?(\d[\d,]*)"
)
REQUESTED_LIMIT_PATTERN = r"\b(?:top|first|last|give me|show me)\s+(\d{1,4})\b"
# ---- end of fixed values ----


def _words_of(c, pattern):
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def concept_words(c):
    """Topic words of a question: four letters or more, no scaffolding."""
    generic = F.array(*[F.lit(w) for w in GENERIC_QUESTION_WORDS])
    return F.filter(_words_of(F.lower(col(c)), "[a-z']+"),
                    lambda w: (F.length(w) >= 4) & ~F.array_contains(generic, w))


def phrase_concept(phrases: DataFrame, phrase: str = "text") -> DataFrame:
    words = concept_words(phrase)
    return phrases.withColumn("concept", F.nullif(F.array_join(words, " "), F.lit("")))


def concept_tokens(hits: DataFrame, vendors: DataFrame, programs: DataFrame) -> DataFrame:
    """Candidate keywords of each topic, best first.

    hits: (query_id, question, doc_id, message), the few retrieved for a topic.
    A word counts once per message and needs a third of them; words inside a
    vendor or program name give way to others, and words that share their first
    four letters with the question are preferred, if need be at a lower count.
    """
    generic = F.array(*[F.lit(w) for w in GENERIC_MESSAGE_WORDS])
    words = F.array_distinct(F.transform(_words_of(col("message"), "[A-Za-z][A-Za-z']{3,}"), lambda w: F.lower(w)))
    size = hits.groupBy("query_id").agg(F.count("*").alias("_hits"), F.first("question").alias("question"))
    counts = hits.select("query_id", F.explode(F.filter(words, lambda w: ~F.array_contains(generic, w))).alias("word")
                         ).groupBy("query_id", "word").agg(F.count("*").alias("document_frequency"))
    counts = materialize(counts, "words")  # words of the few messages a search returned
    distinct = counts.select("word").distinct()
    inside = contains_join(distinct, "word", programs.select("program").distinct(), "program").select("word")
    entities = inside.unionByName(distinct.join(
        vendors.select(F.lower("vendor").alias("word")), "word", "left_semi")).distinct().withColumn("_entity", F.lit(True))
    stems = F.transform(F.filter(_words_of(F.lower("question"), "[a-z]+"), lambda w: F.length(w) >= 4),
                        lambda w: F.substring(w, 1, 4))
    rows = counts.join(size, "query_id").join(entities, "word", "left").withColumns({
        "_real": F.col("_entity").isNull(),
        "_stem": F.array_contains(stems, F.substring("word", 1, 4)),
        "_often": F.col("document_frequency") >= F.greatest(F.lit(2), F.floor((F.col("_hits") + 2) / 3)),
        "_twice": F.col("document_frequency") >= 2,
    })
    topic = Window.partitionBy("query_id")  # the words of a handful of messages

    def some(condition):
        return F.coalesce(F.max(condition.cast("int")).over(topic) == 1, F.lit(False))

    often = F.col("_often") & (F.col("_real") | ~some(F.col("_often") & F.col("_real")))
    twice = F.col("_twice") & (F.col("_real") | ~some(F.col("_twice") & F.col("_real")))
    rows = rows.withColumns({"_a": often, "_b": twice})
    stem_a, stem_b = F.col("_a") & F.col("_stem"), F.col("_b") & F.col("_stem")
    rows = rows.withColumn("_keep", F.when(some(stem_a), stem_a).when(some(stem_b), stem_b).otherwise(F.col("_a")))
    rows = rows.withColumn("_any", some(F.col("_often"))).where(F.col("_keep") & F.col("_any"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("document_frequency"), "word"))
    return rows.select("query_id", "word", "document_frequency", place.alias("place"))


def significant_programs(hits: DataFrame, min_share: float = 0.2, n: int = 3) -> DataFrame:
    """Programs that hold a fair share of a topic's hits."""
    counts = hits.where(F.coalesce("program", F.lit("")) != "").groupBy("query_id", "program").agg(
        F.count("*").alias("hit_count"))
    topic = Window.partitionBy("query_id")
    ranked = counts.withColumns({
        "share": F.col("hit_count") / F.sum("hit_count").over(topic),
        "place": F.row_number().over(topic.orderBy(F.desc("hit_count"), "program"))})
    return ranked.where((F.col("place") <= n) & (F.col("share") >= min_share))


def _scope(hits: DataFrame, vendors: DataFrame, programs: DataFrame) -> DataFrame:
    """(query_id, keyword, program, vendor): what to count for each topic; null
    vendor for any."""
    keyword = concept_tokens(hits, vendors, programs).where("place = 1").select(
        "query_id", F.col("word").alias("keyword"))
    questions = hits.select("query_id", "question").distinct()
    found = significant_programs(hits).select("query_id", "program")
    # programs the question names a part of
    words = questions.select("query_id", F.explode(F.array_distinct(concept_words("question"))).alias("_w"))
    named = contains_join(words, "_w", programs.select("program").distinct(), "program").select(
        "query_id", "program").distinct()
    shares = hits.where(F.coalesce("program", F.lit("")) != "").groupBy("query_id", "program").agg(
        F.count("*").alias("_n"))
    shares = shares.withColumn("_share", F.col("_n") / F.sum("_n").over(Window.partitionBy("query_id")))
    dominant = shares.where("_share >= 0.5").join(named, ["query_id", "program"], "left_anti").select(
        "query_id").distinct().withColumn("_dominated", F.lit(True))
    named = named.join(dominant, "query_id", "left").join(
        shares.select("query_id", "program", "_n"), ["query_id", "program"], "left").where(
        F.col("_dominated").isNull() | F.col("_n").isNotNull()).select("query_id", "program")
    scoped = found.unionByName(named).distinct()
    # a topic without any program looks at all of them
    every = programs.agg(F.collect_set("program").alias("p")).scalar()  # names only
    bare = keyword.join(scoped, "query_id", "left_anti").select("query_id", F.explode(every).alias("program"))
    scoped = scoped.unionByName(bare)
    mentioned = questions.select("query_id", F.explode(F.transform(
        F.split("question", r"\s+"), lambda w: F.lower(F.regexp_replace(w, "^[.,!?;:]+|[.,!?;:]+$", "")))).alias("_v"))
    asked = vendors.where(~F.lower("vendor").isin(*PLACEHOLDERS)).select("vendor", F.lower("vendor").alias("_v")).join(
        mentioned, "_v").select("query_id", "vendor").distinct()
    # a few rows per topic; written so that the events meet a table, not this plan
    return materialize(keyword.join(scoped, "query_id").join(asked, "query_id", "left"), "scope")


def _matching(events: DataFrame, scope: DataFrame) -> DataFrame:
    """Events of each topic: program is the join key, the rest is checked after."""
    wanted = scope.withColumnRenamed("vendor", "_vendor")
    return events.join(wanted, "program").where(
        F.contains(F.lower("message"), F.col("keyword"))
        & (F.col("_vendor").isNull() | (F.col("vendor") == F.col("_vendor"))))


def concept_ranking(hits: DataFrame, events: DataFrame, vendors: DataFrame, programs: DataFrame, start, end,
                    by: str = "hostname", n: int = 10) -> DataFrame:
    """Devices or vendors with most events of each topic."""
    if by not in ("hostname", "vendor"):
        raise ValueError("by must be hostname or vendor")
    rows = _matching(in_range(events, start, end), _scope(hits, vendors, programs))
    counts = rows.groupBy("query_id", "keyword", by).agg(F.count("*").alias("event_count"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("event_count"), by))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def concept_count(hits: DataFrame, events: DataFrame, vendors: DataFrame, programs: DataFrame, start, end) -> DataFrame:
    """Events of each topic, zero included."""
    scope = _scope(hits, vendors, programs)
    rows = _matching(in_range(events, start, end), scope)
    counts = rows.groupBy("query_id").agg(F.count("*").alias("_n"))
    return scope.select("query_id", "keyword").distinct().join(counts, "query_id", "left").select(
        "query_id", "keyword", F.coalesce("_n", F.lit(0)).alias("event_count"))


def concept_listing(hits: DataFrame, events: DataFrame, vendors: DataFrame, programs: DataFrame, start, end,
                    n: int = 10) -> DataFrame:
    """The newest events of each topic and whether there are more."""
    rows = _matching(in_range(events, start, end), _scope(hits, vendors, programs))
    order = Window.partitionBy("query_id").orderBy(F.desc("event_time"), "event_id")
    newest = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n + 1)
    more = F.max("place").over(Window.partitionBy("query_id")) > n
    return newest.withColumn("truncated", more).where(F.col("place") <= n).select(
        "query_id", "keyword", "place", "event_id", "event_time", "hostname", "message", "truncated")


def claim_audit(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts that answers state but the facts do not hold.

    texts: (answer_id, question, text, identifiers); facts: (answer_id, value).
    Names of hosts are taken out first, their digits are no counts; numbers the
    question itself asked for are no claims.
    """
    bare = F.aggregate("identifiers", F.col("text"), lambda acc, name: F.regexp_replace(
        acc, F.concat(F.lit("(?i)\\Q"), name, F.lit("\\E")), F.lit(" ")))
    pattern = F.lit("(?i)" + COUNT_CLAIM_PATTERN)

    def number(t):
        return F.regexp_replace(t, ",", "").try_cast("long")

    both = F.arrays_zip(F.regexp_extract_all("_bare", pattern, F.lit(1)).alias("a"),
                        F.regexp_extract_all("_bare", pattern, F.lit(2)).alias("b"))
    claims = F.array_distinct(F.transform(both, lambda x: number(F.when(x["a"] != "", x["a"]).otherwise(x["b"]))))
    asked = F.transform(F.regexp_extract_all("question", F.lit("(?i)" + REQUESTED_LIMIT_PATTERN), F.lit(1)), number)
    stated = texts.withColumn("_bare", bare).select("answer_id", F.explode(F.filter(
        F.array_except(claims, asked), lambda v: v.isNotNull())).alias("value"))
    return stated.join(facts.select("answer_id", "value"), ["answer_id", "value"], "left_anti")
