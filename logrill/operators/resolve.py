"""Loose names and phrases -> real host names, programs and anomaly reasons."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.functions.clock import col
from logrill.functions.matching import contains_join
from logrill.model import ANOMALY_REASONS
from logrill.session import materialize

# ---- fixed values ----
FLAPPING_SYNONYMS = (
    "disconnect", "disconnects", "disconnection", "disconnections",
    "dropout", "dropouts", "drop", "drops", "link down", "goes down", "going down",
)
WIRELESS_MARKERS = ("wireless", "wifi", "wi-fi", "radio")
# ---- end of fixed values ----
MOST_HOSTS = 1000  # hosts with a word, up to which they are laid beside each name that has the word


def _verdicts(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """One row per name: how many distinct values matched, and the value if one."""
    return pairs.select(key, value).distinct().groupBy(key).agg(
        F.count("*").alias("match_count"), F.min(value).alias("_value"))


def _by_words(names: DataFrame, hosts: DataFrame, most: int = MOST_HOSTS) -> DataFrame:
    """One row per name: how many hosts contain one of its words, and the host if one.

    A word is looked up once for all names that have it. The hosts of a word in more
    than `most` are not laid beside each name: they are counted once per set of such words,
    and to each name come the hosts of its other words that contain none of these.
    """
    words = materialize(names.select("name", F.explode(F.array_distinct(F.transform(F.filter(
        F.split("name", r"[\s_-]+"), lambda w: F.length(w) >= 3), F.lower))).alias("_word")), "words")
    hits = materialize(contains_join(words.select("_word").distinct(), "_word", hosts, "hostname").select(
        "_word", "hostname").distinct(), "hits")
    sizes = hits.groupBy("_word").agg((F.count("*") > most).alias("_common"))
    known = words.join(sizes, "_word")
    common = F.array_sort(F.collect_list(F.when(F.col("_common"), F.col("_word")))).alias("_set")
    sets = materialize(known.groupBy("name").agg(common), "sets")
    of_sets = _verdicts(sets.select("_set").distinct().withColumn("_word", F.explode("_set")).join(
        hits, "_word"), "_set", "hostname").select("_set", F.col("match_count").alias("_n"), F.col("_value").alias("_one"))
    others = known.where(~F.col("_common")).join(hits, "_word").join(sets, "name").where(
        ~F.exists("_set", lambda w: F.contains(F.lower("hostname"), w)))
    own = _verdicts(others, "name", "hostname")
    return sets.join(of_sets, "_set", "left").join(own, "name", "left").select(
        "name", (F.coalesce("_n", F.lit(0)) + F.coalesce("match_count", F.lit(0))).alias("match_count"),
        F.least("_one", "_value").alias("_value"))


def resolve_hostnames(names: DataFrame, hostnames: DataFrame) -> DataFrame:
    """(name) against (hostname): exact, else as a substring, else by its words.

    The word stage runs only for names that match nowhere as a whole. Verdicts:
    resolved (one host), ambiguous (several), none.
    """
    # the distinct names are few beside the events; written once, read by each stage
    names = materialize(names.select("name").distinct(), "names")
    hosts = materialize(hostnames.select("hostname").distinct(), "hosts")
    exact = names.join(hosts, F.col("name") == F.col("hostname")).select("name", "hostname")
    rest = names.join(exact, "name", "left_anti")
    whole = materialize(contains_join(rest, "name", hosts, "hostname").select("name", "hostname"), "whole")
    unmatched = rest.join(whole.select("name").distinct(), "name", "left_anti")
    found = _verdicts(exact, "name", "hostname").withColumn("stage", F.lit("exact")).unionByName(
        _verdicts(whole, "name", "hostname").withColumn("stage", F.lit("substring"))).unionByName(
        _by_words(unmatched, hosts).withColumn("stage", F.lit("words")))
    return _with_verdict(names.join(found, "name", "left"), "hostname")


def resolve_programs(names: DataFrame, programs: DataFrame) -> DataFrame:
    """(name) against (program): exact, else as a whole substring."""
    names = materialize(names.select("name").distinct(), "names")
    known = materialize(programs.select("program").distinct(), "programs")
    exact = names.join(known, F.col("name") == F.col("program")).select("name", "program")
    rest = names.join(exact, "name", "left_anti").withColumn("_text", F.trim("name"))
    loose = contains_join(rest, "_text", known, "program").select("name", "program")
    stages = exact.withColumn("stage", F.lit("exact")).unionByName(
        loose.withColumn("stage", F.lit("substring")))
    found = _verdicts(stages, "name", "program").join(
        stages.groupBy("name").agg(F.min("stage").alias("stage")), "name")
    return _with_verdict(names.join(found, "name", "left"), "program")


def _with_verdict(rows: DataFrame, value: str) -> DataFrame:
    n = F.coalesce("match_count", F.lit(0))
    return rows.select(
        "name", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("none").alias("verdict"),
        F.when(n == 1, F.col("_value")).alias(value), n.alias("match_count"), "stage")


def resolve_reasons(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Phrase -> one of the eight reasons by most shared words.

    Words match when equal or when one begins with the other (4 letters at
    least). A tie is ambiguous; without a match, words for disconnecting mean
    flapping unless the phrase is about wireless links.
    """
    lowered = F.trim(F.lower(col(phrase)))
    words = F.array_distinct(F.regexp_extract_all(lowered, F.lit("([a-z]+)"), F.lit(1)))
    reasons = F.array(*[F.lit(r) for r in ANOMALY_REASONS])

    def alike(part, word):
        prefix = F.startswith(part, word) | F.startswith(word, part)
        return (part == word) | ((F.length(word) >= 4) & (F.length(part) >= 4) & prefix)

    def score(reason):
        return F.size(F.filter(F.split(reason, "_"), lambda p: F.exists(F.col("_words"), lambda w: alike(p, w))))

    scored = F.transform(reasons, lambda r: F.struct(score(r).alias("s"), r.alias("r")))
    best = F.array_max(F.transform(F.col("_scored"), lambda x: x["s"]))
    matches = F.transform(F.filter(F.col("_scored"), lambda x: (x["s"] > 0) & (x["s"] == F.col("_best"))),
                          lambda x: x["r"])

    def any_in(markers):
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(lowered, F.lit(m))
        return hit

    out = phrases.withColumn("_words", words).withColumn("_scored", scored).withColumn(
        "_best", best).withColumn("_matches", matches)
    n = F.size("_matches")
    exact = lowered.isin(*ANOMALY_REASONS)
    synonym = (n == 0) & ~any_in(WIRELESS_MARKERS) & any_in(FLAPPING_SYNONYMS)
    return out.withColumns({
        "reason": F.when(exact, lowered).when(n == 1, F.try_element_at("_matches", F.lit(1)))
        .when(synonym, "interface_flapping"),
        "verdict": F.when(exact | (n == 1) | synonym, "resolved").when(n > 1, "ambiguous").otherwise("none"),
        "candidates": F.when(~exact & (n > 1), F.array_join("_matches", ",")),
    }).drop("_words", "_scored", "_best", "_matches")


def _cells(events: DataFrame) -> DataFrame:
    """Counts for every combination of given fields: both, one, or none ('')."""
    counts = events.groupBy("hostname", "program").agg(F.count("*").alias("_n"))
    return counts.withColumn("_mask", F.explode(F.array(*[F.lit(i) for i in range(4)]))).groupBy(
        "_mask",
        F.when(F.col("_mask").bitwiseAND(F.lit(1)) != 0, F.col("hostname")).otherwise("").alias("_h"),
        F.when(F.col("_mask").bitwiseAND(F.lit(2)) != 0, F.col("program")).otherwise("").alias("_p"),
    ).agg(F.sum("_n").alias("_n"))


def _counted(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Add ``_n``: events with the request's host and program, null for any."""
    mask = F.when(F.col("hostname").isNotNull(), 1).otherwise(0) + F.when(
        F.col("program").isNotNull(), 2).otherwise(0)
    keyed = requests.withColumns({"_mask": mask, "_h": F.coalesce("hostname", F.lit("")),
                                  "_p": F.coalesce("program", F.lit(""))})
    return keyed.join(cells, ["_mask", "_h", "_p"], "left").select(
        *requests.columns, F.coalesce("_n", F.lit(0)).alias("_n"))


def resolved_count(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Counts per request (request_id, hostname, program); where the exact names
    give zero, first the host and then the program is resolved loosely.

    Events are counted once into a small table that every stage reads.
    """
    cells = materialize(_cells(events), "cells")
    known = cells.where("_mask = 3")
    hostnames, programs = known.select(F.col("_h").alias("hostname")), known.select(F.col("_p").alias("program"))
    first = materialize(_counted(requests.select("request_id", "hostname", "program"), cells), "count")
    open_ = first.where("_n = 0").drop("_n")
    hosts = resolve_hostnames(open_.where("hostname is not null").select(F.col("hostname").alias("name")), hostnames)
    hosts = hosts.where("verdict = 'resolved'").select(F.col("name").alias("hostname"), F.col("hostname").alias("_host"))
    second = materialize(_counted(open_.join(hosts, "hostname", "left").select(
        "request_id", F.coalesce("_host", "hostname").alias("hostname"), "program"), cells), "count")
    open2 = second.where("_n = 0").drop("_n")
    progs = resolve_programs(open2.where("program is not null").select(F.col("program").alias("name")), programs)
    progs = progs.where("verdict = 'resolved'").select(F.col("name").alias("program"), F.col("program").alias("_prog"))
    third = _counted(open2.join(progs, "program", "left").select(
        "request_id", "hostname", F.coalesce("_prog", "program").alias("program")), cells)
    both = first.where("_n > 0").unionByName(second.where("_n > 0")).unionByName(third)
    return both.select("request_id", "hostname", "program", F.col("_n").alias("event_count"))
