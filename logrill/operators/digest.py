"""The daily digest: totals, reasons, busiest devices, alerts, silent devices."""

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.functions.clock import micros, ntz
from logrill.operators.search import as_datetime, in_range


def _window(as_of, hours):
    end = as_datetime(as_of)
    return end - timedelta(hours=hours), end


def digest_totals(events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return in_range(events, *_window(as_of, hours)).agg(
        F.count("*").alias("total_events"), F.count_if(F.col("is_anomaly") == 1).alias("anomaly_events"))


def digest_reasons(events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    rows = in_range(events, *_window(as_of, hours)).select(F.explode("anomaly_reasons").alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("event_count"))


def digest_top_devices(events: DataFrame, as_of, hours: int = 24, n: int = 10) -> DataFrame:
    return in_range(events, *_window(as_of, hours)).groupBy("source_ip").agg(
        F.min_by("hostname", F.struct("event_time", "event_id")).alias("hostname"),
        F.count("*").alias("event_count")).orderBy(F.desc("event_count"), "source_ip").limit(n)


def digest_alerts(history: DataFrame, rules: DataFrame, as_of, hours: int = 24) -> DataFrame:
    start, end = _window(as_of, hours)
    fired = history.where(F.col("triggered_at").between(ntz(start), ntz(end)))
    return fired.join(rules.select(F.col("id").alias("rule_id"), "name"), "rule_id").select(
        "name", "matched_count", "triggered_at")


def digest_silent(state: DataFrame) -> DataFrame:
    return state.select("source_ip", "hostname", "silence_started_at")


def digest_lines(events: DataFrame, history: DataFrame, rules: DataFrame, state: DataFrame, as_of,
                 hours: int = 24, n: int = 10) -> DataFrame:
    """The digest as lines; sort by (section, position, text) to print it.

    ``position`` comes from the data (count or time), so no line needs a global
    row number, however many devices are silent.
    """
    def lines(df, section, position, text):
        return df.select(F.lit(section).alias("section"), position.cast("long").alias("position"),
                         text.alias("text"))

    def stamp(c):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    totals = digest_totals(events, as_of, hours)
    body = lines(totals, "1 total", F.lit(0), F.concat(F.lit("Total events: "), "total_events"))
    body = body.unionByName(lines(totals, "2 anomalous", F.lit(0),
                                  F.concat(F.lit("Anomalous events: "), "anomaly_events")))
    listed = lines(digest_reasons(events, as_of, hours), "3 reasons", -F.col("event_count"),
                   F.format_string("%s: %d", "reason", "event_count"))
    listed = listed.unionByName(lines(
        digest_top_devices(events, as_of, hours, n), "4 devices", -F.col("event_count"),
        F.format_string("%s (%s): %d events", "hostname", "source_ip", "event_count")))
    listed = listed.unionByName(lines(
        digest_alerts(history, rules, as_of, hours), "5 alerts", -micros("triggered_at"),
        F.format_string("%s -- %s (%d matched)", stamp("triggered_at"), "name", "matched_count")))
    listed = listed.unionByName(lines(
        digest_silent(state), "6 silent", micros("silence_started_at"),
        F.format_string("%s (%s) -- silent since %s", "hostname", "source_ip", stamp("silence_started_at"))))
    spark = events.sparkSession
    sections = spark.createDataFrame(
        [("3 reasons",), ("4 devices",), ("5 alerts",), ("6 silent",)], "section string")
    empty = sections.join(listed.select("section").distinct(), "section", "left_anti").select(
        "section", F.lit(0).cast("long").alias("position"), F.lit("(none)").alias("text"))
    return body.unionByName(listed).unionByName(empty)
