"""Devices that stopped logging, judged by their own rhythm."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.functions.clock import ntz, plus_seconds, seconds_between
from logrill.functions.text import contains_ci

STATE_COLUMNS = ("hostname", "expected_interval_minutes", "last_seen_at", "silence_started_at",
                 "last_notified_at")


def device_activity(events: DataFrame, as_of, days: int = 7, min_events: int = 20) -> DataFrame:
    """Count, first and last time of devices with enough events to have a rhythm."""
    recent = events.where(F.col("event_time") >= plus_seconds(ntz(as_of), -86400 * days))
    per_device = recent.groupBy("source_ip").agg(
        F.min_by("hostname", F.struct("event_time", "event_id")).alias("hostname"),
        F.count("*").alias("event_count"), F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"))
    span = seconds_between("first_seen", "last_seen") / 60.0
    return per_device.where(F.col("event_count") >= max(2, min_events)).withColumn(
        "expected_interval_minutes", span / (F.col("event_count") - 1))


def with_silence(activity: DataFrame, as_of, multiplier: float = 10, floor_minutes: float = 30) -> DataFrame:
    gap = seconds_between("last_seen", ntz(as_of)) / 60.0
    limit = F.greatest(F.lit(float(floor_minutes)), F.col("expected_interval_minutes") * multiplier)
    return activity.withColumn("silence_minutes", gap).withColumn("silent", gap > limit)


def silent_devices(activity: DataFrame, as_of, multiplier: float = 10, floor_minutes: float = 30) -> DataFrame:
    return with_silence(activity, as_of, multiplier, floor_minutes).where("silent").drop("silent")


def silence_transitions(activity: DataFrame, state: DataFrame, as_of, multiplier: float = 10,
                        floor_minutes: float = 30, renotify_minutes: float = 240) -> DataFrame:
    """What changed for each device since the stored state.

    newly_silent, still_silent, recovered, or unchanged for a stored device that
    has left the baseline; ``notify`` marks what is to be sent, ``minutes`` the
    silence or the outage. The columns of the new state follow (null: removed).
    """
    now = ntz(as_of)
    current = with_silence(activity, as_of, multiplier, floor_minutes).select(
        "source_ip", F.col("hostname").alias("_host"),
        F.col("expected_interval_minutes").alias("_interval"), F.col("last_seen").alias("_seen"),
        "silence_minutes", "silent")
    prior = state.select("source_ip", F.struct(*STATE_COLUMNS).alias("_p"))
    both = current.join(prior, "source_ip", "full_outer")
    known, seen = F.col("_p").isNotNull(), F.col("silent").isNotNull()
    silent = F.coalesce("silent", F.lit(False))
    transition = (
        F.when(~seen, "unchanged").when(silent & ~known, "newly_silent")
        .when(silent, "still_silent").when(known, "recovered"))
    last = F.col("_p.last_notified_at")
    again = last.isNull() | (seconds_between(last, now) >= renotify_minutes * 60)
    rows = both.withColumn("transition", transition).where(F.col("transition").isNotNull())
    is_new, is_still = F.col("transition") == "newly_silent", F.col("transition") == "still_silent"
    stays = F.col("transition") == "unchanged"
    outage = seconds_between("_p.last_seen_at", "_seen") / 60.0

    def kept(new, old):
        return F.when(is_new | is_still, new).when(stays, old)

    return rows.select(
        "source_ip", "transition",
        F.when(stays, False).when(is_still, again).otherwise(True).alias("notify"),
        F.when(is_new | is_still, F.col("silence_minutes")).when(~stays, outage).alias("minutes"),
        kept(F.col("_host"), F.col("_p.hostname")).alias("hostname"),
        kept(F.col("_interval"), F.col("_p.expected_interval_minutes")).alias("expected_interval_minutes"),
        kept(F.col("_seen"), F.col("_p.last_seen_at")).alias("last_seen_at"),
        F.when(is_new, now).when(is_still | stays, F.col("_p.silence_started_at")).alias("silence_started_at"),
        F.when(is_new | (is_still & again), now).when(is_still | stays, last).alias("last_notified_at"))


def state_after(transitions: DataFrame) -> DataFrame:
    """The new silence state: everything but the recovered devices."""
    return transitions.where(F.col("transition") != "recovered").select("source_ip", *STATE_COLUMNS)


def list_silent(state: DataFrame, as_of, hostname_like: str | None = None,
                sort: str = "silence_started_at", descending: bool = True) -> DataFrame:
    """Devices silent now, with the running length of the silence."""
    rows = state
    if hostname_like:
        rows = rows.where(contains_ci("hostname", hostname_like))
    rows = rows.withColumn(
        "silent_minutes", seconds_between(F.coalesce("silence_started_at", "last_seen_at"), ntz(as_of)) / 60.0)
    return rows.orderBy(F.desc(sort) if descending else F.asc(sort), "source_ip")
