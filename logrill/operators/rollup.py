"""Per-minute rollup and the dashboard panels over it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.functions.clock import floor_time, ntz, plus_seconds

ROLLUP_KEYS = ["minute", "hostname", "vendor", "severity", "predicted_category"]
ERROR_SEVERITIES = ("err", "crit", "alert", "emerg")


def events_by_minute(events: DataFrame) -> DataFrame:
    return events.groupBy(
        floor_time("event_time", 60).alias("minute"), "hostname", "vendor", "severity",
        "predicted_category",
    ).agg(
        F.count("*").alias("event_count"), F.sum("is_anomaly").alias("anomaly_count"),
        F.count_if(F.col("resolution_method") == "unresolved").alias("unresolved_count"))


def merge_rollups(rollup: DataFrame) -> DataFrame:
    """Sum partial rollup rows of the same key (appended batches)."""
    return rollup.groupBy(*ROLLUP_KEYS).agg(*[
        F.sum(c).alias(c) for c in ("event_count", "anomaly_count", "unresolved_count")])


def _between(rollup: DataFrame, start, end) -> DataFrame:
    return rollup.where(F.col("minute").between(ntz(start), ntz(end)))


def volume_by_severity(rollup: DataFrame, start, end) -> DataFrame:
    return _between(rollup, start, end).groupBy("minute", "severity").agg(
        F.sum("event_count").alias("value"))


def volume_by_category(rollup: DataFrame, start, end) -> DataFrame:
    return _between(rollup, start, end).groupBy("minute", "predicted_category").agg(
        F.sum("event_count").alias("value"))


def recent_anomalies(rollup: DataFrame, as_of, minutes: int = 15) -> DataFrame:
    return rollup.where(F.col("minute") >= plus_seconds(ntz(as_of), -60 * minutes)).agg(
        F.coalesce(F.sum("anomaly_count"), F.lit(0)).alias("anomalies"))


def resolution_share(events: DataFrame, as_of, hours: int = 1) -> DataFrame:
    return _recent(events, as_of, hours).groupBy("resolution_method").agg(F.count("*").alias("events"))


def top_error_hosts(events: DataFrame, as_of, hours: int = 1, n: int = 25) -> DataFrame:
    keys = ["hostname", "vendor", "resolution_method", "predicted_category"]
    return (_recent(events, as_of, hours).where(F.col("severity").isin(*ERROR_SEVERITIES))
            .groupBy(*keys).agg(F.count("*").alias("events")).orderBy(F.desc("events"), *keys).limit(n))


def _recent(events: DataFrame, as_of, hours: int) -> DataFrame:
    return events.where(F.col("event_time") >= plus_seconds(ntz(as_of), -3600 * hours))
