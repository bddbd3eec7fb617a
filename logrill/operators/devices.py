"""Device lists, identity shares and scored windows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.functions.clock import ntz, plus_seconds
from logrill.functions.text import contains_ci
from logrill.operators.search import in_range, page_of, time_bounds
from logrill.operators.state import latest_version

_IDENTITY = ("hostname", "vendor", "vendor_source", "model", "resolution_method")
WINDOW_SORT_KEYS = ("window_start", "hostname", "source_ip", "vendor", "model_scope",
                    "anomaly_score", "event_count")


def device_activity_table(events: DataFrame) -> DataFrame:
    """Per device: latest identity, first and last time, count."""
    latest = F.max_by(F.struct(*_IDENTITY), F.struct("event_time", "event_id")).alias("_id")
    return events.groupBy("source_ip").agg(
        latest, F.min("event_time").alias("first_seen_in_window"),
        F.max("event_time").alias("last_seen"), F.count("*").alias("event_count"),
    ).select("source_ip", "_id.*", "first_seen_in_window", "last_seen", "event_count")


def list_devices(events: DataFrame, as_of, start=None, end=None, hostname: str | None = None,
                 ip: str | None = None, vendor: str | None = None, limit: int = 100,
                 offset: int = 0) -> DataFrame:
    """Devices seen in the range, busiest first, and whether more follow. Address
    filters apply to events, name filters to the latest identity."""
    rows = in_range(events, *time_bounds(start, end, as_of))
    if ip:
        rows = rows.where(contains_ci("source_ip", ip))
    devices = device_activity_table(rows)
    if hostname:
        devices = devices.where(contains_ci("hostname", hostname))
    if vendor:
        devices = devices.where(contains_ci("vendor", vendor))
    return page_of(devices.orderBy(F.desc("event_count"), "source_ip"), limit, offset)


def resolution_summary(events: DataFrame, as_of, days: int = 1) -> DataFrame:
    """Distinct devices per resolution method and their share in percent."""
    recent = events.where(F.col("event_time") >= plus_seconds(ntz(as_of), -86400 * days))
    counts = recent.select("resolution_method", "source_ip").distinct().groupBy(
        "resolution_method").agg(F.count("*").alias("device_count"))
    total = F.sum("device_count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share_percent", F.round(F.col("device_count") * 100.0 / total, 1))


def list_anomaly_windows(windows: DataFrame, events: DataFrame, as_of, start=None, end=None,
                         source_ip: str | None = None, vendor: str | None = None,
                         only_anomalies: bool = True, sort: str = "window_start",
                         descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """Scored windows with the device's latest name of the last seven days."""
    if sort not in WINDOW_SORT_KEYS:
        raise ValueError(f"sort must be one of {WINDOW_SORT_KEYS}")
    low, high = time_bounds(start, end, as_of)
    rows = latest_version(windows, ["source_ip", "window_start"], ["scored_at"])
    rows = rows.where(F.col("window_start").between(ntz(low), ntz(high)))
    if only_anomalies:
        rows = rows.where("is_anomaly = 1")
    if source_ip:
        rows = rows.where(F.col("source_ip") == source_ip)
    if vendor:
        rows = rows.where(F.col("vendor") == vendor)
    names = events.where(F.col("event_time") >= plus_seconds(ntz(as_of), -7 * 86400)).groupBy(
        "source_ip").agg(F.max_by("hostname", F.struct("event_time", "event_id")).alias("_name"))
    named = rows.join(names, "source_ip", "left").select(
        "window_start", "source_ip", F.coalesce("_name", "source_ip").alias("hostname"), "vendor",
        "model_scope", "anomaly_score", "is_anomaly", "event_count")
    order = F.desc(sort) if descending else F.asc(sort)
    return page_of(named.orderBy(order, "source_ip", "window_start"), limit, offset)
