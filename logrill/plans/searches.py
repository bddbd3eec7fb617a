"""Queries over search, devices and the rollup panels."""

from pyspark.sql import functions as F

from logrill.operators import devices, rollup, search
from logrill.sources import fixture as fx

AS_OF = fx.AS_OF


def filter_events(spark, sf):
    rows = search.filter_events(fx.events(spark, sf), AS_OF, start="2024-01-10", severity="err",
                                keyword="FAILED BY", anomaly_reason="security_content", only_anomalies=True)
    return rows.select("event_id", "event_time", "source_ip", "hostname", "vendor", "program", "message")


def search_events(spark, sf):
    rows = search.search_events(fx.events(spark, sf), AS_OF, limit=50, offset=20, start="2024-01-05",
                                keyword="ether")
    return rows.select("event_id", "event_time", "hostname", "severity", "message",
                       F.array_join("anomaly_reasons", ",").alias("reasons"), "has_more")


def count_events(spark, sf):
    return search.count_events(fx.events(spark, sf), AS_OF, start="2024-01-03", vendor="mikrotik",
                               predicted_category="HARDWARE")


def aggregate_events(spark, sf):
    return search.aggregate_events(fx.events(spark, sf), AS_OF, ["vendor", "program", "severity"],
                                   limit=40, start="2024-01-01")


def filter_options(spark, sf):
    return search.filter_options(fx.events(spark, sf), AS_OF)


def period_counts(spark, sf):
    return search.period_counts(fx.events(spark, sf), "2024-01-29 15:30:00", days_ago=3)


def period_trend(spark, sf):
    counts = search.period_counts(fx.events(spark, sf), "2024-01-29 15:30:00", severity="err")
    return search.period_trend(counts, "this week", "last week")


def list_devices(spark, sf):
    return devices.list_devices(fx.events(spark, sf), AS_OF, start="2024-01-01", hostname="NODE",
                                ip="10.0", vendor="o", limit=60, offset=5)


def resolution_summary(spark, sf):
    return devices.resolution_summary(fx.events(spark, sf), AS_OF, days=5)


def events_by_minute(spark, sf):
    return rollup.events_by_minute(fx.events(spark, sf))


def volume_by_severity(spark, sf):
    return rollup.volume_by_severity(rollup.events_by_minute(fx.events(spark, sf)),
                                     "2024-01-02", "2024-01-20")


def volume_by_category(spark, sf):
    return rollup.volume_by_category(rollup.events_by_minute(fx.events(spark, sf)),
                                     "2024-01-02", "2024-01-20")


def recent_anomalies(spark, sf):
    return rollup.recent_anomalies(rollup.events_by_minute(fx.events(spark, sf)), AS_OF, 2 * 1440)


def resolution_share(spark, sf):
    return rollup.resolution_share(fx.events(spark, sf), AS_OF, 48)


def top_error_hosts(spark, sf):
    return rollup.top_error_hosts(fx.events(spark, sf), AS_OF, 24 * 10)


QUERIES = {f.__name__: f for f in (
    filter_events, search_events, count_events, aggregate_events, filter_options, period_counts,
    period_trend, list_devices, resolution_summary, events_by_minute, volume_by_severity,
    volume_by_category, recent_anomalies, resolution_share, top_error_hosts)}
