"""Cross-device incidents: time buckets in which unusually many devices misbehave."""

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.functions.clock import floor_time, seconds_between
from logrill.operators.search import as_datetime, in_range


def _anomalies(events: DataFrame, start, end, vendor: str | None) -> DataFrame:
    rows = in_range(events, start, end).where("is_anomaly = 1")
    return rows.where(F.col("vendor") == vendor) if vendor else rows


def bucket_device_counts(events: DataFrame, start, end, bucket_minutes: int = 10,
                         vendor: str | None = None) -> DataFrame:
    """Distinct anomalous hosts per bucket, counted in two steps so that a busy
    bucket reaches one task as one row per host."""
    rows = _anomalies(events, start, end, vendor)
    pairs = rows.select(
        floor_time("event_time", bucket_minutes * 60).alias("bucket"), "hostname").distinct()
    return pairs.groupBy("bucket").agg(F.count("*").alias("device_count"))


def bucket_baseline(events: DataFrame, start, bucket_minutes: int = 10, lookback_days: int = 7,
                    vendor: str | None = None) -> DataFrame:
    """Median devices per bucket over the days before, 0 without history."""
    start = as_datetime(start)
    counts = bucket_device_counts(events, start - timedelta(days=lookback_days), start, bucket_minutes, vendor)
    return counts.agg(F.coalesce(F.median("device_count"), F.lit(0.0)).alias("baseline"))


def elevated_spans(counts: DataFrame, baseline: DataFrame, bucket_minutes: int = 10,
                   multiplier: float = 3, min_devices: int = 5) -> DataFrame:
    """Elevated buckets, each with the number of the span of adjacent ones it is in.

    The window runs over buckets, not events: a fixed number per day of range.
    """
    level = baseline.select(
        F.greatest(F.lit(float(min_devices)), F.col("baseline") * multiplier).alias("t"))
    elevated = counts.where(F.col("device_count") >= level.scalar())
    order = Window.orderBy("bucket")
    gap = seconds_between(F.lag("bucket").over(order), F.col("bucket"))
    begins = F.when(gap.isNull() | (gap > bucket_minutes * 60), 1).otherwise(0)
    return elevated.withColumn("_begins", begins).withColumn(
        "span", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def _span_events(events, spans, start, end, bucket_minutes, vendor):
    rows = _anomalies(events, start, end, vendor).withColumn(
        "bucket", floor_time("event_time", bucket_minutes * 60))
    return rows.join(spans.select("bucket", "span", "device_count"), "bucket")


def _top_spans(spans: DataFrame, n: int) -> DataFrame:
    peaks = spans.groupBy("span").agg(
        F.max("device_count").alias("peak_devices"), F.min("bucket").alias("_from"))
    return peaks.orderBy(F.desc("peak_devices"), "_from").limit(n).drop("_from")


def correlate_incidents(events: DataFrame, start, end, vendor: str | None = None,
                        bucket_minutes: int = 10, multiplier: float = 3, min_devices: int = 5,
                        lookback_days: int = 7, n: int = 5) -> DataFrame:
    """The ``n`` incidents with the highest peaks: extent, devices, reasons, likely root.

    The root is the earliest event of the span: a guess by time, not a cause.
    """
    baseline = bucket_baseline(events, start, bucket_minutes, lookback_days, vendor)
    counts = bucket_device_counts(events, start, end, bucket_minutes, vendor)
    spans = elevated_spans(counts, baseline, bucket_minutes, multiplier, min_devices)
    top = _top_spans(spans, n)
    rows = _span_events(events, spans.join(top.select("span"), "span", "left_semi"), start, end,
                        bucket_minutes, vendor)
    root = F.struct("hostname", "source_ip", "vendor", F.array_join(
        F.array_sort("anomaly_reasons"), ",").alias("reasons"), "event_time")
    # per host first: one row per (span, host) is all that meets in a task
    per_host = rows.groupBy("span", "hostname").agg(
        F.count("*").alias("n"), F.min("event_time").alias("t0"), F.max("event_time").alias("t1"),
        F.min(F.struct("event_time", "event_id")).alias("_first"),
        F.min_by(root, F.struct("event_time", "event_id")).alias("_root"),
        F.array_distinct(F.flatten(F.collect_set("anomaly_reasons"))).alias("_reasons"))
    per_span = per_host.groupBy("span").agg(
        F.min("t0").alias("incident_start"), F.max("t1").alias("incident_end"),
        F.sum("n").alias("event_count"),
        F.array_sort(F.collect_list("hostname")).alias("devices_affected"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_reasons")))).alias("anomaly_reasons_seen"),
        F.min_by("_root", "_first").alias("_root"))
    return per_span.join(top, "span").select(
        "incident_start", "incident_end", "event_count", "devices_affected", "anomaly_reasons_seen",
        "peak_devices", F.col("_root.hostname").alias("root_hostname"),
        F.col("_root.source_ip").alias("root_source_ip"), F.col("_root.vendor").alias("root_vendor"),
        F.col("_root.reasons").alias("root_reasons"),
    ).withColumn("baseline_devices", F.round(baseline.scalar(), 1)).orderBy(
        F.desc("peak_devices"), "incident_start")


def incident_events(events: DataFrame, start, end, vendor: str | None = None,
                    bucket_minutes: int = 10, multiplier: float = 3, min_devices: int = 5,
                    lookback_days: int = 7, n: int = 5, n_events: int = 50) -> DataFrame:
    """The first ``n_events`` of each of the ``n`` top incidents; number 1 is the likely root."""
    baseline = bucket_baseline(events, start, bucket_minutes, lookback_days, vendor)
    counts = bucket_device_counts(events, start, end, bucket_minutes, vendor)
    spans = elevated_spans(counts, baseline, bucket_minutes, multiplier, min_devices)
    rows = _span_events(events, spans.join(_top_spans(spans, n).select("span"), "span", "left_semi"),
                        start, end, bucket_minutes, vendor)
    order = Window.partitionBy("span").orderBy("event_time", "event_id")
    return rows.withColumn("number", F.row_number().over(order)).where(
        F.col("number") <= n_events).select(
        "span", "number", "event_time", "hostname", "source_ip", "vendor", "anomaly_reasons")
