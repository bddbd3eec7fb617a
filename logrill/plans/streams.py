"""Queries that drive the streaming jobs over the given tables to completion."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from logrill.session import fresh_path
from logrill.sources import fixture as fx, raw, tail
from logrill.streaming import history, jobs, keyed

ONCE = {"availableNow": True}


def _as_stream(spark, rows, name):
    """The rows as files, read back as a stream."""
    path = fresh_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _finish(query):
    query.awaitTermination()


def _collected(spark, stream, name):
    """Run an append stream to its end into a table."""
    keyed.use_rocksdb(spark)
    out = fresh_path(spark, name)
    query = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", fresh_path(spark, "position")).trigger(**ONCE).start())
    _finish(query)
    return spark.read.schema(stream.schema).parquet(out)


def _collected_with_timers(spark, stream, name, timeout_seconds):
    """Run an append stream over files that are all there into a table, until every processing-time timer has fired.

    The first batch takes all files and sets all timers, so a batch that begins
    the timeout after it has ended is the last one with a result.
    """
    keyed.use_rocksdb(spark)
    out = fresh_path(spark, name)
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "position"))
             .trigger(processingTime="1 second").start())
    fired = None
    while not query.awaitTermination(1):  # raises where the query failed
        done = query.lastProgress
        if done is None:
            continue
        if fired is None:
            fired = datetime.now(timezone.utc) + timedelta(seconds=timeout_seconds)
        elif datetime.fromisoformat(done["timestamp"]) > fired:
            break
    query.stop()
    return spark.read.schema(stream.schema).parquet(out)


def stream_ingest(spark, sf):
    lines, out = fresh_path(spark, "lines"), fresh_path(spark, "events")
    fx.raw_lines(spark, sf).write.text(lines)
    stream = raw.stream_raw(spark, lines).withColumn("received_at", F.lit(fx.AS_OF).cast("timestamp_ntz"))
    _finish(jobs.stream_ingest(stream, lambda: fx.inventory(spark, sf), lambda: fx.relays(spark, sf), out,
                               fresh_path(spark, "position"), ONCE))
    return spark.read.parquet(out).select(
        "event_time", "source_ip", "hostname", "vendor", "severity_num", "message", "predicted_category",
        F.array_join("anomaly_reasons", ",").alias("reasons"), "event_date")


def stream_events(spark, sf):
    """Events stored with all reasons, in three stretches of time that each arrive after the one before is stored."""
    rows, folder, out, position = fx.events(spark, sf), fresh_path(spark, "arriving"), fresh_path(spark, "stored"), fresh_path(spark, "position")
    how = history.Reasons(refresh_seconds=86400, volume_multiplier=3, flap_seconds=172800)
    first, last = rows.agg(F.min("event_time"), F.max("event_time")).first()
    third = (last - first) / 3 if first else timedelta()
    for low, high in ((None, first and first + third), (first and first + third, first and last - third), (first and last - third, None)):
        after, before = (F.lit(t).cast("timestamp_ntz") for t in (low, high))
        part = (F.col("event_time") > after if low else F.lit(True)) & (F.col("event_time") <= before if high else F.lit(True))
        rows.where(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        _finish(history.stream_events(stream, lambda batch: batch, out, position, how, ONCE))
    return history.read_stored(spark, out).select("event_id", F.array_join("anomaly_reasons", ",").alias("reasons"), "is_anomaly")


def stream_tail(spark, sf):
    """The lines of growing files, labelled: all that is there when the query runs."""
    folder = fresh_path(spark, "log")
    fx.raw_lines(spark, sf).write.text(folder)
    rows = _collected(spark, tail.tail_raw(spark, folder, "part-*"), "tailed")
    timed = rows.withColumn("received_at", F.lit(fx.AS_OF).cast("timestamp_ntz"))
    return jobs.label(timed, fx.inventory(spark, sf), fx.relays(spark, sf)).select(
        "event_time", "source_ip", "hostname", "vendor", "severity_num", "message", "predicted_category",
        F.array_join("anomaly_reasons", ",").alias("reasons"))


def stream_rollup(spark, sf):
    out = fresh_path(spark, "minutes")
    _finish(jobs.stream_rollup(_as_stream(spark, fx.events(spark, sf), "stream"), out,
                               fresh_path(spark, "position"), ONCE))
    return jobs.read_rollup(spark, out)


def stream_index(spark, sf):
    out = fresh_path(spark, "index")
    _finish(jobs.stream_index(_as_stream(spark, fx.events(spark, sf), "stream"), out, fresh_path(spark, "position"),
                              lambda: "2024-01-30", 40, True, ONCE))
    return jobs.read_index(spark, out).select("doc_id", "event_time", "source_ip", "embedding_text")


def stream_alerts(spark, sf):
    out = fresh_path(spark, "fired")
    _finish(jobs.stream_alerts(_as_stream(spark, fx.events(spark, sf), "stored"), lambda: fx.alert_rules(spark, sf),
                               lambda: "2024-01-30 23:00:00", out, fresh_path(spark, "position"), ONCE))
    return spark.read.parquet(f"{out}/fired").drop("v")


def stream_windowed_rollup(spark, sf):
    """Minutes that the watermark has closed."""
    return _collected(spark, jobs.windowed_rollup(_as_stream(spark, fx.events(spark, sf), "stream")), "closed")


def stream_rare_template(spark, sf):
    return _collected(spark, keyed.stream_rare_template(_as_stream(spark, fx.events(spark, sf), "stream")), "rare")


def stream_flapping(spark, sf):
    return _collected(spark, keyed.stream_flapping(
        _as_stream(spark, fx.log_events(spark, sf), "stream"), 172800, 3), "flaps")


def stream_clock_skew(spark, sf):
    rows = _collected(spark, keyed.stream_clock_skew(_as_stream(spark, fx.log_events(spark, sf), "stream")), "skew")
    return rows.withColumn("skew_seconds", F.round("skew_seconds", 6))


def stream_multipart(spark, sf, timeout_seconds=10):
    """Messages completed from their parts, and after the timeout those that lack some, with what is there."""
    return _collected_with_timers(spark, keyed.stream_multipart(
        _as_stream(spark, fx.segments(spark, sf), "stream"), timeout_seconds), "parts", timeout_seconds)


QUERIES = {f.__name__: f for f in (
    stream_ingest, stream_events, stream_tail, stream_rollup, stream_windowed_rollup, stream_index, stream_alerts, stream_rare_template, stream_flapping,
    stream_clock_skew, stream_multipart)}
