"""Queries over reading, writing, exporting and keeping tables."""

from pyspark.sql import functions as F

from logrill.operators import classify, rollup, state, summary
from logrill.functions import text
from logrill.session import fresh_path
from logrill.sources import exports, fixture as fx, raw, tables

AS_OF = fx.AS_OF


def read_raw(spark, sf):
    path = fresh_path(spark, "raw")
    fx.raw_lines(spark, sf).write.text(path)
    return raw.read_raw(spark, path)


def write_events(spark, sf):
    path = fresh_path(spark, "events")
    tables.write_events(fx.events(spark, sf), path)
    return tables.read_events(spark, path).withColumn(
        "anomaly_reasons", F.array_join("anomaly_reasons", ","))


def export_events(spark, sf):
    rows, truncated = exports.export_rows(fx.events(spark, sf), AS_OF, start="2024-01-01")
    return rows.withColumn("truncated", truncated.scalar())


def export_events_xml(spark, sf):
    path = fresh_path(spark, "xml")
    exports.export_events(fx.events(spark, sf), AS_OF, path, "xml", start="2024-01-01", severity="err")
    schema = ", ".join(f"{c} string" for c in exports.EXPORT_COLUMNS)
    return (spark.read.format("xml").schema(schema).option("rowTag", "log")
            .option("ignoreSurroundingSpaces", False).load(path)
            .select("event_time", "source_ip", "hostname", "program", "message", "anomaly_reasons"))


def export_table(spark, sf):
    rows = summary.summary_with_acks(summary.device_reason_summary(fx.events(spark, sf)),
                                     fx.acknowledgments(spark, sf), fx.users(spark, sf))
    return exports.table_text(rows, ["source_ip", "hostname", "vendor", "anomaly_reason", "event_count",
                                     "first_seen", "acknowledged", "acknowledged_by",
                                     "acknowledged_at", "note"])


def backup_partitions(spark, sf):
    return tables.backup_partitions(fx.events(spark, sf), fresh_path(spark, "backup"), AS_OF, 15)


def purge_partitions(spark, sf):
    events = fx.events(spark, sf)
    manifest = tables.backup_partitions(events, fresh_path(spark, "backup"), AS_OF, 15)
    return tables.purge_partitions(events, manifest).select("event_id", "event_time", "event_date")


def latest_version(spark, sf):
    rows = fx.events(spark, sf).select("source_ip", "program", "severity", "message", "event_time", "event_id")
    return state.latest_version(rows, ["source_ip", "program"], ["event_time", "event_id"])


def keyed_upsert(spark, sf):
    """Device counts of the first days, brought up to date with the last days."""
    events = fx.events(spark, sf)
    old = events.where("event_time < '2024-01-20'").groupBy("source_ip", "program").agg(
        F.count("*").alias("n"), F.max("event_time").alias("last_seen"))
    new = events.where("event_time >= '2024-01-28'").groupBy("source_ip", "program").agg(
        F.count("*").alias("n"), F.max("event_time").alias("last_seen"))
    return state.keyed_upsert(old, new.withColumn("gone", F.col("n") % 3 == 0), ["source_ip", "program"], "gone")


def cursor_batch(spark, sf):
    rows = state.cursor_batch(_ties(spark, sf), "2024-01-12 00:00:00", AS_OF, n=200)
    return rows.select("event_id", "received_at", "source_ip", "message")


def cursor_batch_anomalies(spark, sf):
    rows = state.cursor_batch(_ties(spark, sf), None, AS_OF, n=100, anomalies_only=True)
    return rows.select("event_id", "received_at", "source_ip", "message")


def cursor_range(spark, sf):
    rows = state.cursor_range(_ties(spark, sf), "2024-01-05", "2024-01-06", n=150)
    return rows.select("event_id", "received_at", "source_ip", "message")


def _ties(spark, sf):
    """Events received in batches: times cut to the half hour."""
    from logrill.functions.clock import floor_time
    return fx.events(spark, sf).withColumn("received_at", floor_time("received_at", 1800))


def upsert_index(spark, sf):
    docs = fx.events(spark, sf).select(
        text.doc_id().alias("doc_id"), "event_time", "source_ip", text.embedding_text().alias("embedding_text"))
    old = docs.where("event_time < '2024-01-25'").withColumn("embedding_text", F.lit("stale"))
    return state.upsert_index(old, docs.where("event_time >= '2024-01-20'"))


def load_training(spark, sf):
    given = fx.events(spark, sf).select(
        "event_id", "message", F.when(F.col("severity") == "crit", "SYSTEM").alias("category"))
    return classify.load_training(given.withColumn(
        "message", F.when(F.col("event_id") % 17 == 0, "").otherwise(F.col("message"))))


def run_query(spark, sf):
    return exports.run_query(
        spark, {"log_events": fx.events(spark, sf)},
        "SELECT source_ip, severity, count(*) AS n, max(event_time) AS latest FROM log_events "
        "WHERE vendor <> 'unknown' GROUP BY source_ip, severity ORDER BY n DESC, source_ip, severity;")


QUERIES = {f.__name__: f for f in (
    read_raw, write_events, export_events, export_events_xml, export_table, backup_partitions,
    purge_partitions, latest_version, keyed_upsert, cursor_batch, cursor_batch_anomalies, cursor_range,
    upsert_index, load_training, run_query)}
