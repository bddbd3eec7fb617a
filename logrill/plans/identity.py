"""Queries over record normalisation, identity, clocks and message parts."""

from pyspark.sql import functions as F

from logrill.functions import clock, text
from logrill.operators import enrich, templates
from logrill.sources import fixture as fx

AS_OF = fx.AS_OF
ZONE = "Europe/Athens"  # two hours ahead of UTC in the fixture's month


def normalize_record(spark, sf):
    return enrich.normalize_record(fx.raw_records(spark, sf))


def severity_rank(spark, sf):
    rows = fx.log_events(spark, sf).select("event_id", F.when(
        F.col("event_id") % 3 == 0, F.upper("severity")).when(F.col("event_id") % 7 == 0, "strange")
        .otherwise(F.col("severity")).alias("severity"))
    return rows.withColumn("severity_num", text.severity_rank("severity"))


def weak_label(spark, sf):
    return fx.log_events(spark, sf).select("event_id", text.weak_label("message").alias("predicted_category"))


def detect_vendor(spark, sf):
    return fx.log_events(spark, sf).select("event_id", text.detect_vendor("message").alias("vendor"))


_IDENTITY = ("event_id", "source_ip", "hostname", "reported_hostname", "relayed_via", "vendor",
             "vendor_source", "model", "resolution_method")


def join_inventory(spark, sf):
    return enrich.join_inventory(fx.log_events(spark, sf), fx.inventory(spark, sf)).select(*_IDENTITY)


def _identified(spark, sf):
    return enrich.resolve_identity(fx.relayed_events(spark, sf), fx.inventory(spark, sf), fx.relays(spark, sf))


def resolve_identity(spark, sf):
    return _identified(spark, sf).select(*_IDENTITY)


def pending_queue(spark, sf):
    queue = fx.pending(spark, sf).where("status = 'unreachable'")
    return enrich.pending_queue(_identified(spark, sf), queue).select("ip", "first_seen", "attempt_count", "status")


def pending_due(spark, sf):
    return enrich.pending_due(fx.pending(spark, sf), AS_OF)


def advance_pending(spark, sf):
    return enrich.advance_pending(fx.pending(spark, sf), fx.polled(spark, sf), AS_OF)


def match_scope(spark, sf):
    devices = fx.log_events(spark, sf).select(F.col("source_ip").alias("ip"))
    return enrich.match_scope(devices, fx.scopes(spark, sf))


def match_scope_candidates(spark, sf):
    devices = fx.log_events(spark, sf).select(F.col("source_ip").alias("ip"))
    return enrich.match_scope(devices, fx.scopes(spark, sf), best_only=False)


def vendor_from_oid(spark, sf):
    forms = F.when(F.length("ip") % 2 == 0, F.col("object_id")).otherwise(
        F.regexp_replace("object_id", r"^\.1\.", "iso."))
    return fx.polled(spark, sf).select("ip", text.vendor_from_oid(forms).alias("vendor"))


def refresh_inventory(spark, sf):
    return enrich.refresh_inventory(fx.inventory(spark, sf), fx.polled(spark, sf), fx.pending(spark, sf))


def fix_relay_timezone(spark, sf):
    return enrich.fix_relay_timezone(fx.shifted_events(spark, sf), fx.relays(spark, sf)).select(
        "event_id", "event_time")


def correct_clock_skew(spark, sf):
    events = enrich.join_inventory(fx.log_events(spark, sf), fx.inventory(spark, sf))
    return enrich.correct_clock_skew(events).select(
        "event_id", "event_time", F.round("skew_seconds", 6).alias("skew_seconds"))


def reassemble_multipart(spark, sf):
    return enrich.reassemble_multipart(fx.segments(spark, sf)).select(
        "event_id", "event_time", "source_ip", "program", "message", "raw")


def embedding_text(spark, sf):
    return fx.events(spark, sf).select("event_id", text.embedding_text().alias("embedding_text"))


def doc_id(spark, sf):
    return fx.events(spark, sf).select("event_id", text.doc_id().alias("doc_id"))


def mine_templates(spark, sf):
    return templates.mine_templates(fx.log_events(spark, sf), "mask").select(
        "event_id", "template_id", "template", "template_size")


def mine_templates_drain(spark, sf):
    mined = templates.mine_templates(fx.log_events(spark, sf), "drain")
    return mined.select("event_id", "template_id", "template", "template_size")


def mine_templates_drain_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("message"))
    return templates.mine_templates(docs, "drain").select("event_id", "template_id", "template_size")


def padded_window(spark, sf):
    last = fx.log_events(spark, sf).groupBy("source_ip").agg(F.max("event_time").alias("last_seen"))
    return last.select("source_ip", clock.padded_window("last_seen", 10, 15, "2024-01-30 12:00:00").alias("w")
                       ).select("source_ip", "w.*")


def local_time(spark, sf):
    rows = fx.log_events(spark, sf).select("event_id", "event_time", clock.local_time("event_time", ZONE).alias("local_time"))
    return rows.withColumns({
        "back_in_utc": clock.utc_time("local_time", ZONE), "offset_minutes": clock.zone_offset_minutes("event_time", ZONE)})


QUERIES = {f.__name__: f for f in (
    normalize_record, severity_rank, weak_label, detect_vendor, join_inventory, resolve_identity,
    pending_queue, pending_due, advance_pending, match_scope, match_scope_candidates, vendor_from_oid,
    refresh_inventory, fix_relay_timezone, correct_clock_skew, reassemble_multipart, embedding_text, doc_id,
    mine_templates, mine_templates_drain, mine_templates_drain_documents, padded_window, local_time)}
