"""Queries over summaries, acknowledgments and the audit log."""

from pyspark.sql import functions as F

from logrill.operators import summary as op
from logrill.sources import fixture as fx


def device_reason_summary(spark, sf):
    return op.device_reason_summary(fx.events(spark, sf))


def device_total_anomalies(spark, sf):
    return op.device_total_anomalies(fx.events(spark, sf))


def vendor_total_anomalies(spark, sf):
    return op.vendor_total_anomalies(fx.events(spark, sf))


def vendor_reason_summary(spark, sf):
    return op.vendor_reason_summary(fx.events(spark, sf))


def device_category_summary(spark, sf):
    return op.device_category_summary(fx.events(spark, sf))


def vendor_category_summary(spark, sf):
    return op.vendor_category_summary(fx.events(spark, sf))


def summary_with_acks(spark, sf):
    return op.summary_with_acks(op.device_reason_summary(fx.events(spark, sf)),
                                fx.acknowledgments(spark, sf), fx.users(spark, sf))


def _requests(spark, sf):
    """Every device with a reason asks for an acknowledgment by a user."""
    return op.device_reason_summary(fx.events(spark, sf)).select(
        "source_ip", "anomaly_reason", F.concat(F.lit("checked "), "hostname").alias("note"),
        (F.col("event_count") % 25).alias("actor_id"))


def _flat(acks, audit):
    return acks.select(
        F.lit("ack").alias("kind"), "source_ip", "anomaly_reason", "note",
        F.col("acknowledged_by").alias("actor_id"), F.col("acknowledged_at").alias("at")
    ).unionByName(audit.where(F.col("action").startswith("anomaly.") & F.col("id").isNull()).select(
        F.col("action").alias("kind"), F.substring_index("target", ":", 1).alias("source_ip"),
        F.substring_index("target", ":", -1).alias("anomaly_reason"),
        F.get_json_object("details", "$.note").alias("note"), "actor_id",
        F.col("created_at").alias("at")))


def acknowledge(spark, sf):
    return _flat(*op.acknowledge(fx.acknowledgments(spark, sf), fx.audit_log(spark, sf),
                                 _requests(spark, sf), fx.AS_OF))


def unacknowledge(spark, sf):
    return _flat(*op.unacknowledge(fx.acknowledgments(spark, sf), fx.audit_log(spark, sf),
                                   _requests(spark, sf), fx.AS_OF))


def reason_ranking(spark, sf):
    return op.reason_ranking(fx.events(spark, sf), "always_severe", "device", 10)


def reason_ranking_vendors(spark, sf):
    return op.reason_ranking(fx.events(spark, sf), "security_content", "vendor", 10)


def other_devices(spark, sf):
    return op.other_devices(fx.events(spark, sf), "always_severe", "10.0.0.8", 10)


def audit_list(spark, sf):
    return op.audit_list(fx.audit_log(spark, sf), fx.users(spark, sf), action="alert_rule.create",
                         since="1996-01-01 00:00:00", contains="RULE", n=500)


def audit_actions(spark, sf):
    return op.audit_actions(fx.audit_log(spark, sf))


QUERIES = {f.__name__: f for f in (
    device_reason_summary, device_total_anomalies, vendor_total_anomalies, vendor_reason_summary,
    device_category_summary, vendor_category_summary, summary_with_acks, acknowledge, unacknowledge,
    reason_ranking, reason_ranking_vendors, other_devices, audit_list, audit_actions)}
