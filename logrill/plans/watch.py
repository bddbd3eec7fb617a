"""Queries over silence, incidents, alerts and the digest."""

from pyspark.sql import functions as F

from logrill.operators import alerts, digest, incidents, silence
from logrill.sources import fixture as fx

AS_OF = fx.AS_OF
_SILENCE = {"multiplier": 3, "floor_minutes": 30}
_BUCKETS = {"bucket_minutes": 240, "multiplier": 1.5, "min_devices": 5}


def _activity(spark, sf):
    return silence.device_activity(fx.events(spark, sf), AS_OF, days=30, min_events=20)


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def device_activity(spark, sf):
    return _round(_activity(spark, sf), "expected_interval_minutes")


def silent_devices(spark, sf):
    return _round(silence.silent_devices(_activity(spark, sf), AS_OF, **_SILENCE),
                  "expected_interval_minutes", "silence_minutes")


def silence_transitions(spark, sf):
    rows = silence.silence_transitions(_activity(spark, sf), fx.silence_state(spark, sf), AS_OF, **_SILENCE)
    return _round(rows, "expected_interval_minutes", "minutes")


def silence_state_after(spark, sf):
    rows = silence.silence_transitions(_activity(spark, sf), fx.silence_state(spark, sf), AS_OF, **_SILENCE)
    return _round(silence.state_after(rows), "expected_interval_minutes")


def list_silent(spark, sf):
    return _round(silence.list_silent(fx.silence_state(spark, sf), AS_OF, "NODE-1"), "silent_minutes")


def bucket_device_counts(spark, sf):
    return incidents.bucket_device_counts(fx.events(spark, sf), "2024-01-24", AS_OF, 240)


def bucket_baseline(spark, sf):
    return incidents.bucket_baseline(fx.events(spark, sf), "2024-01-24", 240)


def elevated_spans(spark, sf):
    ev = fx.events(spark, sf)
    return incidents.elevated_spans(
        incidents.bucket_device_counts(ev, "2024-01-24", AS_OF, 240),
        incidents.bucket_baseline(ev, "2024-01-24", 240), **_BUCKETS)


def correlate_incidents(spark, sf):
    rows = incidents.correlate_incidents(fx.events(spark, sf), "2024-01-24", AS_OF, **_BUCKETS)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("devices_affected", "anomaly_reasons_seen")})


def incident_events(spark, sf):
    rows = incidents.incident_events(fx.events(spark, sf), "2024-01-24", AS_OF, **_BUCKETS)
    return rows.withColumn("anomaly_reasons", F.array_join(F.array_sort("anomaly_reasons"), ","))


def evaluate_alerts(spark, sf):
    return alerts.evaluate_alerts(fx.events(spark, sf), fx.alert_rules(spark, sf), "2024-01-30 23:00:00")


def fire_alerts(spark, sf):
    at = "2024-01-30 23:00:00"
    rules, history = fx.alert_rules(spark, sf), fx.alert_events(spark, sf)
    evaluated = alerts.evaluate_alerts(fx.events(spark, sf), rules, at)
    new_history, new_rules = alerts.fire_alerts(evaluated, rules, history, at)
    per_rule = new_history.groupBy("rule_id").agg(
        F.count("*").alias("firings"), F.max("triggered_at").alias("last_firing"))
    return new_rules.select("id", "last_triggered_at").join(
        per_rule.withColumnRenamed("rule_id", "id"), "id", "left")


def alert_history(spark, sf):
    return alerts.alert_history(fx.alert_events(spark, sf), rule_id=5, n=200)


def alert_history_report(spark, sf):
    return alerts.alert_history_report(fx.alert_events(spark, sf), fx.alert_rules(spark, sf))


def list_rules(spark, sf):
    return alerts.list_rules(fx.alert_rules(spark, sf), "NATION_1")


def list_relays(spark, sf):
    return alerts.list_relays(fx.relays(spark, sf), "10.0.0.")


def digest_totals(spark, sf):
    return digest.digest_totals(fx.events(spark, sf), "2024-01-30 12:00:00", 72)


def digest_reasons(spark, sf):
    return digest.digest_reasons(fx.events(spark, sf), "2024-01-30 12:00:00", 72)


def digest_top_devices(spark, sf):
    return digest.digest_top_devices(fx.events(spark, sf), "2024-01-30 12:00:00", 72)


def digest_alerts(spark, sf):
    return digest.digest_alerts(fx.alert_events(spark, sf), fx.alert_rules(spark, sf), "1998-06-30", 24 * 30)


def digest_silent(spark, sf):
    return digest.digest_silent(fx.silence_state(spark, sf))


def digest_lines(spark, sf):
    return digest.digest_lines(fx.events(spark, sf), fx.alert_events(spark, sf), fx.alert_rules(spark, sf),
                               fx.silence_state(spark, sf), "2024-01-30 12:00:00", 72)


QUERIES = {f.__name__: f for f in (
    device_activity, silent_devices, silence_transitions, silence_state_after, list_silent,
    bucket_device_counts, bucket_baseline, elevated_spans, correlate_incidents, incident_events,
    evaluate_alerts, fire_alerts, alert_history, alert_history_report, list_rules, list_relays,
    digest_totals, digest_reasons, digest_top_devices, digest_alerts, digest_silent, digest_lines)}
