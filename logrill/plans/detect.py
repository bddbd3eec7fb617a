"""Queries over the anomaly signals and the periodic detectors."""

from pyspark.sql import functions as F

from logrill.operators import devices, mix, sequence, signals
from logrill.session import materialize
from logrill.sources import fixture as fx

AS_OF = fx.AS_OF
_DAYS, _MINUTES = 30, 360


def rare_template(spark, sf):
    return signals.rare_template(fx.events(spark, sf)).select("event_id", "rare_template")


def always_severe(spark, sf):
    return signals.always_severe(fx.log_events(spark, sf)).select("event_id", "always_severe")


def security_content(spark, sf):
    return signals.security_content(fx.log_events(spark, sf)).select("event_id", "security_content")


def severity_spike(spark, sf):
    return signals.severity_spike(fx.events(spark, sf)).select("event_id", "severity_spike")


def volume_spike(spark, sf):
    return signals.volume_spike(fx.events(spark, sf), 86400, 7, 3).select("event_id", "volume_spike")


def volume_buckets(spark, sf):
    rows = signals.volume_buckets(fx.events(spark, sf), 86400, 7, 3)
    return rows.withColumn("baseline_per_minute", F.round("baseline_per_minute", 6))


def interface_flapping(spark, sf):
    return signals.interface_flapping(fx.events(spark, sf), 172800, 3).select("event_id", "interface_flapping")


def inline_reasons(spark, sf):
    rows = signals.inline_reasons(fx.events(spark, sf), refresh_seconds=86400, volume_multiplier=3, flap_seconds=172800)
    return rows.select("event_id", F.array_join("anomaly_reasons", ",").alias("reasons"), "is_anomaly")


def retag_by_rule(spark, sf):
    rule = F.col("message").rlike("(?i)authentication.{0,40}failed") | F.col("message").rlike("(?i)login\\s+success")
    rows = signals.retag_by_rule(fx.events(spark, sf), rule, "security_content")
    return rows.select("event_id", F.array_join("anomaly_reasons", ",").alias("reasons"), "is_anomaly")


def _counts(spark, sf):
    return mix.window_template_counts(fx.events(spark, sf), AS_OF, _MINUTES, _DAYS)


def window_template_counts(spark, sf):
    return _counts(spark, sf)


def mix_vectors(spark, sf):
    rows = mix.mix_vectors(_counts(spark, sf), k=4)
    return rows.withColumn("share", F.round("share", 6))


def train_mix_models(spark, sf):
    return mix.train_mix_models(mix.mix_vectors(_counts(spark, sf), k=8), k=8)


def _scored_windows(spark, sf):
    counts = materialize(_counts(spark, sf), "window-counts")
    forest = materialize(mix.train_mix_models(mix.mix_vectors(counts, k=8), k=8), "forest")
    return mix.score_mix_windows(counts, forest, k=8)


def score_mix_windows(spark, sf):
    return _scored_windows(spark, sf)


def unusual_template_mix(spark, sf):
    return mix.unusual_template_mix(fx.events(spark, sf), _scored_windows(spark, sf), _MINUTES)


def _pairs(spark, sf):
    return sequence.transitions(fx.events(spark, sf), AS_OF, _DAYS)


def transitions(spark, sf):
    return _pairs(spark, sf)


def _checkpoint(spark, sf):
    """Scored up to the 24th of January, on every device but each fifth."""
    return fx.seeds(spark, sf).where(F.col("u") % 5 != 0).select(
        fx.device_ip("u").alias("source_ip")).distinct().withColumn(
        "last_scored", F.lit("2024-01-24").cast("timestamp_ntz"))


def _trained(spark, sf):
    """Pairs, vendors, checkpoint and model; what several jobs read is written once."""
    pairs = materialize(_pairs(spark, sf), "pairs")
    vendors = materialize(sequence.known_vendors(fx.events(spark, sf)), "vendors")
    checkpoint = _checkpoint(spark, sf)
    return pairs, vendors, checkpoint, sequence.transition_model(pairs, vendors, checkpoint, 40, 200)


def transition_model(spark, sf):
    return _trained(spark, sf)[-1]


def _scored(spark, sf):
    pairs, vendors, checkpoint, model = _trained(spark, sf)
    return sequence.score_transitions(pairs, materialize(model, "model"), vendors, checkpoint, 0.02)


def score_transitions(spark, sf):
    return _scored(spark, sf).withColumn("transition_probability", F.round("transition_probability", 6))


def scoring_checkpoint(spark, sf):
    return sequence.scoring_checkpoint(_scored(spark, sf))


def unusual_transition(spark, sf):
    return sequence.unusual_transition(fx.events(spark, sf), _scored(spark, sf))


def apply_tags(spark, sf):
    events = fx.events(spark, sf)
    tags = sequence.unusual_transition(events, _scored(spark, sf))
    again = events.where("event_id % 10 = 0").select("event_id", F.lit("always_severe").alias("reason"))
    return signals.apply_tags(events, tags.unionByName(again)).select(
        "event_id", F.array_join("anomaly_reasons", ",").alias("reasons"), "is_anomaly")


def list_anomaly_windows(spark, sf):
    """Windows scored twice: a first version and a later one."""
    counts = _counts(spark, sf).groupBy("source_ip", "vendor", "window_start").agg(
        F.sum("event_count").alias("event_count"))
    first = counts.select(
        "window_start", "source_ip", "vendor", F.lit("vendor").alias("model_scope"), F.lit(0.5).alias("anomaly_score"),
        F.lit(0).alias("is_anomaly"), "event_count", F.lit("2024-01-30").cast("timestamp_ntz").alias("scored_at"))
    second = counts.select(
        "window_start", "source_ip", "vendor", F.lit("device").alias("model_scope"),
        (-F.col("event_count") / 10).alias("anomaly_score"), (F.col("event_count") >= 2).cast("int").alias("is_anomaly"),
        "event_count", F.lit("2024-01-31").cast("timestamp_ntz").alias("scored_at"))
    return devices.list_anomaly_windows(first.unionByName(second), fx.events(spark, sf), AS_OF,
                                        start="2024-01-15", sort="event_count", limit=150, offset=10)


QUERIES = {f.__name__: f for f in (
    rare_template, always_severe, security_content, severity_spike, volume_spike, volume_buckets,
    interface_flapping, inline_reasons, retag_by_rule, window_template_counts, mix_vectors, train_mix_models,
    score_mix_windows, unusual_template_mix, transitions, transition_model, score_transitions,
    scoring_checkpoint, unusual_transition, apply_tags, list_anomaly_windows)}
