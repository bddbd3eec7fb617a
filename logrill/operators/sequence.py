"""Order of templates per device: transition model and unlikely transitions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.functions.clock import ntz, plus_seconds
from logrill.functions.hotkeys import SLICE_ROWS, previous

MIN_TRANSITIONS = 200
PROBABILITY_THRESHOLD = 0.005
TASK_ROWS = 200_000  # transitions of a task: equal texts compress so well that bytes shuffled say little of its memory


def known_vendors(events: DataFrame) -> DataFrame:
    """The vendor of each device, if any event names one."""
    return events.where(F.col("vendor") != "unknown").groupBy("source_ip").agg(
        F.max("vendor").alias("vendor"))


def transitions(events: DataFrame, as_of, days: int = 7, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Consecutive template pairs of each device."""
    recent = events.where(F.col("event_time") >= plus_seconds(ntz(as_of), -86400 * days)).select(
        "source_ip", "event_time", "event_id", F.col("template_id").alias("curr_template_id"))
    pairs = previous(recent, ["source_ip"], "event_time", "event_id",
                     {"prev_template_id": "curr_template_id"}, slice_rows)
    return pairs.where(F.col("prev_template_id").isNotNull()).select(
        "source_ip", "event_id", F.col("event_time").alias("transition_time"), "prev_template_id",
        "curr_template_id")


def _hashed(side: DataFrame) -> DataFrame:
    """The side of a join that has a row per device or model: hashed in its partition, so the transitions beside it
    need no sort; never broadcast, as equal texts make a small file of a table that is large in memory."""
    return side.hint("shuffle_hash")


def _marked(pairs: DataFrame, checkpoint: DataFrame | None) -> DataFrame:
    """Add ``_last``: when the device was last scored, null if never."""
    if checkpoint is None:
        return pairs.withColumn("_last", F.lit(None).cast("timestamp_ntz"))
    return pairs.join(_hashed(checkpoint.select("source_ip", F.col("last_scored").alias("_last"))), "source_ip", "left")


def transition_model(pairs: DataFrame, vendors: DataFrame, checkpoint: DataFrame | None = None,
                     min_device: int = MIN_TRANSITIONS, min_vendor: int = MIN_TRANSITIONS) -> DataFrame:
    """Counts per scope (device or vendor), from transitions already scored.

    Rows: model_scope, scope_key, prev, curr, transitions, prev_total, vocabulary.
    Scopes with too few transitions are left out. Everything after the first
    count works on distinct (device, prev, curr).
    """
    prior = _marked(pairs, checkpoint).where(
        F.col("_last").isNull() | (F.col("transition_time") <= F.col("_last")))
    keys = ["prev_template_id", "curr_template_id"]
    per_device = prior.groupBy("source_ip", *keys).agg(F.count("*").alias("transitions"))
    per_vendor = per_device.join(_hashed(vendors), "source_ip").groupBy("vendor", *keys).agg(
        F.sum("transitions").alias("transitions"))
    counts = per_device.select(
        F.lit("device").alias("model_scope"), F.col("source_ip").alias("scope_key"), *keys, "transitions"
    ).unionByName(per_vendor.select(
        F.lit("vendor").alias("model_scope"), F.col("vendor").alias("scope_key"), *keys, "transitions"))
    scope = ["model_scope", "scope_key"]
    sizes = counts.groupBy(*scope).agg(
        F.sum("transitions").alias("_total"), F.countDistinct("curr_template_id").alias("vocabulary"))
    needed = F.when(F.col("model_scope") == "device", min_device).otherwise(min_vendor)
    sizes = sizes.where(F.col("_total") >= needed).drop("_total")
    per_prev = counts.groupBy(*scope, "prev_template_id").agg(F.sum("transitions").alias("prev_total"))
    return counts.join(_hashed(per_prev), [*scope, "prev_template_id"]).join(_hashed(sizes), scope)


def score_transitions(pairs: DataFrame, model: DataFrame, vendors: DataFrame,
                      checkpoint: DataFrame | None = None,
                      threshold: float = PROBABILITY_THRESHOLD) -> DataFrame:
    """Smoothed probability of each new transition, by the device's own model or
    else its vendor's; devices with neither are left out."""
    new = _marked(pairs, checkpoint).where(
        F.col("_last").isNull() | (F.col("transition_time") > F.col("_last"))).drop("_last")
    scope = ["model_scope", "scope_key"]
    sizes = model.select(*scope, "vocabulary").distinct()
    own = sizes.where("model_scope = 'device'").select(
        F.col("scope_key").alias("source_ip"), F.lit(True).alias("_own"))
    pooled = sizes.where("model_scope = 'vendor'").select(
        F.col("scope_key").alias("vendor"), F.lit(True).alias("_pooled"))
    # probabilities per distinct (device, prev, curr), then one join to the events
    step = ["source_ip", "prev_template_id", "curr_template_id"]
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // TASK_ROWS))
    new = new.repartition(tasks, *step)
    distinct = new.select(*step).distinct()
    chosen = distinct.join(_hashed(vendors), "source_ip", "left").join(_hashed(own), "source_ip", "left").join(
        pooled, "vendor", "left").where(F.col("_own") | F.col("_pooled")).select(
        "source_ip", "prev_template_id", "curr_template_id",
        F.coalesce("vendor", F.lit("unknown")).alias("vendor"),
        F.when(F.col("_own"), "device").otherwise("vendor").alias("model_scope"),
        F.when(F.col("_own"), F.col("source_ip")).otherwise(F.col("vendor")).alias("scope_key"))
    totals = model.select(*scope, "prev_template_id", "prev_total").distinct()
    place = [*scope, "prev_template_id"]
    likely = (
        chosen.join(_hashed(sizes), scope).repartition(tasks, *place)
        .join(_hashed(totals.repartition(tasks, *place)), place, "left")
        .join(model.select(*place, "curr_template_id", "transitions").repartition(tasks, *place).hint("merge"),
              [*place, "curr_template_id"], "left")
    )
    probability = (F.coalesce("transitions", F.lit(0)) + 1.0) / (
        F.coalesce("prev_total", F.lit(0)) + F.greatest("vocabulary", F.lit(1)))
    table = likely.select("source_ip", "prev_template_id", "curr_template_id", "vendor", "model_scope",
                          probability.alias("transition_probability"))
    scored = new.join(table.repartition(tasks, *step).hint("merge"), step)
    return scored.withColumn(
        "is_anomaly", (F.col("transition_probability") < threshold).cast("int"))


def scoring_checkpoint(scored: DataFrame, key: str = "source_ip", ts: str = "transition_time") -> DataFrame:
    return scored.groupBy(key).agg(F.max(ts).alias("last_scored"))


def unusual_transition(events: DataFrame, scored: DataFrame) -> DataFrame:
    """Tags (event_id, reason) for the events that completed a flagged transition."""
    flagged = scored.where("is_anomaly = 1").select(
        "source_ip", F.col("transition_time").alias("event_time"),
        F.col("curr_template_id").alias("template_id")).distinct()
    return events.join(flagged, ["source_ip", "event_time", "template_id"], "left_semi").select(
        "event_id", F.lit("unusual_transition").alias("reason"))
