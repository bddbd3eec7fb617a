"""All-time summaries of anomalies and categories per device and vendor."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.functions.clock import ntz
from logrill.operators.state import keyed_upsert


def _span():
    return [F.count("*").alias("event_count"), F.min("event_time").alias("first_seen"),
            F.max("event_time").alias("last_seen")]


def _identity():
    return [F.max_by(c, F.struct("event_time", "event_id")).alias(c) for c in ("hostname", "vendor")]


def _exploded(events: DataFrame) -> DataFrame:
    """One row per anomalous event and reason; events without a reason drop out."""
    return events.where("is_anomaly = 1").withColumn("anomaly_reason", F.explode("anomaly_reasons"))


def device_reason_summary(events: DataFrame) -> DataFrame:
    """(device, reason): latest identity, count, first and last time."""
    return _exploded(events).groupBy("source_ip", "anomaly_reason").agg(*_identity(), *_span())


def device_total_anomalies(events: DataFrame) -> DataFrame:
    """Distinct anomalous events per device, however many reasons each has."""
    return (events.where("is_anomaly = 1").groupBy("source_ip").agg(*_identity(), *_span())
            .withColumnRenamed("event_count", "anomaly_event_count"))


def vendor_total_anomalies(events: DataFrame) -> DataFrame:
    return _per_vendor(events.where("is_anomaly = 1"), ["vendor"]).withColumnRenamed(
        "event_count", "anomaly_event_count")


def vendor_reason_summary(events: DataFrame) -> DataFrame:
    return _per_vendor(_exploded(events), ["vendor", "anomaly_reason"])


def device_category_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("source_ip", "predicted_category").agg(*_identity(), *_span())


def vendor_category_summary(events: DataFrame) -> DataFrame:
    return _per_vendor(events, ["vendor", "predicted_category"])


def _per_vendor(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with distinct devices in two steps: per device first, so a vendor
    with most of the rows reaches its single task as one row per device."""
    per_device = rows.groupBy(*keys, "source_ip").agg(*_span())
    return per_device.groupBy(*keys).agg(
        F.count("*").alias("device_count"), F.sum("event_count").alias("event_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def summary_with_acks(summary: DataFrame, acks: DataFrame, users: DataFrame) -> DataFrame:
    """Device-reason summary with who acknowledged it, when and why."""
    named = acks.join(users.select(F.col("id").alias("acknowledged_by"), "username"),
                      "acknowledged_by", "left").select(
        "source_ip", "anomaly_reason", "note", "acknowledged_at",
        F.col("username").alias("acknowledged_by"), F.lit(True).alias("_acked"))
    return (summary.join(named, ["source_ip", "anomaly_reason"], "left")
            .withColumn("acknowledged", F.coalesce("_acked", F.lit(False))).drop("_acked"))


def acknowledge(acks: DataFrame, audit: DataFrame, requests: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Upsert acknowledgments (source_ip, anomaly_reason, note, actor_id) and log them."""
    changes = requests.select(
        "source_ip", "anomaly_reason", "note", F.col("actor_id").alias("acknowledged_by"),
        ntz(at).alias("acknowledged_at"))
    logged = requests.select(
        "actor_id", F.lit("anomaly.acknowledge").alias("action"), _target().alias("target"),
        F.to_json(F.struct("note")).alias("details"), ntz(at).alias("created_at"))
    return (keyed_upsert(acks, changes, ["source_ip", "anomaly_reason"]),
            audit.unionByName(logged, allowMissingColumns=True))


def unacknowledge(acks: DataFrame, audit: DataFrame, requests: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Delete acknowledgments; only those that existed are logged."""
    key = ["source_ip", "anomaly_reason"]
    existing = requests.join(acks.select(*key), key, "left_semi")
    logged = existing.select(
        "actor_id", F.lit("anomaly.unacknowledge").alias("action"), _target().alias("target"),
        F.lit(None).cast("string").alias("details"), ntz(at).alias("created_at"))
    return (acks.join(requests.select(*key), key, "left_anti"),
            audit.unionByName(logged, allowMissingColumns=True))


def _target():
    return F.concat_ws(":", "source_ip", "anomaly_reason")


def reason_ranking(events: DataFrame, reason: str, by: str = "device", n: int = 10) -> DataFrame:
    """Devices or vendors with most events of one reason."""
    one = events.where(F.array_contains("anomaly_reasons", reason))
    if by == "vendor":
        return vendor_reason_summary(one).where(F.col("anomaly_reason") == reason).orderBy(
            F.desc("event_count"), "vendor").limit(n)
    return device_reason_summary(one).where(F.col("anomaly_reason") == reason).orderBy(
        F.desc("event_count"), "source_ip").limit(n)


def other_devices(events: DataFrame, reason: str, source_ip: str, n: int = 10) -> DataFrame:
    """The same ranking without one device."""
    return reason_ranking(events.where(F.col("source_ip") != source_ip), reason, "device", n)


def audit_list(audit: DataFrame, users: DataFrame, actor_id=None, action: str | None = None,
               since=None, contains: str | None = None, n: int = 200) -> DataFrame:
    """Audit entries, newest first; entries of removed users stay."""
    rows = audit
    if actor_id is not None:
        rows = rows.where(F.col("actor_id") == actor_id)
    if action is not None:
        rows = rows.where(F.col("action") == action)
    if since is not None:
        rows = rows.where(F.col("created_at") >= ntz(since))
    if contains:
        needle = contains.lower()
        rows = rows.where(F.contains(F.lower("action"), F.lit(needle))
                          | F.contains(F.lower("target"), F.lit(needle)))
    named = rows.join(
        users.select(F.col("id").alias("actor_id"), F.col("username").alias("actor_username")),
        "actor_id", "left")
    return named.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def audit_actions(audit: DataFrame) -> DataFrame:
    return audit.select("action").distinct().orderBy("action")
