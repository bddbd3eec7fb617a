"""Alert rules over trailing windows, their history, and small control lists."""

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.functions.clock import MICROS, micros, ntz, plus_seconds, seconds_between
from logrill.functions.text import contains_ci
from logrill.operators.search import as_datetime, in_range
from logrill.operators.state import keyed_upsert

# ---- fixed values ----
RULE_FIELDS = ("hostname", "source_ip", "program", "severity", "predicted_category")
# ---- end of fixed values ----

_SELECTORS = [f"_f{i}" for i in range(len(RULE_FIELDS))]


def _rule_keys(rules: DataFrame) -> DataFrame:
    """Which fields a rule sets (as bits) and their values, '' for a wildcard."""
    mask = F.lit(0)
    for i, field in enumerate(RULE_FIELDS):
        mask = mask + F.when(F.coalesce(field, F.lit("")) != "", 1 << i).otherwise(0)
    return rules.withColumn("_mask", mask).withColumns(
        {s: F.coalesce(f, F.lit("")) for s, f in zip(_SELECTORS, RULE_FIELDS)})


def _matches(events: DataFrame, enabled: DataFrame, bucket) -> DataFrame:
    """Counts (_n), sample and first moment per rule id and bucket of time.

    Wildcards would make this a theta join of all events with all rules. Events
    are first counted per distinct value set and bucket, then each count is keyed
    by the field combinations in use (at most 32), summed per key, and meets the
    rules in an equi-join.
    """
    moment = F.struct("event_time", "event_id")
    counts = events.groupBy(*RULE_FIELDS, "is_anomaly", bucket.alias("_bucket")).agg(
        F.count("*").alias("_n"), F.min_by("message", moment).alias("_sample"), F.min(moment).alias("_first"))
    used = F.broadcast(enabled.select("_mask").distinct())  # at most 2^5 rows
    keyed = counts.withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(RULE_FIELDS) - 1))))
    keyed = keyed.join(used, "_mask", "left_semi").withColumns({
        s: F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f)).otherwise("")
        for i, (s, f) in enumerate(zip(_SELECTORS, RULE_FIELDS))}).drop(*RULE_FIELDS)
    keyed = keyed.groupBy("_mask", *_SELECTORS, "is_anomaly", "_bucket").agg(
        F.sum("_n").alias("_n"), F.min_by("_sample", "_first").alias("_sample"), F.min("_first").alias("_first"))
    return keyed.join(
        enabled.select("id", "_mask", *_SELECTORS, "window_minutes", "only_anomalies"), ["_mask", *_SELECTORS]
    ).where(~F.col("only_anomalies") | (F.col("is_anomaly") == 1))


def _judged(enabled: DataFrame, matched: DataFrame, as_of) -> DataFrame:
    """Per rule: what its window holds, whether it cools down, whether it fires. matched: id, _n, _sample, _first."""
    totals = matched.groupBy("id").agg(
        F.sum("_n").alias("_matched"), F.min_by("_sample", "_first").alias("_sample"))
    waited = seconds_between("last_triggered_at", ntz(as_of)) >= F.col("cooldown_minutes") * 60
    cooling = F.col("last_triggered_at").isNotNull() & ~F.coalesce(waited, F.lit(True))
    matched_count = F.coalesce("_matched", F.lit(0))
    return enabled.join(totals, "id", "left").select(
        "id", "name", "window_minutes", "threshold",
        plus_seconds(ntz(as_of), -60 * F.col("window_minutes")).alias("window_start"),
        ntz(as_of).alias("window_end"), matched_count.alias("matched_count"),
        F.coalesce("_sample", F.lit("")).alias("sample_message"),
        cooling.alias("in_cooldown"),
        (~cooling & (matched_count >= F.col("threshold"))).alias("fires"))


def evaluate_alerts(events: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """Per enabled rule: matches in its window, one sample, whether it fires.

    The scan reaches back as far as the longest window among the rules.
    """
    enabled = _rule_keys(rules.where("enabled"))
    end = as_datetime(as_of)
    widest = enabled.agg(F.max("window_minutes")).first()[0] or 0  # the control list is small
    recent = in_range(events, end - timedelta(minutes=widest), end)
    # an event lies in a window of w minutes exactly when its age, rounded up, is at most w
    age = F.ceil((micros(ntz(as_of)) - micros("event_time")) / F.lit(60 * MICROS))
    matched = _matches(recent, enabled, age).where(F.col("_bucket") <= F.col("window_minutes"))
    return _judged(enabled, matched, as_of)


MINUTES = "id long, minute long, _n long, _sample string, _first struct<event_time: timestamp_ntz, event_id: bigint>"


def minute_counts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches per enabled rule and minute: what an incremental evaluation keeps of new events."""
    minute = F.floor(micros("event_time") / F.lit(60 * MICROS)).cast("long")
    matched = _matches(events, _rule_keys(rules.where("enabled")), minute)
    return matched.select("id", F.col("_bucket").alias("minute"), F.col("_n").cast("long").alias("_n"), "_sample", "_first")


def merge_minutes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("id", "minute").agg(
        F.sum("_n").alias("_n"), F.min_by("_sample", "_first").alias("_sample"), F.min("_first").alias("_first"))


def evaluate_minutes(counts: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """evaluate_alerts from minute_counts, as of a whole minute; events of that moment and later do not count yet."""
    enabled = _rule_keys(rules.where("enabled"))
    now = F.floor(micros(ntz(as_of)) / F.lit(60 * MICROS))
    inside = counts.join(enabled.select("id", "window_minutes"), "id").where(
        (F.col("minute") < now) & (F.col("minute") >= now - F.col("window_minutes")))
    return _judged(enabled, inside, as_of)


def fire_alerts(evaluated: DataFrame, rules: DataFrame, history: DataFrame, as_of
                ) -> tuple[DataFrame, DataFrame]:
    """Append a firing per rule that fires, start its cool-down."""
    fired = evaluated.where("fires")
    rows = fired.select(
        F.col("id").alias("rule_id"), ntz(as_of).alias("triggered_at"), "window_start", "window_end",
        "matched_count", "sample_message")
    stamped = rules.join(fired.select("id"), "id", "left_semi").withColumn("last_triggered_at", ntz(as_of))
    return (history.unionByName(rows, allowMissingColumns=True),
            keyed_upsert(rules, stamped.select(*rules.columns), ["id"]))


def alert_history(history: DataFrame, rule_id: int | None = None, n: int = 100) -> DataFrame:
    rows = history if rule_id is None else history.where(F.col("rule_id") == rule_id)
    return rows.orderBy(F.desc("triggered_at"), F.desc("id")).limit(n)


def alert_history_report(history: DataFrame, rules: DataFrame, rule_id: int | None = None) -> DataFrame:
    """Every firing with the name of its rule."""
    rows = history if rule_id is None else history.where(F.col("rule_id") == rule_id)
    return rows.join(rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name")), "rule_id")


def list_rules(rules: DataFrame, name_like: str | None = None) -> DataFrame:
    rows = rules.where(contains_ci("name", name_like)) if name_like else rules
    return rows.orderBy("name")


def list_relays(relays: DataFrame, ip_like: str | None = None) -> DataFrame:
    rows = relays.where(contains_ci("ip", ip_like)) if ip_like else relays
    return rows.orderBy("ip")
