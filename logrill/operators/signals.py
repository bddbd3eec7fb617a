"""The anomaly signals, and tagging events with them afterwards."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrill.functions import text
from logrill.functions.clock import MICROS, bucket_no, micros, minute_boundaries
from logrill.functions.hotkeys import Running, SLICE_ROWS, running


def reasons_array(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def rare_template(events: DataFrame, threshold: int = 5, seen: DataFrame | None = None) -> DataFrame:
    """Flag the first ``threshold`` events a template ever had.

    ``seen``: (template_id, n), how many events it had before these. The cut-off per template comes from ``row_number <= threshold``, which Spark
    prunes before the shuffle, so a template with most rows costs nothing extra.
    """
    first = Window.partitionBy("template_id").orderBy("event_time", "event_id")
    cutoff = (
        events.select("template_id", "event_time", "event_id")
        .withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= threshold)
    )
    if seen is not None:
        cutoff = cutoff.join(seen, "template_id", "left").where(F.col("_rn") + F.coalesce("n", F.lit(0)) <= threshold)
    cutoff = cutoff.groupBy("template_id").agg(F.max(F.struct("event_time", "event_id")).alias("_cut"))
    rare = F.struct("event_time", "event_id") <= F.col("_cut")
    return events.join(cutoff, "template_id", "left").withColumn("rare_template", rare).drop("_cut")


def always_severe(events: DataFrame) -> DataFrame:
    return events.withColumn("always_severe", text.is_always_severe("severity"))


def security_content(events: DataFrame) -> DataFrame:
    return events.withColumn("security_content", text.is_security_content("message"))


RANKS = range(8)


def latest_by_rank(events: DataFrame) -> DataFrame:
    """(source_ip, last0 .. last7): when a device last logged at that rank or worse, in microseconds."""
    return events.groupBy("source_ip").agg(*[
        F.max(F.when(F.col("severity_num") <= r, micros("event_time"))).alias(f"last{r}") for r in RANKS])


def severity_spike(events: DataFrame, days: int = 7, slice_rows: int = SLICE_ROWS,
                   earlier: DataFrame | None = None) -> DataFrame:
    """Flag events more severe than all the device logged in the days before.

    For each rank the latest earlier time with that rank or worse is a running
    maximum, so the frame never has to be rescanned; the event is a spike when
    its own rank was last reached before the period, and history exists.
    ``earlier``: ``latest_by_rank`` of the events before these.
    """
    width = days * 86400 * MICROS
    now = micros("event_time")
    items = [
        Running(f"_last{r}", F.when(F.col("severity_num") <= r, now), "max", include_current=False)
        for r in RANKS
    ]
    out = running(events, ["source_ip"], "event_time", "event_id", items, slice_rows)
    if earlier is not None:
        named = earlier.withColumnRenamed("source_ip", "_device")
        out = out.join(named, F.col("source_ip").eqNullSafe(F.col("_device")), "left").withColumns({
            f"_last{r}": F.greatest(f"_last{r}", f"last{r}") for r in RANKS}).drop(*named.columns)
    same_or_worse = F.element_at(F.array(*[F.col(f"_last{r}") for r in RANKS]), F.col("severity_num") + 1)
    history = F.coalesce(F.col("_last7") >= now - width, F.lit(False))
    reached = F.coalesce(same_or_worse >= now - width, F.lit(False))
    return out.withColumn("severity_spike", history & ~reached).drop(*[f"_last{r}" for r in RANKS])


def device_counts(events: DataFrame, refresh_seconds: int = 600) -> DataFrame:
    """Per device and refresh interval: events, and the first and last time."""
    return events.groupBy(
        "source_ip", bucket_no("event_time", refresh_seconds).alias("bucket")).agg(
        F.count("*").alias("events"), F.min("event_time").alias("_first"), F.max("event_time").alias("_last"))


def merge_device_counts(counts: DataFrame) -> DataFrame:
    """The same from several partial ``device_counts``."""
    return counts.groupBy("source_ip", "bucket").agg(
        F.sum("events").alias("events"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))


def volume_buckets(events: DataFrame, refresh_seconds: int = 600, days: int = 7,
                   multiplier: float = 5, counts: DataFrame | None = None) -> DataFrame:
    """Per device and refresh interval: does the rate spike against the baseline.

    Works on one pre-aggregated row per device and interval; the baseline frame
    holds at most ``days / refresh`` of those. ``counts``: ``device_counts`` that
    also cover earlier events; by default those of ``events``.
    """
    width = days * 86400 // refresh_seconds
    counts = device_counts(events, refresh_seconds) if counts is None else counts
    past = Window.partitionBy("source_ip").orderBy("bucket").rangeBetween(-width, -1)
    base = counts.select(
        "source_ip", "bucket", "events", F.sum("events").over(past).alias("_base"),
        F.min("_first").over(past).alias("_from"), F.max("_last").over(past).alias("_to"))
    rate = F.col("_base") / F.greatest(minute_boundaries("_from", "_to"), F.lit(1))
    return base.select(
        "source_ip", "bucket", "events", rate.alias("baseline_per_minute"),
        F.coalesce(F.col("events") / F.lit(refresh_seconds / 60.0) >= rate * multiplier, F.lit(False))
        .alias("spiking"))


def volume_spike(events: DataFrame, refresh_seconds: int = 600, days: int = 7,
                 multiplier: float = 5, counts: DataFrame | None = None) -> DataFrame:
    """Flag the events of the interval after one that spiked."""
    flagged = volume_buckets(events, refresh_seconds, days, multiplier, counts).where("spiking").select(
        "source_ip", (F.col("bucket") + 1).alias("_bucket"), F.lit(True).alias("_spiking"))
    return (
        events.withColumn("_bucket", bucket_no("event_time", refresh_seconds))
        .join(flagged, ["source_ip", "_bucket"], "left")
        .withColumn("volume_spike", F.coalesce("_spiking", F.lit(False)))
        .drop("_bucket", "_spiking")
    )


def interface_flapping(events: DataFrame, window_seconds: int = 900, min_downs: int = 3,
                       slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Flag a "down" when the interface went down often enough in the window.

    Looks at the down ``min_downs - 1`` before this one instead of counting a
    sliding frame. The flag is set in place on the down messages; all others
    pass by, so repeated ids neither multiply rows nor share a flag.
    """
    parsed = events.withColumns({"_iface": text.interface_name("message"), "_state": text.interface_state("message")})
    down = F.coalesce(F.col("_state") == "down", F.lit(False))
    before = Running("_before", micros("event_time"), "lag", n=min_downs - 1)
    downs = running(parsed.where(down), ["source_ip", "_iface"], "event_time", "event_id", [before], slice_rows)
    near = micros("event_time") - F.col("_before") <= window_seconds * MICROS
    flagged = downs.withColumn("interface_flapping", F.coalesce(near, F.lit(False)))
    others = parsed.where(~down).withColumn("interface_flapping", F.lit(False))
    columns = [*events.columns, "interface_flapping"]
    return flagged.select(*columns).unionByName(others.select(*columns))


def inline_reasons(events: DataFrame, rare_threshold: int = 5, baseline_days: int = 7,
                   refresh_seconds: int = 600, volume_multiplier: float = 5,
                   flap_seconds: int = 900, min_downs: int = 3) -> DataFrame:
    """The six signals known when an event arrives -> ``anomaly_reasons``, ``is_anomaly``."""
    flagged = severity_spike(events, baseline_days)
    flagged = volume_spike(flagged, refresh_seconds, baseline_days, volume_multiplier)
    flagged = rare_template(flagged, rare_threshold)
    flagged = interface_flapping(flagged, flap_seconds, min_downs)
    return named_reasons(flagged)


def named_reasons(flagged: DataFrame) -> DataFrame:
    """The flags of the four signals with history, and the two without -> ``anomaly_reasons``, ``is_anomaly``."""
    names = ("rare_template", "severity_spike", "volume_spike", "interface_flapping")
    reasons = reasons_array({
        "rare_template": F.col("rare_template"),
        "always_severe": text.is_always_severe("severity"),
        "security_content": text.is_security_content("message"),
        "severity_spike": F.col("severity_spike"),
        "volume_spike": F.col("volume_spike"),
        "interface_flapping": F.col("interface_flapping"),
    })
    return (
        flagged.withColumn("anomaly_reasons", reasons)
        .withColumn("is_anomaly", (F.size("anomaly_reasons") > 0).cast("int")).drop(*names)
    )


def apply_tags(events: DataFrame, tags: DataFrame) -> DataFrame:
    """Append late reasons (event_id, reason) unless present.

    The tags stay a table of their own and are merged on read; the join key is
    unique on the event side, so no device can skew it.
    """
    per_event = tags.groupBy("event_id").agg(F.array_sort(F.collect_set("reason")).alias("_tags"))
    joined = events.join(per_event, "event_id", "left")
    merged = F.when(F.col("_tags").isNull(), F.col("anomaly_reasons")).otherwise(
        F.array_union("anomaly_reasons", "_tags"))
    return joined.withColumn("anomaly_reasons", merged).withColumn(
        "is_anomaly", F.when(F.col("_tags").isNotNull(), 1).otherwise(F.col("is_anomaly"))).drop("_tags")


def retag_by_rule(events: DataFrame, predicate: Column, reason: str) -> DataFrame:
    """Backfill one reason on the rows a rule selects; running it again changes nothing."""
    missing = predicate & ~F.array_contains("anomaly_reasons", reason)
    return events.withColumns({
        "anomaly_reasons": F.when(missing, F.array_append("anomaly_reasons", F.lit(reason)))
        .otherwise(F.col("anomaly_reasons")),
        "is_anomaly": F.when(missing, 1).otherwise(F.col("is_anomaly")),
    })
