"""Streaming jobs: ingest, rollup, index and alerts, as micro-batches."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrill.functions import text
from logrill.functions.clock import MICROS, micros, ntz, plus_seconds
from logrill.operators import alerts, enrich, rollup, signals, state
from logrill.operators.search import as_datetime
from logrill.session import numbers_below, remove
from logrill.sources import tables


def label(raw: DataFrame, inventory: DataFrame, relays: DataFrame, received_at="received_at") -> DataFrame:
    """Raw records -> labelled events: defaults, identity, vendor, category, template
    and the reasons that need no history. Works on batches and on micro-batches."""
    typed = enrich.fix_relay_timezone(enrich.normalize_record(raw, received_at), relays)
    if "event_id" not in typed.columns:
        typed = typed.withColumn("event_id", F.xxhash64("event_time", "source_ip", "program", "message", "raw"))
    located = enrich.resolve_identity(typed, inventory, relays).withColumns({
        "template": text.mask_template("message"), "predicted_category": text.weak_label("message"),
        "predicted_confidence": F.lit(0.0),
        "anomaly_reasons": signals.reasons_array({
            "always_severe": text.is_always_severe("severity"),
            "security_content": text.is_security_content("message")})})
    return located.withColumns({
        "template_id": F.md5("template"), "is_anomaly": (F.size("anomaly_reasons") > 0).cast("int")})


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None):
    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "2 seconds"})).start())


def stream_ingest(raw: DataFrame, inventory: Callable[[], DataFrame], relays: Callable[[], DataFrame],
                  path: str, checkpoint: str, trigger: dict | None = None):
    """Label and append. The small dimension tables are read anew for each batch.

    The position in the input advances after the write, so a batch is written at
    least once.
    """
    def each(batch, _):
        timed = batch if "received_at" in batch.columns else batch.withColumn(
            "received_at", F.current_timestamp().cast("timestamp_ntz"))
        tables.write_events(label(timed, inventory(), relays()), path)

    return _run(raw, each, checkpoint, trigger)


def stream_rollup(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append each batch's partial counts per minute; readers sum them with
    ``rollup.merge_rollups``. Nothing waits for a watermark and late rows count.

    Each batch has a folder of its own that a retry overwrites.
    """
    def each(batch, number):
        rollup.events_by_minute(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _run(events, each, checkpoint, trigger)


def windowed_rollup(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same as a watermarked aggregation, for append sinks that want closed minutes.

    A row that comes later than `delay` behind the newest changes no minute; see
    late_rows. Watermarks want zoned times, and the session's zone is UTC.
    """
    zoned = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    windowed = zoned.withWatermark("event_time", delay).groupBy(
        F.window("event_time", "1 minute"), "hostname", "vendor", "severity", "predicted_category")
    return windowed.agg(
        F.count("*").alias("event_count"), F.sum("is_anomaly").alias("anomaly_count"),
        F.sum((F.col("resolution_method") == "unresolved").cast("long")).alias("unresolved_count")
    ).select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "hostname", "vendor", "severity", "predicted_category",
             "event_count", "anomaly_count", "unresolved_count")


def late_rows(query) -> int:
    """How many rows a watermarked query has left out because they came too late."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return rollup.merge_rollups(spark.read.parquet(path))


def index_documents(events: DataFrame) -> DataFrame:
    return events.select(
        text.doc_id().alias("doc_id"), "event_time", "received_at", "source_ip", "hostname", "vendor", "program",
        "severity", "predicted_category", "is_anomaly", "anomaly_reasons", "message",
        text.embedding_text().alias("embedding_text"))


def with_heartbeat(events: DataFrame, rows_per_second: int = 1) -> DataFrame:
    """The same rows, with a batch at every trigger, also when no event has come."""
    beat = events.sparkSession.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return events.unionByName(beat.where("false").select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]))


COMPACT_EVERY = 16


def stream_index(events: DataFrame, path: str, checkpoint: str, as_of: Callable[[], object],
                 lag_minutes: int = 40, anomalies_only: bool = False, trigger: dict | None = None,
                 compact_every: int = COMPACT_EVERY, heartbeat: bool = False):
    """Index events once they are old enough for late reasons to have landed.

    Rows younger than the lag wait in a table of their own and are looked at
    again with the next batch; `heartbeat` makes batches come on a quiet stream,
    too. Every batch writes versioned folders, so a retry overwrites its own and
    nothing else. Every `compact_every`-th batch writes the whole index anew;
    what it replaces goes with the batch after it, when it is sure to be complete.
    """
    def each(batch, number):
        spark = batch.sparkSession
        if number > 1:
            replaced = number - 1 if (number - 1) % compact_every == 0 else 0
            for folder, end in (("docs", replaced), ("waiting", number - 1)):
                for old in numbers_below(spark, f"{path}/{folder}"):
                    if old < end:
                        remove(spark, f"{path}/{folder}/v={old}")
        waiting = batch
        if number > 0:
            waiting = spark.read.schema(batch.schema).parquet(f"{path}/waiting/v={number - 1}").unionByName(batch)
        final = F.col("received_at") <= plus_seconds(ntz(as_of()), -60 * lag_minutes)
        ready = waiting.where(final)
        if anomalies_only:
            ready = ready.where("is_anomaly = 1")
        docs = index_documents(ready).dropDuplicates(["doc_id"])
        if number and number % compact_every == 0:
            older = spark.read.schema(docs.schema).parquet(
                *[f"{path}/docs/v={v}" for v in numbers_below(spark, f"{path}/docs") if v < number])
            older = older.withColumn("v", F.regexp_extract(F.input_file_name(), r"/v=(\d+)/", 1).cast("long"))
            docs = state.latest_version(older.unionByName(docs.withColumn("v", F.lit(number).cast("long"))), ["doc_id"], ["v"]).drop("v")
        docs.write.mode("overwrite").parquet(f"{path}/docs/v={number}")
        waiting.where(~final).write.mode("overwrite").parquet(f"{path}/waiting/v={number}")

    return _run(with_heartbeat(events) if heartbeat else events, each, checkpoint, trigger)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index: of equal documents the one written last."""
    docs = spark.read.parquet(f"{path}/docs")
    return state.latest_version(docs, ["doc_id"], ["v"]).drop("v")


def stream_alerts(events: DataFrame, rules: Callable[[], DataFrame], as_of: Callable[[], object],
                  path: str, checkpoint: str, trigger: dict | None = None, heartbeat: bool = False):
    """Count each batch's events per rule and minute, and fire the rules whose windows are full.

    Only new events are read: earlier ones live on as counts per rule and minute
    of the longest window, and the last firing of each rule starts its cool-down.
    Rules are evaluated as of the last whole minute; a new rule counts from the
    batch that first sees it. All is kept in versioned folders that a retry
    overwrites, of which the last two are needed.
    """
    def each(batch, number):
        spark = batch.sparkSession
        now = as_datetime(as_of()).replace(second=0, microsecond=0)
        current = rules()
        counts = alerts.minute_counts(batch, current)
        widest = current.where("enabled").agg(F.max("window_minutes")).first()[0] or 0
        last = current.select("id", "last_triggered_at")
        if number > 0:
            counts = counts.unionByName(spark.read.schema(alerts.MINUTES).parquet(f"{path}/minutes/v={number - 1}"))
            before = spark.read.schema("id long, _fired timestamp_ntz").parquet(f"{path}/last/v={number - 1}")
            last = last.join(before, "id", "left").select(
                "id", F.greatest("last_triggered_at", "_fired").alias("last_triggered_at"))
        oldest = F.floor(micros(ntz(now)) / F.lit(60 * MICROS)) - widest
        alerts.merge_minutes(counts).where(F.col("minute") >= oldest).write.mode("overwrite").parquet(f"{path}/minutes/v={number}")
        kept = spark.read.schema(alerts.MINUTES).parquet(f"{path}/minutes/v={number}")
        known = current.drop("last_triggered_at").join(last, "id").select(*current.columns)
        alerts.evaluate_minutes(kept, known, now).where("fires").write.mode("overwrite").parquet(f"{path}/fired/v={number}")
        fired = spark.read.parquet(f"{path}/fired/v={number}").select("id", F.col("window_end").alias("_new"))
        last.join(fired, "id", "left").select("id", F.coalesce("_new", "last_triggered_at").alias("_fired")).write.mode(
            "overwrite").parquet(f"{path}/last/v={number}")
        for folder in ("minutes", "last"):
            for old in numbers_below(spark, f"{path}/{folder}"):
                if old < number - 1:
                    remove(spark, f"{path}/{folder}/v={old}")

    return _run(with_heartbeat(events) if heartbeat else events, each, checkpoint, trigger or {"processingTime": "1 minute"})
