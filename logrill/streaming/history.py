"""The stored stream with the reasons that need history.

What a later event has to know of earlier ones is small: how often a template
was seen, when a device last logged at each rank, the last downs of an
interface and a device's counts per interval. A micro-batch reads these four tables as the
batch before left them, judges its events by the batch operators and writes
both the events and the tables under its own number. So a repeated batch
replaces what its first attempt wrote, and a device with most rows of a batch
is cut into slices as in a batch job.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logrill.functions import text
from logrill.functions.clock import MICROS, micros
from logrill.operators import signals
from logrill.session import numbers_below, remove
from logrill.sources import tables

BATCH_ROWS = 36  # bits of an event id that number the rows of a batch

STATE = {
    "templates": "template_id string, n long",
    "ranks": "source_ip string, " + ", ".join(f"last{r} long" for r in signals.RANKS),
    "downs": "source_ip string, message string, event_time timestamp_ntz, event_id long",
    "volume": "source_ip string, bucket long, events long, _first timestamp_ntz, _last timestamp_ntz",
}


@dataclass(frozen=True)
class Reasons:
    """What the signals with history go by; the meaning is that of ``signals.inline_reasons``."""

    rare_threshold: int = 5
    baseline_days: int = 7
    refresh_seconds: int = 600
    volume_multiplier: float = 5
    flap_seconds: int = 900
    min_downs: int = 3


def numbered_ids(rows: DataFrame, number: int) -> DataFrame:
    """Add ``event_id``, dense within the batch and unlike those of other batches, also for identical lines.

    Rows must come from a written table, so that they are dealt to tasks alike
    both times; the tasks' row counts are one small row each.
    """
    placed = rows.withColumns({"_task": F.spark_partition_id(),
                               "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_task").agg((F.max("_row") + 1).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = placed.join(F.broadcast(starts), "_task")
    return joined.withColumn("event_id", F.lit(number << BATCH_ROWS) + F.col("_start") + F.col("_row")).drop("_task", "_row", "_start")


def judged(rows: DataFrame, state: dict[str, DataFrame], how: Reasons) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The events with their reasons, and the state after them."""
    spikes = signals.severity_spike(rows, how.baseline_days, earlier=state["ranks"])
    counts = signals.merge_device_counts(state["volume"].unionByName(signals.device_counts(rows, how.refresh_seconds)))
    flagged = signals.volume_spike(spikes, how.refresh_seconds, how.baseline_days, how.volume_multiplier, counts)
    flagged = signals.rare_template(flagged, how.rare_threshold, state["templates"])
    both = flagged.withColumn("_new", F.lit(True)).unionByName(
        state["downs"].withColumn("_new", F.lit(False)), allowMissingColumns=True)
    flagged = signals.interface_flapping(both, how.flap_seconds, how.min_downs).where("_new").drop("_new")

    seen = state["templates"].unionByName(rows.groupBy("template_id").agg(F.count("*").alias("n")))
    templates = seen.groupBy("template_id").agg(F.least(F.sum("n"), F.lit(how.rare_threshold).cast("long")).alias("n"))
    ranks = state["ranks"].unionByName(signals.latest_by_rank(rows)).groupBy("source_ip").agg(
        *[F.max(f"last{r}").alias(f"last{r}") for r in signals.RANKS])
    # nothing older than its period can change a later verdict
    newest = ranks.agg(F.max("last7")).first()[0] or 0
    ranks = ranks.where(F.col("last7") >= newest - how.baseline_days * 86400 * MICROS)
    interface = ["source_ip", text.interface_name("message")]
    last = Window.partitionBy(*interface).orderBy(F.desc("event_time"), F.desc("event_id"))
    downs = rows.where(text.interface_state("message") == "down").select("source_ip", "message", "event_time", "event_id")
    downs = downs.unionByName(state["downs"]).where(micros("event_time") >= newest - how.flap_seconds * MICROS).withColumn(
        "_r", F.row_number().over(last)).where(F.col("_r") < how.min_downs).drop("_r")
    width = how.baseline_days * 86400 // how.refresh_seconds
    volume = counts.where(F.col("bucket") >= newest // (how.refresh_seconds * MICROS) - width - 1)
    return signals.named_reasons(flagged), {"templates": templates, "ranks": ranks, "downs": downs, "volume": volume}


def _before(spark: SparkSession, path: str, number: int) -> dict[str, DataFrame]:
    if number == 0:
        return {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}/v={number - 1}") for name, schema in STATE.items()}


def stream_events(raw: DataFrame, prepare: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                  how: Reasons = Reasons(), trigger: dict | None = None):
    """Store a stream's events with all six reasons below ``path``/events, by day and batch.

    ``prepare`` labels a micro-batch, as ``jobs.label`` does; where its rows have
    no ``event_id`` they get one (`numbered_ids`). Events are judged in the order
    of their times within a batch, and by all batches before: where batches come in the
    order of time, the table equals ``signals.inline_reasons`` over all events.
    A late event is judged by what has been stored when it comes, and what has
    been stored is not judged again. Of the state, the last two versions stay.
    """
    def each(batch, number):
        spark, staged = batch.sparkSession, f"{path}/staged/v={number}"
        rows = prepare(batch)
        rows.write.mode("overwrite").parquet(staged)  # read by every signal
        rows = spark.read.schema(rows.schema).parquet(staged)
        if "event_id" not in rows.columns:
            rows = numbered_ids(rows, number)
        events, after = judged(rows, _before(spark, f"{path}/state", number), how)
        for name, table in after.items():
            table.write.mode("overwrite").parquet(f"{path}/state/{name}/v={number}")
        tables.write_events(events, f"{path}/events", batch=number)
        for folder, end in (("staged", number + 1), *((f"state/{name}", number - 1) for name in STATE)):
            for old in numbers_below(spark, f"{path}/{folder}"):
                if old < end:
                    remove(spark, f"{path}/{folder}/v={old}")

    return (raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "2 seconds"})).start())


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored events."""
    return spark.read.parquet(f"{path}/events").drop("batch")
