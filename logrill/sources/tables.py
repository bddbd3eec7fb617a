"""The event table on storage: day partitions, backup, purge, compaction."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrill.functions.clock import ntz
from logrill.model import EVENTS
from logrill.session import fresh_path, remove

# The order events have inside a day.
SORT = ("event_time", "hostname", "severity")


def with_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("event_time"))


def _laid_out(events: DataFrame) -> DataFrame:
    """Range-partition by day and time: a day with most rows becomes many sorted
    files instead of one task, and files keep narrow min-max statistics."""
    dated = events if "event_date" in events.columns else with_date(events)
    return dated.repartitionByRange("event_date", *SORT).sortWithinPartitions("event_date", *SORT)


def write_events(events: DataFrame, path: str, mode: str = "append", batch: int | None = None) -> None:
    """Write by day. A numbered batch replaces exactly what an earlier attempt at it has written.

    The ranges come from a sample, for which Spark runs all that precedes them. So the events
    are first written as they come, to be labelled once and not twice.
    """
    spark, unsorted = events.sparkSession, fresh_path(events.sparkSession, "unsorted")
    events.write.parquet(unsorted)
    rows = _laid_out(spark.read.schema(events.schema).parquet(unsorted))
    out, folders = rows.write.mode(mode), ["event_date"]
    if batch is not None:
        out = rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic")
        folders = ["event_date", "batch"]
    (out.partitionBy(*folders)
     .option("parquet.bloom.filter.enabled#source_ip", "true")
     .option("parquet.bloom.filter.enabled#program", "true")
     .parquet(path))
    remove(spark, unsorted)


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    return spark.read.schema(schema + ", event_date date").parquet(path)


def overwrite_days(events: DataFrame, path: str) -> None:
    """Replace exactly the days present in ``events``. Read the old days from a
    different version of the table (a written copy), never from ``path`` itself."""
    (_laid_out(events).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date").parquet(path))


def day_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_date").agg(F.count("*").alias("row_count"))


def backup_partitions(events: DataFrame, path: str, as_of, days: int = 90) -> DataFrame:
    """Write each day older than the cut-off as gzip CSV; return the manifest.

    The manifest counts what can be read back, so a day is listed only when its
    backup really holds rows. Days that an earlier run has written stay.
    """
    spark = events.sparkSession
    dated = events if "event_date" in events.columns else with_date(events)
    # a day is due when its first instant lies before the cut-off
    due = dated.where(F.col("event_date").cast("timestamp_ntz")
                      < ntz(as_of) - F.make_dt_interval(F.lit(days)))
    flat = due
    if "anomaly_reasons" in due.columns:
        flat = due.withColumn("anomaly_reasons", F.array_join("anomaly_reasons", "|"))
    columns = flat.columns
    (flat.repartitionByRange("event_date", *SORT).sortWithinPartitions("event_date", *SORT)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date").option("compression", "gzip")
     .option("header", True).option("escape", '"').csv(path))
    types = dict(flat.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns if c != "event_date")
    back = (spark.read.schema(schema + ", event_date date").option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))
    return day_counts(back.join(due.select("event_date").distinct(), "event_date", "left_semi"))


def purge_partitions(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows that stay: all days but those whose backup holds every row."""
    dated = events if "event_date" in events.columns else with_date(events)
    confirmed = day_counts(dated).join(manifest, ["event_date", "row_count"]).select("event_date")
    return dated.join(confirmed, "event_date", "left_anti")


def purge_table(spark: SparkSession, table: str, manifest: DataFrame) -> list[str]:
    """Drop the confirmed days of a catalog table: metadata only, a day each."""
    confirmed = day_counts(spark.table(table)).join(manifest, ["event_date", "row_count"])
    days = [str(r.event_date) for r in confirmed.select("event_date").collect()]  # one row per day
    for day in days:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (event_date = DATE '{day}')")
    return days
