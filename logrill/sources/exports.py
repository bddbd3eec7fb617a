"""CSV and XML exports, and ad-hoc reads."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrill.functions.clock import iso_text
from logrill.operators.search import filter_events, newest_first

# ---- fixed values ----
EXPORT_COLUMNS = (
    "event_time", "source_ip", "hostname", "vendor", "severity", "program", "pid", "message",
    "predicted_category", "predicted_confidence", "is_anomaly", "anomaly_reasons", "resolution_method",
)
# ---- end of fixed values ----

_READ = re.compile(r"\s*(SELECT|SHOW|DESCRIBE|DESC|EXPLAIN|WITH)\b", re.I)


def export_rows(events: DataFrame, as_of, cap: int | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """All matching rows as text, newest first, or the first ``cap`` of them, and a
    one-row frame telling whether the cap cut any off."""
    matching = newest_first(filter_events(events, as_of, **filters))
    if cap is None:
        truncated = events.sparkSession.range(1).select(F.lit(False).alias("truncated"))
    else:
        truncated = matching.limit(cap + 1).agg((F.count("*") > cap).alias("truncated"))
        matching = matching.limit(cap)
    values = {
        "event_time": iso_text("event_time"),
        "pid": F.coalesce(F.col("pid").cast("string"), F.lit("")),
        "predicted_confidence": F.format_string("%.4f", "predicted_confidence"),
        "is_anomaly": F.col("is_anomaly").cast("string"),
        "anomaly_reasons": F.array_join("anomaly_reasons", "|"),
    }
    rows = matching.select(*[values.get(c, F.col(c)).alias(c) for c in EXPORT_COLUMNS])
    return rows, truncated


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_xml(rows: DataFrame, path: str, root: str = "logs", row: str = "log") -> None:
    rows.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def export_events(events: DataFrame, as_of, path: str, fmt: str = "csv", **filters) -> DataFrame:
    """Write the export; the returned frame says whether it is complete."""
    rows, truncated = export_rows(events, as_of, **filters)
    if fmt == "xml":
        write_xml(rows, path)
    else:
        write_csv(rows, path)
    return truncated


def table_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as export text: ISO times, empty for null."""
    kinds = dict(df.dtypes)

    def as_text(c):
        if kinds[c].startswith("timestamp"):
            return iso_text(c)
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.select(*[as_text(c).alias(c) for c in columns])


def export_table(df: DataFrame, columns: list[str], path: str, fmt: str = "csv", root: str = "rows") -> None:
    rows = table_text(df, columns)
    if fmt == "xml":
        write_xml(rows, path, root, "row")
    else:
        write_csv(rows, path)


def run_query(spark: SparkSession, tables: dict[str, DataFrame], query: str,
              max_rows: int | None = None) -> DataFrame:
    """Ad-hoc read over named tables, with a ``truncated`` column; all rows unless the caller names a limit."""
    body = query.strip().rstrip(";").strip()
    if not _READ.match(body):
        raise ValueError("only statements that read are allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    rows = spark.sql(body)
    if max_rows is None:
        return rows.withColumn("truncated", F.lit(False))
    head = rows.limit(max_rows + 1)
    more = head.agg((F.count("*") > max_rows).alias("m"))
    return head.limit(max_rows).withColumn("truncated", more.scalar())
