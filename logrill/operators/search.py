"""Filtered search, counts, grouped counts, named periods."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.functions.clock import ntz, plus_seconds
from logrill.functions.text import contains_ci

# ---- fixed values ----
EQUALITY_FIELDS = ("hostname", "source_ip", "vendor", "program", "severity", "predicted_category")
GROUP_BY_FIELDS = (
    "hostname", "source_ip", "vendor", "program", "severity", "predicted_category",
    "resolution_method", "is_anomaly",
)
MAX_GROUP_BY = 3
# ---- end of fixed values ----


def as_datetime(value) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def time_bounds(start, end, as_of, hours: int = 24):
    """Closed range; the end defaults to ``as_of``, the start to a day earlier."""
    end = as_datetime(end or as_of)
    start = as_datetime(start) if start else end - timedelta(hours=hours)
    return start, end


def in_range(df: DataFrame, start, end) -> DataFrame:
    """Rows of a closed time range. On a table partitioned by day the partition
    column is bounded too, so other days are never listed."""
    rows = df.where(F.col("event_time").between(ntz(start), ntz(end)))
    if "event_date" in df.columns:
        rows = rows.where(F.col("event_date").between(
            F.lit(as_datetime(start).date()), F.lit(as_datetime(end).date())))
    return rows


def filter_events(df: DataFrame, as_of, start=None, end=None, anomaly_reason: str | None = None,
                  keyword: str | None = None, only_anomalies: bool = False, **equal) -> DataFrame:
    """The filters every search shares."""
    unknown = set(equal) - set(EQUALITY_FIELDS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    rows = in_range(df, *time_bounds(start, end, as_of))
    for field, value in equal.items():
        if value:
            rows = rows.where(F.col(field) == value)
    if anomaly_reason:
        rows = rows.where(F.array_contains("anomaly_reasons", anomaly_reason))
    if keyword:
        rows = rows.where(contains_ci("message", keyword))
    if only_anomalies:
        rows = rows.where(F.col("is_anomaly") == 1)
    return rows


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("event_time"), "hostname", "severity", "event_id")


def search_events(df: DataFrame, as_of, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """One page, newest first; ``has_more`` tells whether rows follow.

    The page comes from a top-k, never from a full sort.
    """
    return page_of(newest_first(filter_events(df, as_of, **filters)), limit, offset)


def page_of(ordered: DataFrame, limit: int, offset: int) -> DataFrame:
    """Rows of an ordered frame after ``offset``, and in ``has_more`` whether others follow."""
    limit, offset = max(1, limit), max(0, offset)
    more = ordered.limit(offset + limit + 1).agg((F.count("*") > offset + limit).alias("m"))
    return ordered.offset(offset).limit(limit).withColumn("has_more", more.scalar())


def count_events(df: DataFrame, as_of, **filters) -> DataFrame:
    return filter_events(df, as_of, **filters).agg(F.count("*").alias("event_count"))


def aggregate_events(df: DataFrame, as_of, group_by: list[str], limit: int = 20, **filters) -> DataFrame:
    """Counts per group of up to three allowed columns, largest first."""
    bad = [c for c in group_by if c not in GROUP_BY_FIELDS]
    if bad or not 1 <= len(group_by) <= MAX_GROUP_BY:
        raise ValueError(f"group_by must name 1 to {MAX_GROUP_BY} of {GROUP_BY_FIELDS}")
    keys = list(group_by)
    counts = filter_events(df, as_of, **filters).groupBy(*keys).agg(F.count("*").alias("event_count"))
    return counts.orderBy(F.desc("event_count"), *keys).limit(max(1, limit))


def filter_options(df: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Sorted vendors and programs of the last days, as one row each."""
    recent = df.where(F.col("event_time") >= plus_seconds(ntz(as_of), -86400 * days))
    pairs = recent.select("vendor", "program").distinct()
    return pairs.select(F.explode(F.array(
        F.struct(F.lit("vendor").alias("field"), F.col("vendor").alias("value")),
        F.struct(F.lit("program").alias("field"), F.col("program").alias("value")),
    )).alias("o")).select("o.*").distinct().orderBy("field", "value")


def named_periods(as_of, days_ago: int | None = None) -> list[tuple[str, datetime, datetime]]:
    """The eight relative periods, and optionally one whole day some days ago."""
    now = as_datetime(as_of)
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    day, hour = timedelta(days=1), timedelta(hours=1)
    periods = [
        ("today", today, now), ("yesterday", today - day, today),
        ("this week", now - 7 * day, now), ("last week", now - 14 * day, now - 7 * day),
        ("this month", now - 30 * day, now), ("last month", now - 60 * day, now - 30 * day),
        ("this hour", now - hour, now), ("last hour", now - 2 * hour, now - hour),
    ]
    if days_ago is not None:
        if not 1 <= days_ago <= 3650:
            raise ValueError("days_ago must be between 1 and 3650")
        start = today - days_ago * day
        periods.append((f"{days_ago} day(s) ago", start, start + day))
    return periods


def period_counts(df: DataFrame, as_of, days_ago: int | None = None, **filters) -> DataFrame:
    """Events per named period, both ends closed; empty periods count zero.

    The periods are known beforehand, so all counts come from one scan with one
    conditional count each: no join, one partial row per task.
    """
    periods = named_periods(as_of, days_ago)
    start, end = min(p[1] for p in periods), max(p[2] for p in periods)
    rows = filter_events(df, as_of, start=start, end=end, **filters)
    counts = rows.agg(*[
        F.count_if(F.col("event_time").between(ntz(s), ntz(e))).alias(f"c{i}")
        for i, (_, s, e) in enumerate(periods)])
    unpacked = F.explode(F.array(*[
        F.struct(F.lit(name).alias("period"), ntz(s).alias("period_start"), ntz(e).alias("period_end"),
                 F.col(f"c{i}").alias("event_count"))
        for i, (name, s, e) in enumerate(periods)]))
    return counts.select(unpacked.alias("p")).select("p.*")


def period_trend(counts: DataFrame, first: str, second: str) -> DataFrame:
    """Change from the earlier to the later of two periods."""
    two = counts.where(F.col("period").isin(first, second))
    one = F.struct("period_start", "period", "event_count")
    pair = two.agg(F.min(one).alias("a"), F.max(one).alias("b"))
    before, after = F.col("a.event_count"), F.col("b.event_count")
    delta = after - before
    return pair.select(
        F.col("a.period").alias("earlier"), F.col("b.period").alias("later"),
        before.alias("earlier_count"), after.alias("later_count"), delta.alias("delta"),
        F.when(before != 0, F.round(F.abs(delta) / before * 100, 1))
        .when(delta == 0, F.lit(0.0)).alias("percent"),
        F.when(delta > 0, "increased").when(delta < 0, "decreased").otherwise("same").alias("direction"))
