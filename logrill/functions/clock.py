"""Time arithmetic on TIMESTAMP_NTZ columns (UTC wall clock)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(value) -> Column:
    """Literal or column as TIMESTAMP_NTZ."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(value).cast("timestamp_ntz")


def micros(c) -> Column:
    """Microseconds since the epoch; the unit every range frame here uses."""
    return F.unix_micros(col(c).cast("timestamp"))


def from_micros(c) -> Column:
    return F.timestamp_micros(col(c)).cast("timestamp_ntz")


def seconds_between(start, end) -> Column:
    """Elapsed seconds as double."""
    return (micros(end) - micros(start)) / F.lit(float(MICROS))


def minute_boundaries(start, end) -> Column:
    """Number of minute boundaries crossed (not elapsed minutes)."""
    minute = 60 * MICROS
    return F.floor(micros(end) / minute) - F.floor(micros(start) / minute)


def bucket_no(c, seconds: int) -> Column:
    """Number of the epoch-aligned bucket of this width that holds the time."""
    return F.floor(micros(c) / F.lit(seconds * MICROS)).cast("long")


def floor_time(c, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of this width."""
    return from_micros(bucket_no(c, seconds) * F.lit(seconds * MICROS))


def plus_seconds(c, seconds) -> Column:
    """Shift by a number of seconds (int, float or column)."""
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return from_micros(micros(c) + F.round(s.cast("double") * MICROS).cast("long"))


def padded_window(center, before_minutes: int, after_minutes: int, as_of) -> Column:
    """Struct(start, end) around a moment, the end never after ``as_of``."""
    return F.struct(
        plus_seconds(center, -60 * before_minutes).alias("window_start"),
        F.least(plus_seconds(center, 60 * after_minutes), ntz(as_of)).alias("window_end"),
    )


def local_time(c, zone: str) -> Column:
    """UTC wall clock -> wall clock in a named zone (daylight saving included)."""
    return F.from_utc_timestamp(col(c).cast("timestamp"), zone).cast("timestamp_ntz")


def utc_time(c, zone: str) -> Column:
    """Wall clock in a named zone -> UTC wall clock."""
    return F.to_utc_timestamp(col(c).cast("timestamp"), zone).cast("timestamp_ntz")


def zone_offset_minutes(c, zone: str) -> Column:
    return ((micros(local_time(c, zone)) - micros(c)) / F.lit(60 * MICROS)).cast("int")


def duration_text(minutes) -> Column:
    """Whole minutes as ``5h 12m`` or ``12m``."""
    m = F.round(col(minutes)).cast("long")
    return F.when(m >= 60, F.format_string("%dh %dm", F.floor(m / 60), m % 60)).otherwise(
        F.format_string("%dm", m)
    )


def iso_text(c) -> Column:
    """ISO text with microseconds; empty for null."""
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))
