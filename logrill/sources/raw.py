"""Raw JSON lines as a batch or as a stream of files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrill.functions.text import IGNORE_MESSAGE_PATTERN
from logrill.model import RAW

_SCHEMA = RAW + ", _corrupt string"


def usable(lines: DataFrame, ignore_pattern: str = IGNORE_MESSAGE_PATTERN) -> DataFrame:
    """Keep well-formed records that have a message not to be ignored."""
    kept = lines.where(F.col("_corrupt").isNull() & F.col("message").isNotNull())
    if ignore_pattern:
        kept = kept.where(~F.col("message").rlike("(?i)" + ignore_pattern))
    return kept.drop("_corrupt")


def read_raw(spark: SparkSession, path: str, ignore_pattern: str = IGNORE_MESSAGE_PATTERN) -> DataFrame:
    """JSON lines; blank, malformed and message-less lines are dropped."""
    lines = (spark.read.schema(_SCHEMA).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    return usable(lines, ignore_pattern)


def stream_raw(spark: SparkSession, path: str, ignore_pattern: str = IGNORE_MESSAGE_PATTERN,
               max_files_per_trigger: int = 1000) -> DataFrame:
    """The same for files as they appear. The position lives in the query's
    checkpoint and moves only after a batch is written, rotation included."""
    lines = (spark.readStream.schema(_SCHEMA).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", "_corrupt")
             .option("maxFilesPerTrigger", max_files_per_trigger).json(path))
    return usable(lines, ignore_pattern)
