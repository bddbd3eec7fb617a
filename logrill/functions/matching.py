"""Substring joins without a cross join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 6  # numbers in names make three letters common


def _grams(text, length):
    """Distinct substrings of the given length (or the whole of a shorter text)."""
    last = F.greatest(F.length(text) - length + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, length)))


def contains_join(needles: DataFrame, needle: str, haystack: DataFrame, hay: str) -> DataFrame:
    """Pairs where ``hay`` contains ``needle``, ignoring case and without wildcards.

    Any hay that contains a needle contains all its six-letter pieces. Each
    needle is looked up by its rarest piece only, an equi-join with few
    candidates, which are then verified.
    """
    hays = haystack.withColumn("_hay", F.lower(hay))
    wanted = needles.withColumn("_needle", F.lower(needle)).where(F.length("_needle") > 0)
    length = F.least(F.length("_needle"), F.lit(GRAM))
    pieces = hays.withColumn("_g", F.explode(F.array_distinct(F.concat(
        *[_grams(F.col("_hay"), n) for n in range(1, GRAM + 1)]))))
    counts = pieces.groupBy("_g").agg(F.count("*").alias("_c"))
    keyed = wanted.select("_needle", length.alias("_len")).distinct().withColumn(
        "_g", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("_needle") - F.col("_len") + 1),
            lambda i: F.substring(F.col("_needle"), i, F.col("_len"))))))
    rarest = keyed.join(counts, "_g", "left").groupBy("_needle").agg(
        F.min_by("_g", F.struct(F.coalesce("_c", F.lit(0)), F.col("_g"))).alias("_g"))
    return (wanted.join(rarest, "_needle").join(pieces, "_g")
            .where(F.contains("_hay", F.col("_needle"))).drop("_g", "_needle", "_hay"))
