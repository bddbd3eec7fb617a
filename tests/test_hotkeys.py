"""The sliced scans equal plain windows, whatever the slices and the skew, and slices hold about equally many rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logrill.functions import hotkeys as hk
from logrill.functions.clock import from_micros


@pytest.fixture(scope="module")
def rows(spark):
    """Two fifths of the rows in one key, most of them within a second; some rows have no key, some share a time."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}" if rng.random() < 0.9 else None
        time = rng.randrange(900_000) if key == "hot" and rng.random() < 0.9 else rng.randrange(400_000) * 1_000_000
        data.append((key, i, time // 50 * 50, rng.randrange(100) if rng.random() < 0.7 else None))
    return spark.createDataFrame(data, "k string, id long, us long, v int").select(
        "k", "id", from_micros("us").alias("t"), "v").cache()


def by_time():
    return Window.partitionBy("k").orderBy("t", "id")


@pytest.mark.parametrize("size", [1, 30, 400, 10_000])
def test_running(rows, size):
    out = hk.running(rows, ["k"], "t", "id", [
        hk.Running("last", F.col("v"), "last"), hk.Running("max", F.col("v"), "max", False),
        hk.Running("sum", F.col("v"), "sum"), hk.Running("third", F.col("v"), "lag", n=3),
        hk.Running("before", F.col("id"), "lag")], size)
    upto, before = by_time().rowsBetween(Window.unboundedPreceding, 0), by_time().rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.select("k", "id", "t", "v", F.last("v", True).over(upto).alias("last"),
                        F.max("v").over(before).alias("max"),
                        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("sum"),
                        F.lag("v", 3).over(by_time()).alias("third"), F.lag("id").over(by_time()).alias("before"))
    assert out.select(plain.columns).exceptAll(plain).count() == 0 and out.count() == 3000


@pytest.mark.parametrize("size", [20, 500])
def test_previous_and_numbers(rows, size):
    out = hk.numbered(hk.previous(rows, ["k"], "t", "id", {"p": "v"}, size), ["k"], "t", "id", "n", size)
    plain = rows.select("id", F.lag("v").over(by_time()).alias("p"), F.row_number().over(by_time()).cast("long").alias("n"))
    assert out.select("id", "p", F.col("n").cast("long").alias("n")).exceptAll(plain).count() == 0


def test_no_large_key_means_a_plain_window(rows):
    assert hk.slicing(rows, ["k"], "t", "id", 3000) is None
    assert hk.slicing(rows.where("k <> 'hot'"), ["k"], "t", "id", 500) is None


def test_one_moment_may_hold_nearly_all_rows(spark):
    """90 % of the rows are one device's within one second: the largest task has at most twice the median."""
    n, tasks = 40_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("d"), F.col("id") % 400)).otherwise("hot").alias("k"), "id",
        from_micros(F.when(F.col("id") % 10 == 0, F.col("id") * 1_000_000).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_000)))).alias("t"))
    cut = hk.slicing(ids, ["k"], "t", "id", rows=100)
    sliced = cut.apply(ids, "t", "id")
    slices = [r["n"] for r in sliced.where("k = 'hot'").groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert len(slices) > 10 * tasks and max(slices) <= 2 * sorted(slices)[len(slices) // 2]
    dealt = sliced.repartition(tasks, "k", "_slice").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == tasks and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_blocks(rows):
    blocks = hk.in_row_blocks(hk.numbered(rows, ["k"], "t", "id", "n", 100), "n", 9, 40)
    frame = Window.partitionBy("k", "_block").orderBy("n").rowsBetween(-9, 0)
    out = blocks.withColumn("s", F.sum("v").over(frame)).where("_own").select("id", "s")
    plain = rows.select("id", F.sum("v").over(by_time().rowsBetween(-9, 0)).alias("s"))
    assert out.exceptAll(plain).count() == 0 and out.count() == 3000
