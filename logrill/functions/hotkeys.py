"""Ordered per-key logic that never needs a whole key in one task.

A window over ``(source_ip ORDER BY event_time)`` puts a device in one task, so
a device that sends a third of all rows would stall the job. The helpers here
scan in two passes: keys with many rows are cut into slices of equal row count,
whatever their times are; each (key, slice) is reduced to an associative carry,
which a window over the few slices of a key sums up; and the rows of a slice
need only the carry of those before. Results equal the plain window, and where
no key is large the plan is the plain window.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 200_000
BLOCK_ROWS = 100_000
SLICES_PER_TASK = 16  # so that slices, dealt by hash, fill all tasks about alike
SAMPLES = 50  # rows that place one border between slices
HASHES = 1 << 40


@dataclass(frozen=True)
class Running:
    """One value per row, over the rows of the key up to that row.

    how: ``last`` (latest non-null), ``max``, ``sum``, or ``lag`` (the value `n` rows before).
    include_current: whether the row itself counts; a lag never counts it.
    """

    name: str
    value: Column
    how: str
    include_current: bool = True
    n: int = 1


@dataclass(frozen=True)
class Slicing:
    """Borders between the slices of the large keys: at most as many in all as there are slices."""

    keys: list[str]
    borders: DataFrame
    longest: int

    def apply(self, df: DataFrame, time: str, tie: str) -> DataFrame:
        """Add ``_slice``: how many borders of the row's key are not after the row."""
        named = [F.col(k).alias(f"_b{i}") for i, k in enumerate(self.keys)]
        same = [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(self.keys)]
        there = df.join(F.broadcast(self.borders.select(*named, "_borders")), same, "left")
        own = F.struct(F.col(time).alias("time"), F.col(tie).alias("tie"))
        # binary search: try steps of halving length
        steps = [1 << i for i in reversed(range(self.longest.bit_length()))]
        place = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
            F.try_element_at("_borders", at + step) <= own, at + step).otherwise(at))
        return there.withColumn("_slice", F.when(F.col("_borders").isNull(), 0).otherwise(place)).drop(
            "_borders", *[f"_b{i}" for i in range(len(self.keys))])


def slicing(df: DataFrame, keys: list[str], time: str, tie: str, rows: int = SLICE_ROWS) -> Slicing | None:
    """Borders for the keys with more rows than a slice should have; None where there are none.

    A slice has about `rows` rows, or a SLICES_PER_TASK-th of what a task has of
    all rows if that is more, so the borders number at most SLICES_PER_TASK for
    each task. They are taken from a hash sample of about SAMPLES rows for each.
    """
    light = df.select(*keys, F.col(time).alias("time"), F.col(tie).alias("tie"))
    total = light.count()
    if total <= rows:
        return None
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = max(rows, -(-total // (SLICES_PER_TASK * tasks)))
    large = light.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > bound)
    share = min(1.0, SAMPLES / bound)
    sample = light.where(F.pmod(F.xxhash64("time", "tie"), F.lit(HASHES)) < int(share * HASHES))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    met = sample.alias("s").join(large.alias("l"), same).select("s.*", "l._n")
    slices = F.ceil(F.first("_n") / bound).cast("int").alias("_slices")
    sorted_ = F.array_sort(F.array_distinct(F.collect_list(F.struct("time", "tie")))).alias("_all")  # bounded by the sample
    places = F.sequence(F.lit(1), F.col("_slices") - 1)
    pick = F.array_distinct(F.transform(places, lambda i: F.element_at(
        "_all", F.greatest(F.ceil(i * F.size("_all") / F.col("_slices")).cast("int"), F.lit(1)))))
    found = met.groupBy(*keys).agg(slices, sorted_).where("_slices > 1").select(*keys, pick.alias("_borders"))
    kept = found.toArrow()
    if not kept.num_rows:
        return None
    longest = max(len(x) for x in kept.column("_borders").to_pylist())
    return Slicing(list(keys), df.sparkSession.createDataFrame(kept, found.schema), longest)


def _reduced(item: Running, i: int, order: Column) -> Column:
    v = F.col(f"_v{i}")
    if item.how == "last":
        return F.max_by(v, F.when(v.isNotNull(), order))
    return F.max(v) if item.how == "max" else F.sum(v)


def _tails(sliced: DataFrame, keys: list[str], time: str, tie: str, item: Running, i: int) -> DataFrame:
    """The last `n` values of each slice, in order; Spark keeps n rows per task and slice before it shuffles."""
    back = Window.partitionBy(*keys, "_slice").orderBy(F.desc(time), F.desc(tie))
    last = sliced.select(*keys, "_slice", time, tie, f"_v{i}").withColumn("_r", F.row_number().over(back)).where(
        F.col("_r") <= item.n)
    entry = F.struct((-F.col("_r")).alias("r"), F.col(f"_v{i}").alias("v"))
    return last.groupBy(*keys, "_slice").agg(F.transform(
        F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["v"].alias("v"))).alias(f"_s{i}"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the keys and the slice, null keys being equal."""
    names = [*keys, "_slice"]
    renamed = right.select(*[F.col(k).alias(f"_j{j}") for j, k in enumerate(names)],
                           *[c for c in right.columns if c not in names])
    on = [F.col(k).eqNullSafe(F.col(f"_j{j}")) for j, k in enumerate(names)]
    return left.join(renamed, on, "left").drop(*[f"_j{j}" for j in range(len(names))])


def running(df: DataFrame, keys: list[str], time: str, tie: str, items: list[Running],
            rows: int = SLICE_ROWS, cut: Slicing | None | bool = True) -> DataFrame:
    """Add running values in (time, tie) order within each key.

    `cut` is a slicing of the same keys and order, None for none; by default it is found.
    """
    if cut is True:
        cut = slicing(df, keys, time, tie, rows)
    sliced = df
    for i, item in enumerate(items):
        sliced = sliced.withColumn(f"_v{i}", item.value)
    if cut is not None:
        sliced = cut.apply(sliced, time, tie)
    inside = Window.partitionBy(*keys, *(["_slice"] if cut is not None else [])).orderBy(time, tie)
    out = sliced
    for i, item in enumerate(items):
        v, frame = F.col(f"_v{i}"), inside.rowsBetween(Window.unboundedPreceding, 0 if item.include_current else -1)
        if item.how == "lag":
            w = F.lag(v, item.n).over(inside)
        elif item.how == "last":
            w = F.last(v, ignorenulls=True).over(frame)
        elif item.how == "max":
            w = F.max(v).over(frame)
        else:
            w = F.sum(v).over(frame)
        out = out.withColumn(f"_w{i}", w)
    lags = any(item.how == "lag" for item in items)
    if cut is None:
        for i, item in enumerate(items):
            w = F.col(f"_w{i}")
            out = out.withColumn(item.name, F.coalesce(w, F.lit(0)) if item.how == "sum" else w)
        return out.drop(*[f"_{p}{i}" for p in "vw" for i in range(len(items))])

    if lags:
        out = out.withColumn("_at", F.row_number().over(inside))
    order = F.struct(F.col(time), F.col(tie))
    carry = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"), *[
        _reduced(item, i, order).alias(f"_s{i}") for i, item in enumerate(items) if item.how != "lag"])
    for i, item in enumerate(items):
        if item.how == "lag":
            carry = _joined(carry, _tails(sliced, keys, time, tie, item, i), keys)
    by_slice = Window.partitionBy(*keys).orderBy("_slice")  # at most as many rows as the key has slices
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for i, item in enumerate(items):
        s = F.col(f"_s{i}")
        if item.how == "last":
            agg = F.last(s, ignorenulls=True).over(before)
        elif item.how == "max":
            agg = F.max(s).over(before)
        elif item.how == "sum":
            agg = F.sum(s).over(before)
        else:  # n slices before hold at least n rows
            agg = F.flatten(F.collect_list(s).over(by_slice.rowsBetween(-item.n, -1)))
        carried.append(agg.alias(f"_c{i}"))
    out = _joined(out, carry.select(*keys, "_slice", *carried), keys)
    for i, item in enumerate(items):
        w, c = F.col(f"_w{i}"), F.col(f"_c{i}")
        if item.how == "last":
            merged = F.coalesce(w, c)
        elif item.how == "max":
            merged = F.greatest(w, c)
        elif item.how == "sum":
            merged = F.coalesce(w, F.lit(0)) + F.coalesce(c, F.lit(0))
        else:
            merged = F.when(F.col("_at") > item.n, w).otherwise(
                F.try_element_at(c, (F.col("_at") - (item.n + 1)).cast("int"))["v"])
        out = out.withColumn(item.name, merged)
    return out.drop("_slice", "_at", *[f"_{p}{i}" for p in "vwc" for i in range(len(items))])


def previous(df: DataFrame, keys: list[str], time: str, tie: str, columns: dict[str, str],
             rows: int = SLICE_ROWS, cut: Slicing | None | bool = True) -> DataFrame:
    """``lag(column, 1)`` in (time, tie) order within each key; {new name: column}."""
    items = [Running(name, F.col(c), "lag") for name, c in columns.items()]
    return running(df, keys, time, tie, items, rows, cut)


def numbered(df: DataFrame, keys: list[str], time: str, tie: str, name: str = "_rn",
             rows: int = SLICE_ROWS, cut: Slicing | None | bool = True) -> DataFrame:
    """``row_number`` (from 1) in (time, tie) order within each key."""
    return running(df, keys, time, tie, [Running(name, F.lit(1).cast("long"), "sum")], rows, cut)


def in_row_blocks(df: DataFrame, rn: str, lookback: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of equal row count for trailing row frames of ``lookback`` rows.

    The last ``lookback`` rows of a block are repeated at the head of the next.
    Adds ``_block`` and ``_own``; run the window by (key, _block), keep ``_own``.
    """
    assert block_rows >= lookback
    own = F.floor((F.col(rn) - 1) / F.lit(block_rows)).cast("long")
    last = F.floor((F.col(rn) - 1 + F.lit(lookback)) / F.lit(block_rows)).cast("long")
    return (
        df.withColumn("_own_block", own)
        .withColumn("_block", F.explode(F.sequence(F.col("_own_block"), last)))
        .withColumn("_own", F.col("_block") == F.col("_own_block"))
        .drop("_own_block")
    )
