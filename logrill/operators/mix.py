"""Template mix per device and window, judged by isolation forests.

The forest follows Liu, Ting and Zhou (ICDM 2008): trees on small random samples,
anomalies are isolated by short paths.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.functions.clock import floor_time, ntz, plus_seconds
from logrill.session import materialize

TOP_K = 50
MIN_WINDOWS = 30
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.01
SEED = 42
_SCOPE = ["model_scope", "scope_key"]


def window_template_counts(events: DataFrame, as_of, minutes: int = 5, lookback_days: int = 2) -> DataFrame:
    """Events per (device, closed window, template) with the device's vendor."""
    width = minutes * 60
    rows = events.where(
        (F.col("event_time") >= plus_seconds(ntz(as_of), -86400 * lookback_days))
        & (F.col("event_time") < floor_time(ntz(as_of), width)))
    counts = rows.groupBy("source_ip", floor_time("event_time", width).alias("window_start"), "template_id").agg(
        F.count("*").alias("event_count"), F.max(F.when(F.col("vendor") != "unknown", F.col("vendor"))).alias("_v"))
    vendors = counts.groupBy("source_ip").agg(F.coalesce(F.max("_v"), F.lit("unknown")).alias("vendor"))
    return counts.drop("_v").join(vendors, "source_ip")


def _scoped(counts: DataFrame, min_device: int, min_vendor: int) -> DataFrame:
    """Counts once per scope that has enough windows: the device, the vendor pool."""
    windows = counts.select("source_ip", "vendor", "window_start").distinct()
    devices = windows.groupBy("source_ip").agg(F.count("*").alias("_n")).where(
        F.col("_n") >= min_device).select(F.lit("device").alias("model_scope"), F.col("source_ip").alias("scope_key"))
    vendors = windows.where("vendor <> 'unknown'").groupBy("vendor").agg(F.count("*").alias("_n")).where(
        F.col("_n") >= min_vendor).select(F.lit("vendor").alias("model_scope"), F.col("vendor").alias("scope_key"))
    doubled = counts.withColumn("_s", F.explode(F.array(
        F.struct(F.lit("device").alias("model_scope"), F.col("source_ip").alias("scope_key")),
        F.struct(F.lit("vendor").alias("model_scope"), F.col("vendor").alias("scope_key")))))
    return doubled.select("_s.*", "source_ip", "window_start", "template_id", "event_count").join(
        devices.unionByName(vendors), _SCOPE, "left_semi")


def mix_vectors(counts: DataFrame, k: int = TOP_K, min_device: int = MIN_WINDOWS,
                min_vendor: int = MIN_WINDOWS) -> DataFrame:
    """Shares per window in long form: slot 1..k for the scope's most frequent
    templates, slot 0 for all others; only slots that occur."""
    scoped = _scoped(counts, min_device, min_vendor)
    totals = scoped.groupBy(*_SCOPE, "template_id").agg(F.sum("event_count").alias("_t"))
    rank = F.row_number().over(Window.partitionBy(*_SCOPE).orderBy(F.desc("_t"), "template_id"))
    top = totals.withColumn("slot", rank).where(F.col("slot") <= k).drop("_t")
    window = [*_SCOPE, "source_ip", "window_start"]
    slots = scoped.join(top, [*_SCOPE, "template_id"], "left").groupBy(
        *window, F.coalesce("slot", F.lit(0)).alias("slot")).agg(F.sum("event_count").alias("_n"))
    size = F.sum("_n").over(Window.partitionBy(*window))  # at most k + 1 rows
    return slots.withColumn("window_events", size).select(
        *window, "slot", (F.col("_n") / F.col("window_events")).alias("share"), "window_events")


def _wide(vectors: DataFrame, k: int) -> DataFrame:
    """One array of k + 1 shares per (scope, window)."""
    window = [*_SCOPE, "source_ip", "window_start"]
    packed = vectors.groupBy(*window).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "share"))).alias("_m"),  # at most k + 1 entries
        F.first("window_events").alias("event_count"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.coalesce(
        F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return packed.select(*window, "event_count", shares.alias("vector"))


def _grow(points: np.ndarray, tree: np.ndarray, rng: np.random.Generator, limit: int):
    """Isolation trees over the rows of each tree number, all grown level by level.

    Returns per node: tree, feature (-1 for a leaf), cut, left, right, size.
    """
    numbers, at = np.unique(tree, return_inverse=True)
    owner = [np.arange(len(numbers))]
    size = [np.bincount(at)]
    splits = []
    total, rows = len(numbers), np.arange(len(points))
    for _ in range(limit):
        rows = rows[np.argsort(at[rows], kind="stable")]
        nodes, starts, counts = np.unique(at[rows], return_index=True, return_counts=True)
        low = np.minimum.reduceat(points[rows], starts, axis=0)
        high = np.maximum.reduceat(points[rows], starts, axis=0)
        varying = high > low
        chosen = np.where(varying, rng.random(varying.shape), -1.0).argmax(axis=1)
        each = np.arange(len(nodes))
        width = high[each, chosen] - low[each, chosen]
        cuts = low[each, chosen] + rng.random(len(nodes)) * width
        split = varying.any(axis=1)
        if not split.any():
            break
        child = np.full(len(nodes), -1)
        child[split] = total + 2 * np.arange(split.sum())
        splits.append((nodes[split], chosen[split], cuts[split], child[split]))
        place = np.repeat(each, counts)
        keep = split[place]
        rows, place = rows[keep], place[keep]
        above = points[rows, chosen[place]] > cuts[place]
        at[rows] = child[place] + above
        made = 2 * int(split.sum())
        size.append(np.bincount(at[rows] - total, minlength=made))
        parents = np.concatenate(owner)[nodes[split]]
        owner.append(np.repeat(parents, 2))
        total += made
    owner, size = np.concatenate(owner), np.concatenate(size)
    feature, cut = np.full(total, -1), np.zeros(total)
    left, right = np.full(total, -1), np.full(total, -1)
    for nodes, chosen, cuts, child in splits:
        feature[nodes], cut[nodes], left[nodes], right[nodes] = chosen, cuts, child, child + 1
    return numbers[owner], feature, cut, left, right, size


def _average_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    value = 2 * (np.log(np.maximum(safe - 1, 1)) + 0.5772156649015329) - 2 * (safe - 1) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _path_lengths(points: np.ndarray, sizes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray,
                  right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean path length of every point over all trees, whose nodes stand one tree after the other."""
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    shift = np.repeat(roots, sizes)
    left, right = left + shift, right + shift
    at = np.tile(roots, (len(points), 1))
    depth = np.zeros(at.shape)
    row = np.arange(len(points))[:, None]
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            break
        below = points[row, feature[at]] <= cut[at]
        at = np.where(inner, np.where(below, left[at], right[at]), at)
        depth += inner
    return (depth + _average_path(size)[at]).mean(axis=1)


def _flat(table: pa.Table, column: str) -> np.ndarray:
    """The elements of all lists of a column, one after the other."""
    return pc.list_flatten(table.column(column)).to_numpy()


def _spread(df: DataFrame, *keys) -> DataFrame:
    """Hash-partition by keys into the session's full number of partitions: the
    rows are few but costly, and AQE would merge them by size into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def train_mix_models(vectors: DataFrame, k: int = TOP_K, trees: int = TREES, sample: int = SAMPLE,
                     seed: int = SEED) -> DataFrame:
    """A forest per scope, one row per tree.

    A scope's windows are ranked by a seeded hash into a pool as large as all
    draws together, from which each tree draws its sample. Ranks are cut before
    the shuffle, so a vendor with most windows sends no more rows than another.
    """
    order = F.xxhash64(F.lit(seed), "source_ip", "window_start")
    pool = _wide(vectors, k).withColumn("_rank", F.row_number().over(
        Window.partitionBy(*_SCOPE).orderBy(order, "source_ip", "window_start"))
    ).where(F.col("_rank") <= sample * trees).select(*_SCOPE, "_rank", "vector")

    def grow(key, table):
        key, rows = [k.as_py() for k in key], table.num_rows
        vectors = _flat(table.sort_by("_rank"), "vector").reshape(rows, -1)
        rng = np.random.default_rng([seed, *f"{key[0]}:{key[1]}".encode()])
        drawn = min(sample, rows)
        picks = np.concatenate([rng.permutation(rows)[:drawn] for _ in range(trees)])
        tree = np.repeat(np.arange(1, trees + 1), drawn)
        owner, feature, cut, left, right, size = _grow(
            vectors[picks], tree, rng, math.ceil(math.log2(max(drawn, 2))))
        order = np.lexsort((np.arange(len(owner)), owner))
        numbers, starts = np.unique(owner[order], return_index=True)
        ends = np.array([*starts, len(owner)])
        local = np.empty(len(owner), dtype=int)
        local[order] = np.arange(len(owner)) - np.repeat(starts, np.diff(ends))
        nodes = {"feature": feature, "cut": cut, "left": np.where(left >= 0, local[left], -1),
                 "right": np.where(right >= 0, local[right], -1), "size": size}
        return pa.table({
            **{name: pa.array([value] * len(numbers), pa.string()) for name, value in zip(_SCOPE, key)},
            "tree": numbers.astype(np.int32), "sample_size": np.full(len(numbers), drawn, np.int32),
            **{name: pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(
                c[order], pa.float64() if name == "cut" else pa.int32())) for name, c in nodes.items()}})

    # a group holds the pool of one forest: at most trees * sample rows
    return _spread(pool, *_SCOPE).groupBy(*_SCOPE).applyInArrow(
        grow, "model_scope string, scope_key string, tree int, sample_size int, feature array<int>, "
              "cut array<double>, left array<int>, right array<int>, size array<int>")


def forest_scores(vectors: DataFrame, forest: DataFrame, k: int = TOP_K, part_rows: int = 5_000) -> DataFrame:
    """Score of every (scope, window); lower is more anomalous.

    A scope is cut into parts of bounded size by hash, its trees (bounded) go to
    every part.
    """
    wide = materialize(_wide(vectors, k), "mix-windows")  # counted, then scored
    # only scopes of several parts; at most one row for each part_rows windows
    parts = F.broadcast(wide.groupBy(*_SCOPE).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts")).where(
        "_parts > 1"))
    number = F.coalesce("_parts", F.lit(1))
    placed = wide.join(parts, _SCOPE, "left").withColumn(
        "part", F.pmod(F.xxhash64("source_ip", "window_start"), number).cast("int")).drop("_parts")
    copies = forest.join(parts, _SCOPE, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), number - 1))).drop("_parts")

    def score(windows, trees):
        kept = windows.select([*_SCOPE, "source_ip", "window_start", "event_count"])
        if not windows.num_rows or not trees.num_rows:
            return kept.slice(0, 0).append_column("score", pa.array([], pa.float64()))
        points = _flat(windows, "vector").reshape(windows.num_rows, -1)
        trees = trees.sort_by("tree")
        sizes = pc.list_value_length(trees.column("feature")).to_numpy()
        mean = _path_lengths(points, sizes, *(_flat(trees, c) for c in ("feature", "cut", "left", "right", "size")))
        norm = max(float(_average_path(trees.column("sample_size")[0].as_py())), 1e-12)
        return kept.append_column("score", pa.array(np.round(-np.power(2.0, -mean / norm), 6)))

    keys = [*_SCOPE, "part"]
    return _spread(placed, *keys).groupBy(*keys).cogroup(_spread(copies, *keys).groupBy(*keys)).applyInArrow(
        score, "model_scope string, scope_key string, source_ip string, window_start timestamp_ntz, "
               "event_count long, score double")


def score_mix_windows(counts: DataFrame, forest: DataFrame, checkpoint: DataFrame | None = None,
                      k: int = TOP_K, min_device: int = MIN_WINDOWS, min_vendor: int = MIN_WINDOWS,
                      contamination: float = CONTAMINATION) -> DataFrame:
    """Scores of the windows not yet scored, by the device's forest or its vendor's.

    The cut is the contamination quantile of the training scores. Scores carry
    six decimals, which bounds the state of the exact quantile.
    """
    # written once: the cuts, the devices with a forest and the verdicts read them
    scores = materialize(forest_scores(mix_vectors(counts, k, min_device, min_vendor), forest, k), "mix-scores")
    cuts = scores.groupBy(*_SCOPE).agg(F.percentile("score", F.lit(contamination)).alias("_cut"))
    vendors = counts.select("source_ip", "vendor").distinct()
    own = cuts.where("model_scope = 'device'").select(F.col("scope_key").alias("source_ip"), F.lit(True).alias("_own"))
    judged = scores.join(cuts, _SCOPE).join(vendors, "source_ip").join(own, "source_ip", "left").where(
        (F.col("model_scope") == "device") | F.col("_own").isNull())
    if checkpoint is not None:
        judged = judged.join(checkpoint, "source_ip", "left").where(
            F.col("last_scored").isNull() | (F.col("window_start") > F.col("last_scored")))
    decision = F.col("score") - F.col("_cut")
    return judged.select("window_start", "source_ip", "vendor", "model_scope",
                         decision.alias("anomaly_score"), (decision < 0).cast("int").alias("is_anomaly"),
                         "event_count")


def unusual_template_mix(events: DataFrame, scored: DataFrame, minutes: int = 5) -> DataFrame:
    """Tags (event_id, reason) for all events of flagged windows: an equi-join on
    the window start instead of a range join."""
    flagged = scored.where("is_anomaly = 1").select("source_ip", "window_start").distinct()
    return events.select("event_id", "source_ip", floor_time("event_time", minutes * 60).alias("window_start")).join(
        flagged, ["source_ip", "window_start"], "left_semi").select(
        "event_id", F.lit("unusual_template_mix").alias("reason"))
