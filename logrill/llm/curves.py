"""Approximate nearest neighbours through shifted space-filling curves.

Vectors are projected to AXES numbers, and a Hilbert curve through that space
orders them. Several curves, each shifted against the others, tear apart
different neighbours. Spark range-partitions every ordering; its rows are cut
into segments of consecutive keys. A query looks at the segments around its own
key on every curve, and the best of all windows, by exact distance, are merged.

How far a window reaches and how many curves take part is fitted: for a bounded
sample of the queries the true neighbours are found among all vectors, and the
fit takes the cheapest choice that reaches `recall` of them. Close vectors need
a segment or two; vectors without structure need long windows, up to the whole
curve, and get them, so recall does not depend on the data.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrill.llm.common import mixed
from logrill.session import bounded_batches, materialize

AXES, BITS = 8, 7  # a key has AXES * BITS bits
STRETCHES = 256  # into which a curve is cut for the search
FIT_ROWS = 4096  # vectors that fit the projection: those with the smallest hashes


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell numbers below 2**bits, after Skilling (2004)."""
    x = cells.T.astype(np.int64)
    axes = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(axes):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | x[i] >> b & 1
    return key


class Projection:
    """Main axes of a sample, and the shift of each curve along them."""

    def __init__(self, sample: np.ndarray, curves: int):
        self.mean = sample.mean(axis=0)
        self.axes = np.linalg.svd(sample - self.mean, full_matrices=False)[2][:AXES]
        values = (sample - self.mean) @ self.axes.T
        self.low = values.min(axis=0)
        self.width = np.maximum(values.max(axis=0) - self.low, 1e-300)
        shifts = mixed(np.arange(curves * len(self.axes), dtype=np.uint64) + np.uint64(77)).astype(np.float64) / 2.0 ** 64
        self.shifts = shifts.reshape(curves, -1)
        self.shifts[0] = 0.0

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """A key per curve and vector. What lies beyond the sample's range is put at its end."""
        at = np.clip(((vectors - self.mean) @ self.axes.T - self.low) / self.width, 0.0, 1.0)
        cells = 1 << BITS
        return np.stack([hilbert(np.minimum((at + s) / 2.0 * cells, cells - 1).astype(np.int64), BITS) for s in self.shifts])


def real_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors as doubles. Null, empty and zero vectors, those with null or non-finite components, and null ids take no part."""
    x = F.transform(F.col(vector), lambda e: e.cast("double") + F.lit(0.0))  # no negative zero
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    some = F.exists(x, lambda e: e != 0.0)
    kept = F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.coalesce(some, F.lit(False))
    return df.where(kept & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("v"))


def _same(vector: str = "v") -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64(F.lit(i), F.col(vector)).alias(f"h{i}") for i in (0, 1)]


def _distinct(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """ref, v, ids, asked: each distinct vector with its k + 1 smallest ids, and whether a query has it.

    No query needs more ids of one vector, so copies cost nothing, however many.
    """
    both = (vectors.select(*_same(), "id", "v", F.lit(False).alias("asked"))
            .union(queries.select(*_same(), F.lit(None).cast("long"), "v", F.lit(True))))
    once = both.groupBy("h0", "h1", "asked", "id").agg(F.first("v").alias("v"))
    w = Window.partitionBy("h0", "h1", "asked").orderBy("id")
    least = once.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)
    return least.groupBy("h0", "h1").agg(
        F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"), F.max("asked").alias("asked"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _least(rows: DataFrame, n: int, first: str, second: str, *columns: str) -> list:
    """The columns of the n rows with the smallest (first, second), in that order; these are hashes, a pair stands once.

    As hashes are spread evenly, a bound on the first leaves hardly more than n rows. Ordered
    with a limit, each task would send n rows to the driver.
    """
    count = rows.count()
    share = n + 6 * n ** 0.5 + 16
    while True:
        some = rows
        if share < count:
            some = rows.where(F.col(first) <= F.lit(int((1 << 64) * share / count) - (1 << 63)))
        found = sorted(some.select(*columns, F.col(first).alias("_first"), F.col(second).alias("_second")).collect(),
                       key=lambda r: (r["_first"], r["_second"]))
        if len(found) >= n or share >= count:
            return found[:n]
        share *= 2


SEGMENT = "part int, nth int, curve int, sizes binary, ids binary, vectors binary, h0 long, h1 long"


def _segments(rows: DataFrame, projection: Projection, dim: int, per_segment: int) -> DataFrame:
    """Rows of segments (h0 null) and of queries (h0 and h1 set) in the order of every curve.

    A segment holds at most `per_segment` vectors with ids; a query has the
    number of the segment that was open where its key stands.
    """
    curves = len(projection.shifts)

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = projection.keys(_matrix(batch.column("v"), dim))
            for c in range(curves):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(keys[c]), *batch.columns],
                    names=["curve", "key", *batch.schema.names])

    def cut(batches):
        part, nth, open_, held = TaskContext.get().partitionId(), 0, None, []

        def row(sizes, ids, vectors, h0=None, h1=None):
            return {"part": part, "nth": nth, "curve": open_, "sizes": sizes, "ids": ids, "vectors": vectors, "h0": h0, "h1": h1}

        def closed():
            ids = [i for x, _ in held for i in x]
            return row(np.array([len(x) for x, _ in held], np.int32).tobytes(), np.array(ids, np.int64).tobytes(),
                       np.concatenate([v for _, v in held]).tobytes())

        for batch in batches:
            out = []
            vectors = _matrix(batch.column("v"), dim) if batch.num_rows else []
            columns = [batch.column(c).to_pylist() for c in ("curve", "ids", "asked", "h0", "h1")]
            for v, curve, ids, asked, h0, h1 in zip(vectors, *columns):
                if open_ is not None and (curve != open_ or len(held) == per_segment):
                    if held:
                        out.append(closed())
                    nth, held = nth + 1, []
                open_ = curve
                if ids:
                    held.append((ids, v))
                if asked:
                    out.append(row(None, None, v.tobytes(), h0, h1))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
        if held:
            yield pa.RecordBatch.from_pylist([closed()], schema=kind)

    kind = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("curve", pa.int32()), ("sizes", pa.binary()),
                      ("ids", pa.binary()), ("vectors", pa.binary()), ("h0", pa.int64()), ("h1", pa.int64())])
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    ordered = rows.mapInArrow(keyed, "curve int, key long, " + ", ".join(f"{n} {t}" for n, t in names.items()))
    return ordered.repartitionByRange("curve", "key", "h0", "h1").sortWithinPartitions(
        "curve", "key", "h0", "h1").mapInArrow(cut, SEGMENT)


def _best(q: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, ids: np.ndarray, k: int):
    """For each row of q the k + 1 nearest ids (each at its nearest vector), ties to the smaller: arrays row, id, distance."""
    squares = (vectors ** 2).sum(axis=1)
    rough = squares[None, :] - 2.0 * (q @ vectors.T)  # the square of the distance, less that of the query
    slack = 1e-9 * (squares.max(initial=0.0) + (q ** 2).sum(axis=1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i in range(len(q)):
        room = k + 1
        while True:  # more vectors only where some ids stand at several of them
            kth = np.partition(rough[i], room - 1)[room - 1] if room < len(squares) else np.inf
            some = np.flatnonzero(rough[i] <= kth + slack[i])
            near = np.sqrt(((vectors[some] - q[i]) ** 2).sum(axis=1))
            at = np.repeat(np.arange(len(some)), sizes[some])
            of = np.concatenate([ids[starts[s]:starts[s + 1]] for s in some.tolist()]) if len(some) else ids[:0]
            order = np.lexsort((of, near[at]))
            first = np.sort(np.unique(of[order], return_index=True)[1])
            if len(first) > k or room >= len(squares):
                order = order[first[:k + 1]]
                out.append((np.full(len(order), i), of[order], near[at[order]]))
                break
            room *= 2
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]


def _search(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """h0, h1, id, score from rows of a block of queries (q, of, to) beside a segment."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: batch.column(n)[r].as_py() for n in ("q", "h0s", "h1s", "sizes", "ids", "vectors")}
                q, v = (np.frombuffer(one[x], np.float64).reshape(-1, dim) for x in ("q", "vectors"))
                row, ids, score = _best(q, v, np.frombuffer(one["sizes"], np.int32), np.frombuffer(one["ids"], np.int64), k)
                h0, h1 = (np.frombuffer(one[x], np.int64)[row] for x in ("h0s", "h1s"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h0, h1, ids, score)], names=["h0", "h1", "id", "score"])

    found = pairs.select("q", "h0s", "h1s", "sizes", "ids", "vectors").mapInArrow(
        run, "h0 long, h1 long, id long, score double")
    once = found.groupBy("h0", "h1", "id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("h0", "h1").orderBy("score", "id")
    return once.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)


def _blocks(asked: DataFrame, rows: int, *by: str) -> DataFrame:
    """Blocks of at most `rows` queries with equal `by`, which are consecutive in a range partition."""

    def run(batches):
        held, key = [], None

        def block():
            return pa.RecordBatch.from_pylist([{
                **dict(zip(by, key)), "q": b"".join(x[0] for x in held), "h0s": np.array([x[1] for x in held], np.int64).tobytes(),
                "h1s": np.array([x[2] for x in held], np.int64).tobytes()}], schema=kind)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in by))
            for at, v, h0, h1 in zip(keys, *(batch.column(c).to_pylist() for c in ("vectors", "h0", "h1"))):
                if held and (at != key or len(held) == rows):
                    yield block()
                    held = []
                key = at
                held.append((v, h0, h1))
        if held:
            yield block()

    kind = pa.schema([*((c, pa.int64()) for c in by), ("q", pa.binary()), ("h0s", pa.binary()), ("h1s", pa.binary())])
    return asked.repartitionByRange(*by, "h0").sortWithinPartitions(*by, "h0").select(*by, "vectors", "h0", "h1").mapInArrow(
        run, ", ".join(f"{c} long" for c in by) + ", q binary, h0s binary, h1s binary")


def fitted(apart: np.ndarray, segments: int, recall: float) -> tuple[int, int]:
    """Number of curves, and segments on either side of a query's own, that cost least and reach `recall`.

    `apart` has a row per curve and a column per true neighbour of the sample:
    how many segments lie between the neighbour and its query.
    """
    if not apart.size:
        return 1, segments
    best = None
    for curves, least in enumerate(accumulate(apart, np.minimum), 1):
        reach = int(np.sort(least)[min(len(least) - 1, int(np.ceil(recall * len(least))) - 1)])
        cost = curves * min(2 * reach + 1, segments)
        if best is None or cost < best[0]:
            best = cost, curves, reach
    return best[1:]


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, curves: int = 4, per_segment: int = 1024,
            sample: int = 256, recall: float = 0.97, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of `vectors` for each of `queries`, both (id, v) of real_vectors.

    Every vector but those of the query's own id is a candidate; vectors of
    another dimension are not. An id with several vectors counts once, at the
    nearest; of repeated query ids the row with the smallest vector asks. Ties go
    to the smaller id, fewer candidates than k give all that are found, empty
    tables give no row. `sample` queries fit the windows, FIT_ROWS vectors the
    projection; each dimension is searched by itself, one after the other.
    """
    bounded_batches(vectors.sparkSession)
    asks = queries.groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(_distinct(asks, vectors, k).withColumn("dim", F.size("v")), "curves_vectors")
    dims = [r["dim"] for r in rows.where("asked").select("dim").distinct().collect()]
    found = [_of_dimension(rows.where(F.col("dim") == d).drop("dim"), d, k, curves, per_segment, sample, recall, block)
             for d in sorted(dims)]
    best = found[0] if found else rows.select("h0", "h1", F.col("h0").alias("id"), F.lit(0.0).alias("score")).where(F.lit(False))
    for more in found[1:]:
        best = best.union(more)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    named = asks.select(F.col("id").alias("query_id"), *_same()).join(best, ["h0", "h1"]).where("query_id <> id")
    return (named.select("query_id", F.col("id").alias("vec_id"), "score").withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _of_dimension(rows, dim, k, curves, per_segment, sample, recall, block) -> DataFrame:
    spark = rows.sparkSession
    fit = [r["v"] for r in _least(rows, FIT_ROWS, "h0", "h1", "v")]
    cut = materialize(_segments(rows, Projection(np.array(fit, np.float64), curves), dim, per_segment), "curves_segments")
    # segments are numbered on over partitions, of which there are few
    last = {r["part"]: r["n"] + 1 for r in cut.groupBy("part").agg(F.max("nth").alias("n")).collect()}
    before = dict(zip(sorted(last), [0, *accumulate(last[p] for p in sorted(last))]))
    offsets = spark.createDataFrame([(p, n) for p, n in before.items()], "part int, before long")
    cut = cut.join(F.broadcast(offsets), "part").withColumn("at", F.col("before") + F.col("nth")).drop("part", "nth", "before")
    segments = cut.where("ids IS NOT NULL").drop("h0", "h1")
    asked = cut.where("ids IS NULL").select("curve", "at", "vectors", "h0", "h1")
    ends = {r["curve"]: (r["low"], r["high"]) for r in
            cut.groupBy("curve").agg(F.min("at").alias("low"), F.max("at").alias("high")).collect()}
    used, reach = _fit(asked, segments, ends, dim, k, sample, recall)
    # neighbouring queries share their window: a block looks at it once
    group = max(1, reach // 2)
    spans = spark.createDataFrame([(c, low, high) for c, (low, high) in ends.items()], "curve int, low long, high long")
    asked = (asked.where(F.col("curve") < used).join(F.broadcast(spans), "curve")
             .withColumn("group", (F.col("low") + F.floor((F.col("at") - F.col("low")) / group) * group).cast("long")))
    blocks = materialize(_blocks(asked.select("low", "high", "group", "vectors", "h0", "h1"), block, "low", "high", "group"),
                         "curves_blocks")
    first, last = F.greatest(F.col("group") - reach, F.col("low")), F.least(F.col("group") + (group - 1 + reach), F.col("high"))
    pairs = _beside(blocks.select("q", "h0s", "h1s", first.alias("first"), last.alias("last")), segments.where(F.col("curve") < used),
                    max(1, sum(high - low + 1 for low, high in ends.values()) // (len(ends) * STRETCHES)))
    return _search(pairs, dim, k).select("h0", "h1", "id", "score")


def _beside(blocks: DataFrame, segments: DataFrame, stretch: int) -> DataFrame:
    """Each block (q, h0s, h1s, first, last) beside each segment from first to last.

    A block moves once per `stretch` segments of its window, not once per segment. Blocks are
    small on disk and many times as large beside their windows, so they are never broadcast.
    """
    def of(at: str) -> Column:
        return F.floor(F.col(at) / stretch).alias("stretch")

    spread = blocks.select("*", F.explode(F.sequence(of("first"), of("last"))).alias("stretch"))
    return spread.hint("merge").join(segments.select("*", of("at")), "stretch").where(F.col("at").between(F.col("first"), F.col("last")))


def _fit(asked, segments, ends, dim, k, sample, recall) -> tuple[int, int]:
    """Curves and reach, from the true neighbours of `sample` queries among all segments of the first curve."""
    some = _least(asked.where("curve = 0"), sample, "h1", "h0", "h0", "h1", "vectors")
    h0, h1 = (np.array([r[c] for r in some], np.int64).tobytes() for c in ("h0", "h1"))
    q = b"".join(bytes(r["vectors"]) for r in some)
    pairs = segments.where("curve = 0").withColumns({"q": F.lit(q), "h0s": F.lit(h0), "h1s": F.lit(h1)})
    # at most sample * (k + 1) rows: the neighbours, and then the places of both on every curve
    near = [(r["h0"], r["h1"], r["id"]) for r in _search(pairs, dim, k).collect()]
    wanted = np.unique(np.array([x[2] for x in near], np.int64))
    vectors = {(r["h0"], r["h1"]): np.frombuffer(r["vectors"], np.float64) for r in some}

    def places(batches):
        for batch in batches:
            curve, at = (batch.column(c).to_pylist() for c in ("curve", "at"))
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                hit = np.isin(ids, wanted)
                if hit.any():
                    of = np.repeat(np.arange(len(sizes := np.frombuffer(batch.column("sizes")[i].as_py(), np.int32))), sizes)
                    v = np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(-1, dim)[of[hit]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([curve[i]] * len(v), pa.int32()), pa.array([at[i]] * len(v), pa.int64()), pa.array(ids[hit]),
                         pa.array([x.tobytes() for x in v], pa.binary())], names=["curve", "at", "id", "v"])

    found: dict[tuple, list] = {}
    for r in segments.select("curve", "at", "sizes", "ids", "vectors").mapInArrow(
            places, "curve int, at long, id long, v binary").collect():
        found.setdefault((r["id"], r["curve"]), []).append((r["at"], np.frombuffer(bytes(r["v"]), np.float64)))
    own = {(r["h0"], r["h1"], r["curve"]): r["at"] for r in asked.join(
        F.broadcast(segments.sparkSession.createDataFrame([tuple(x) for x in vectors], "h0 long, h1 long")), ["h0", "h1"],
        "left_semi").select("h0", "h1", "curve", "at").collect()} if vectors else {}
    apart = np.zeros((len(ends), len(near)), np.int64)
    for j, (a, b, i) in enumerate(near):
        for c in ends:
            at, _ = min(found[i, c], key=lambda x: ((x[1] - vectors[a, b]) ** 2).sum())  # an id counts at its nearest vector
            apart[c, j] = abs(at - own[a, b, c])
    return fitted(apart, max(high - low + 1 for low, high in ends.values()), recall)
