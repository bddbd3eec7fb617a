"""An inverted file of vectors: k-means cells, 8-bit codes with known errors, exact re-ranking.

Unit vectors are dealt to the cell of their nearest centre. A block of a cell
keeps each component as one byte on the block's own scale, and for every vector
the length of what the codes leave out: a code tells the cosine to within that
length. Codes are read first; a vector is compared in full only if its bound
reaches the kth best that is certain. Cells are probed nearest first, and the
others only where their centre and radius leave room for one of the k best, so
the answer is exact unless `probes` ends the search before.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.operators.wordindex import best
from logrill.session import materialize

FIT_ROWS, BLOCK_ROWS, QUERY_ROWS = 20_000, 4096, 256
TIE = 2e-6  # scores are compared at six decimals
MARGIN = 1e-5  # rounding of single precision


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _centres(docs: DataFrame, cells: int | None, rounds: int = 8) -> np.ndarray:
    """k-means centres (unit length) of at most FIT_ROWS vectors: those with the smallest hashes."""
    rows = docs.orderBy(F.xxhash64("doc_id")).limit(FIT_ROWS).select("embedding").toArrow().column(0).combine_chunks()
    if not len(rows):
        return np.zeros((0, 1))
    x = unit(matrix(rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows))
    number = min(len(x), cells or max(1, int(np.sqrt(len(x)) / 2)))
    centres = x[:number]
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, unit(sums), centres)
    return centres


BLOCK = "cell int, codes binary, low binary, step binary, missing binary, same binary, radius double"


def vector_index(docs: DataFrame, cells: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Blocks of codes over docs (doc_id, embedding), written to the shared folder, and the centres of the cells.

    Vectors that are null take no part; all others have one length of array. A
    large cell is several blocks, dealt by hash.
    """
    rows = docs.where("embedding IS NOT NULL").select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centres = _centres(rows, cells)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def assigned(batches):
        for batch in batches:
            if batch.num_rows:
                at = (unit(matrix(batch.column(1))) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))],
                                                 names=["doc_id", "embedding", "same", "cell"])

    def block(ids, vectors, same, cell):
        x = unit(matrix(vectors))
        low, high = x.min(axis=0), x.max(axis=0)
        step = np.maximum(high - low, 1e-30) / 255
        codes = np.rint((x - low) / step).astype(np.uint8)
        missing = np.linalg.norm(x - (low + codes * step), axis=1)
        radius = float(np.linalg.norm(x - centres[cell], axis=1).max())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([cell], pa.int32()),
             *(pa.array([a.tobytes()], pa.binary()) for a in (codes, low, step, missing, same)), pa.array([radius])],
            names=["doc_ids", "cell", "codes", "low", "step", "missing", "same", "radius"])

    def packed(batches):
        held = []
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(edges, edges[1:]):
                part = batch.slice(lo, hi - lo)
                while part.num_rows:
                    if held and (held[0].column("cell")[0] != part.column("cell")[0] or sum(b.num_rows for b in held) == BLOCK_ROWS):
                        yield whole(held)
                        held = []
                    room = BLOCK_ROWS - sum(b.num_rows for b in held)
                    held.append(part.slice(0, room))
                    part = part.slice(room)
        if held:
            yield whole(held)

    def whole(some):
        t = pa.Table.from_batches(some)
        ids, vectors = (pa.concat_arrays(t.column(c).chunks) for c in ("doc_id", "embedding"))
        same = pa.concat_arrays(t.column("same").chunks).to_numpy(zero_copy_only=False)
        return block(ids, vectors, same, some[0].column("cell")[0].as_py())

    # by cell and hash: a cell with many rows is cut over several range partitions
    dealt = rows.withColumn("same", F.xxhash64("embedding")).mapInArrow(
        assigned, f"doc_id {kind}, embedding array<double>, same long, cell int").withColumn(
        "_h", F.xxhash64("doc_id")).repartitionByRange("cell", "_h").sortWithinPartitions("cell", "_h").drop("_h")
    return materialize(dealt.mapInArrow(packed, f"doc_ids array<{kind}>, {BLOCK}"), "vector_index"), centres


def _queries(queries: DataFrame) -> DataFrame:
    return queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _probes(asked: DataFrame, centres: np.ndarray, radii: dict[int, float], first: int) -> DataFrame:
    """query_id, embedding, cell: the `first` cells by their centres, or, where `least` is there, the others within reach."""
    numbers = np.array(sorted(radii), np.int64)
    middles, reach = centres[numbers], np.array([radii[c] for c in numbers])
    kind = asked.schema["query_id"].dataType.simpleString()
    bounded = "least" in asked.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = unit(matrix(batch.column("embedding"))) @ middles.T
            near = np.argsort(-scores, axis=1, kind="stable")
            place = np.argsort(near, axis=1)
            if bounded:
                least = np.asarray(batch.column("least"), np.float64)[:, None]
                wanted = (place >= first) & (scores + reach >= least - TIE - MARGIN)
            else:
                wanted = place < first
            q, c = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(q)), batch.column("embedding").take(pa.array(q)), pa.array(numbers[c].astype(np.int32))],
                names=["query_id", "embedding", "cell"])

    return asked.mapInArrow(run, f"query_id {kind}, embedding array<double>, cell int")


def _merged(side: DataFrame) -> DataFrame:
    """A side that grows with the queries or vectors: never broadcast, for which it would pass through the driver.
    Equal vectors make a small file of a large table, so its size alone would not tell."""
    return side.hint("merge")


def _scan(probes: DataFrame, index: DataFrame, k: int, kinds: tuple[str, str]) -> DataFrame:
    """query_id, doc_id, low, high: bounds of the cosine for all that can be among the k best of a block."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = {n: batch.column(n)[i].as_py() for n in ("codes", "low", "step", "missing")}
                low, step, missing = (np.frombuffer(one[n], np.float64) for n in ("low", "step", "missing"))
                codes = np.frombuffer(one["codes"], np.uint8).reshape(len(missing), -1).astype(np.float32)
                asked = batch.column("asked").slice(i, 1).flatten()
                q = unit(matrix(asked.field("embedding")))
                about = (codes @ (q * step).T.astype(np.float32)).T + (q @ low)[:, None]
                least = about - missing - MARGIN
                if len(missing) > k:
                    floor = np.partition(least, -k, axis=1)[:, -k, None]
                    rows, docs = np.nonzero(about + missing + MARGIN >= floor - TIE)
                else:
                    rows, docs = np.nonzero(np.ones_like(about, bool))
                ids = batch.column("doc_ids").slice(i, 1).flatten()
                # of equal vectors the k smallest ids are enough, however many there are
                same = np.frombuffer(batch.column("same")[i].as_py(), np.int64)
                order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                some = np.lexsort((order[docs], same[docs], rows))
                rows, docs = rows[some], docs[some]
                begins = (np.diff(rows, prepend=-1) != 0) | (np.diff(same[docs], prepend=0) != 0)
                place = np.arange(len(rows)) - np.maximum.accumulate(np.where(begins, np.arange(len(rows)), 0))
                rows, docs = rows[place < k], docs[place < k]
                yield pa.RecordBatch.from_arrays(
                    [asked.field("query_id").take(pa.array(rows)), ids.take(pa.array(docs)), pa.array(least[rows, docs].astype(np.float64)),
                     pa.array((about + missing + MARGIN)[rows, docs].astype(np.float64))], names=["query_id", "doc_id", "low", "high"])

    # a cell asked by many queries is asked by several packs of them
    pack = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("_n") / QUERY_ROWS)).alias("_pack")
    sizes = probes.groupBy("cell").agg(F.count("*").alias("_n"))
    packs = probes.join(sizes, "cell").select("cell", pack, F.struct("query_id", "embedding").alias("q")).groupBy(
        "cell", "_pack").agg(F.collect_list("q").alias("asked"))
    return packs.join(_merged(index), "cell").select("asked", "doc_ids", "codes", "low", "step", "missing", "same").mapInArrow(
        run, f"query_id {kinds[0]}, doc_id {kinds[1]}, low double, high double")


def _certain(found: DataFrame, k: int) -> DataFrame:
    """query_id, least: the kth largest lower bound of each query that has k."""
    w = Window.partitionBy("query_id").orderBy(F.desc("low"), "doc_id")
    return found.select("query_id", "doc_id", "low", F.row_number().over(w).alias("_nth")).where(F.col("_nth") <= k).groupBy(
        "query_id").agg(F.when(F.count("*") == k, F.min("low")).alias("least"))


def candidates(docs: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, first: int = 4,
               probes: int | None = None) -> DataFrame:
    """query_id, doc_id: what has to be compared in full, at least the k best of the probed cells."""
    index, centres = vector_index(docs, cells)
    asked = materialize(_queries(queries), "vector_queries")
    kinds = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
    radii = {r["cell"]: r["radius"] for r in index.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}
    if not radii:
        return asked.select("query_id").where("false").withColumn("doc_id", F.lit(None).cast(kinds[1]))
    found = materialize(_scan(_probes(asked, centres, radii, probes or first), index, k, kinds), "vector_found")
    if probes is None:
        least = asked.join(_merged(_certain(found, k)), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        found = found.union(_scan(_probes(least, centres, radii, first), index, k, kinds))
        found = materialize(found, "vector_found")
    return found.join(_merged(_certain(found, k)), "query_id", "left").where(
        F.col("high") >= F.coalesce("least", F.lit(-2.0)) - TIE).select("query_id", "doc_id")


def nearest(docs: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, first: int = 4,
            probes: int | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest by cosine; `probes` cells only, or all that can hold one of them."""
    pairs = candidates(docs, queries, k, cells, first, probes)
    x = docs.select("doc_id", F.col("embedding").cast("array<double>").alias("_d"))
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("_q"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)

    length = F.sqrt(dot("_d", "_d")) * F.sqrt(dot("_q", "_q"))
    score = F.round(F.coalesce(dot("_d", "_q") / F.nullif(length, F.lit(0.0)), F.lit(0.0)), 6)
    return best(pairs.join(_merged(x), "doc_id").join(_merged(q), "query_id").select("query_id", "doc_id", score.alias("score")), k)
