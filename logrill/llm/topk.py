"""Exact top-k search by inner product through distributed histogram selection.

Vectors are packed into blocks; every block of queries meets every block of
candidates in one task, where a matrix product scores all pairs. No pair leaves
the task: a pass sends a histogram of the scores of each query, from the top
down to where the block alone holds k of them. The summed histograms tell the
bin that holds the kth score; the next pass divides that bin, until it is one
integer wide. A last pass sends the rows above the kth score, and of those that
tie with it the k smallest ids of the block, and a window per query picks k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.session import materialize

BLOCK = "dim int, ids binary, vectors binary, largest double, longest double"


def integer_vectors(df: DataFrame, key: str, vector: str, scale: float = 1024.0) -> DataFrame:
    """(id, v): floor(scale * x) of every component as long.

    Vectors that are null, or hold a null, NaN or infinite component, take no
    part; an empty vector takes part with the score 0.
    """
    x = F.col(vector)
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.where(x.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"),
        F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v"))


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most `rows` vectors of one dimension, with their largest component and norm."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                members = np.flatnonzero(sizes == dim)
                for k in range(0, len(members), rows):
                    some = members[k:k + rows]
                    block = flat[(starts[some][:, None] + np.arange(dim)).ravel()].reshape(len(some), dim)
                    norms = np.sqrt((block.astype(np.float64) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([ids[some].astype(np.int64).tobytes()], pa.binary()),
                         pa.array([block.tobytes()], pa.binary()),
                         pa.array([float(np.abs(block).max(initial=0))]), pa.array([float(norms.max(initial=0))])],
                        names=["dim", "ids", "vectors", "largest", "longest"])

    return df.mapInArrow(run, BLOCK)


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the queries and candidates, their scores, and where a candidate is the query itself."""
    dim = row["dim"]
    q_ids, c_ids = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "ids"))
    q, c = (np.frombuffer(row[x], np.int64).reshape(len(i), dim) for x, i in (("q_vectors", q_ids), ("vectors", c_ids)))
    if dim * row["q_largest"] * row["largest"] < 2.0 ** 52:  # then floating point is exact and fast
        scores = np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        scores = q @ c.T
    return q_ids, c_ids, scores, q_ids[:, None] == c_ids[None, :]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, bins: int = 2048,
          query_rows: int = 256, vector_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of `vectors` for each of `queries`, both (id, v).

    Every vector but those of the query's own id is a candidate, vectors of
    another dimension are not. Ties go to the smaller id. Repeated rows of
    `vectors` are candidates each; of repeated query ids the row with the
    smallest vector asks. Fewer candidates than k give them all; empty tables
    give no row. Inner products must fit a signed 64-bit integer.
    """
    asked = _packed(queries.groupBy("id").agg(F.min("v").alias("v")), query_rows)
    asked = materialize(asked.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "largest", "longest")))
                        .withColumn("q_block", F.xxhash64("dim", "q_ids")), "topk_queries")
    blocks = materialize(_packed(vectors, vector_rows), "topk_vectors")
    # query blocks are laid out once per lane of candidates, so that the join is an equi-join of blocks
    count = blocks.count()
    lanes = max(1, -(-count // 4))
    blocks = blocks.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)))
    bound = (asked.agg(F.max("q_longest")).first()[0] or 0.0) * (blocks.agg(F.max("longest")).first()[0] or 0.0)
    low, width = -int(bound) - 2, 2 * int(bound) + 4

    def joined(state):
        """Every query block, with what is known of its queries, beside every candidate block of its dimension."""
        left = asked
        if state is not None:
            per_block = state.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "low", "missing")).alias("known"))
            left = left.join(per_block, "q_block")  # at most query_rows entries for each block
        left = left.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
        return left.join(blocks, ["dim", "lane"])

    def known(row, q_ids):
        at = {x["query_id"]: (x["low"], x["missing"]) for x in row["known"]}
        some = np.array([i for i, q in enumerate(q_ids.tolist()) if q in at], np.int64)
        lows, missing = (np.array([at[q_ids[i]][j] for i in some], np.int64) for j in (0, 1))
        return some, lows, missing

    def histogram(step, span, first):
        def run(batches):
            for row in _rows(batches):
                q_ids, _, scores, own = _scores(row)
                if first:
                    lows, missing = np.full(len(q_ids), low, np.int64), np.full(len(q_ids), k, np.int64)
                else:
                    some, lows, missing = known(row, q_ids)
                    q_ids, scores, own = q_ids[some], scores[some], own[some]
                if not len(q_ids):
                    continue
                width_in_bins = -(-span // step)
                bin_ = (scores - lows[:, None]) // step
                inside = (bin_ >= 0) & (bin_ < width_in_bins) & ~own
                rows_at = np.broadcast_to(np.arange(len(q_ids))[:, None], bin_.shape)
                counts = np.bincount(rows_at[inside] * width_in_bins + bin_[inside],
                                     minlength=len(q_ids) * width_in_bins).reshape(len(q_ids), -1)
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                r, b = np.nonzero((counts > 0) & (above < missing[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), row["q_block"])), pa.array(q_ids[r]), pa.array(lows[r] + b * step),
                     pa.array(counts[r, b].astype(np.int64)), pa.array(missing[r])],
                    names=["q_block", "query_id", "low", "n", "missing"])
        return run

    state, first = None, True
    while width > 1:
        step = max(1, -(-width // bins))
        found = joined(state).mapInArrow(
            histogram(step, width, first), "q_block long, query_id long, low long, n long, missing long")
        summed = found.groupBy("q_block", "query_id", "low").agg(F.sum("n").alias("n"), F.max("missing").alias("missing"))
        w = Window.partitionBy("query_id").orderBy(F.desc("low"))  # at most `bins` rows for each query
        down = summed.withColumn("down", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # the highest bin with enough above or in it; where there is none, the lowest that has rows
        enough = F.max(F.when(F.col("down") >= F.col("missing"), F.col("low")))
        picked = down.groupBy("q_block", "query_id").agg(
            F.coalesce(enough, F.min("low")).alias("low"), F.max("missing").alias("missing"),
            F.collect_list(F.struct("low", "n")).alias("bins"))
        state = materialize(picked.select("q_block", "query_id", "low", (F.col("missing") - F.aggregate(
            F.filter("bins", lambda b: b["low"] > F.col("low")), F.lit(0).cast("long"),
            lambda s, b: s + b["n"])).alias("missing")), "topk_state")
        first, width = False, step

    def pick(batches):
        for row in _rows(batches):
            q_ids, c_ids, scores, own = _scores(row)
            some, lows, _ = known(row, q_ids)
            for i, floor in zip(some.tolist(), lows.tolist()):
                at = np.flatnonzero((scores[i] >= floor) & ~own[i])
                at = at[np.lexsort((c_ids[at], -scores[i, at]))[:k]]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), q_ids[i])), pa.array(c_ids[at]), pa.array(scores[i, at])],
                        names=["query_id", "vec_id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (joined(state).mapInArrow(pick, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
