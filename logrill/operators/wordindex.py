"""An inverted index in segments, and BM25 top-k over it with block-wise score bounds.

A segment holds the posting lists of a few thousand documents that one task
read, so the index is built without moving a document. Every posting list is cut
into blocks by ranges of documents, and each block keeps the largest count and
the smallest length in it: with these no document of the range can score more
than a known bound (Ding and Suel, SIGIR 2011). A search orders the ranges of a
segment by the sum of the bounds of the query's words and stops at the first
that cannot reach the kth score so far; only k rows per query and segment leave
the task.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrill.session import materialize

SEGMENT_DOCS, SEGMENT_WORDS = 4096, 2_000_000
RANGE = 64  # documents whose postings share a block
QUERY_ROWS = 256
BROADCAST_WORDS = 500_000  # words of queries up to which their blocks are broadcast; beyond it they are dealt to lanes
TIE = 2e-6  # scores are compared at six decimals


def tokens(c) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def best(rows: DataFrame, k: int) -> DataFrame:
    """Best k per query; Spark cuts to k per task before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _segment(ids: pa.Array, words: pa.ListArray) -> dict:
    """Posting lists of these documents: CSR arrays of blocks per word and of postings per block."""
    sizes = np.array(pc.fill_null(pc.list_value_length(words), 0), np.int64)
    coded = words.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
    key, tf = np.unique(np.asarray(coded.indices, np.int64) * SEGMENT_DOCS + doc, return_counts=True)
    word, doc = key // SEGMENT_DOCS, key % SEGMENT_DOCS
    first = np.flatnonzero(np.diff(key // RANGE, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    number = len(coded.dictionary)
    return {
        "doc_ids": ids, "lengths": sizes.astype(np.int32).tobytes(), "texts": len(ids) - words.null_count,
        "words": coded.dictionary, "dfs": np.bincount(word, minlength=number).astype(np.int64),
        "blocks": np.searchsorted(word[first], np.arange(number + 1)).astype(np.int32).tobytes(),
        "ranges": (doc[first] // RANGE).astype(np.int16).tobytes(), "starts": np.append(first, len(key)).astype(np.int32).tobytes(),
        "most": np.maximum.reduceat(tf, first).astype(np.int32).tobytes() if len(key) else b"",
        "shortest": np.minimum.reduceat(sizes[doc], first).astype(np.int32).tobytes() if len(key) else b"",
        "docs": doc.astype(np.int16).tobytes(), "tfs": tf.astype(np.int32).tobytes()}


SEGMENT = ("lengths binary, texts long, words array<string>, dfs array<long>, blocks binary, ranges binary, starts binary, "
           "most binary, shortest binary, docs binary, tfs binary")


def word_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """Segments of the index over docs (doc_id, text), written to the shared folder.

    A null text has no words and counts as a document. A text longer than
    SEGMENT_WORDS is a segment of its own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held, number = [], 0

        def row(some):
            table = pa.Table.from_batches(some).combine_chunks()
            ids, words = (table.column(i).combine_chunks() if table.column(i).num_chunks != 1 else table.column(i).chunk(0)
                          for i in (0, 1))
            s = _segment(ids, words)
            one = [pa.array([s["lengths"]], pa.binary()), pa.array([s["texts"]], pa.int64()),
                   pa.ListArray.from_arrays([0, len(s["words"])], s["words"].cast(pa.string())),
                   pa.ListArray.from_arrays([0, len(s["dfs"])], pa.array(s["dfs"])),
                   *(pa.array([s[c]], pa.binary()) for c in ("blocks", "ranges", "starts", "most", "shortest", "docs", "tfs"))]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), *one], names=names)

        for batch in batches:
            sizes = np.cumsum(np.array(pc.fill_null(pc.list_value_length(batch.column(1)), 0), np.int64))
            at = 0
            while at < batch.num_rows:
                docs_left = SEGMENT_DOCS - sum(b.num_rows for b in held)
                room = (sizes[at - 1] if at else 0) + SEGMENT_WORDS - number
                to = min(at + docs_left, int(np.searchsorted(sizes, room, side="right")))
                if to == at and not held:
                    to = at + 1
                if to > at:
                    held.append(batch.slice(at, to - at))
                    number += int(sizes[to - 1] - (sizes[at - 1] if at else 0))
                    at = to
                if at < batch.num_rows:
                    yield row(held)
                    held, number = [], 0
        if held:
            yield row(held)

    names = ["doc_ids", "lengths", "texts", "words", "dfs", "blocks", "ranges", "starts", "most", "shortest", "docs", "tfs"]
    rows = docs.select("doc_id", tokens(F.col(text)).alias("words"))
    return materialize(rows.mapInArrow(run, f"doc_ids array<{kind}>, {SEGMENT}"), "word_index")


class _Reader:
    """One segment, and the search in it."""

    def __init__(self, row: dict, words: pa.Array, k1: float, b: float, mean: float):
        self.words = words
        for name, kind in (("lengths", np.int32), ("blocks", np.int32), ("ranges", np.int16), ("starts", np.int32),
                           ("most", np.int32), ("shortest", np.int32), ("docs", np.int16), ("tfs", np.int32)):
            setattr(self, name, np.frombuffer(row[name], kind))
        self.k1, self.b, self.mean = k1, b, mean
        self.n_ranges = -(-len(self.lengths) // RANGE)

    def saturation(self, tf, length):
        return tf / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def top(self, at: np.ndarray, weights: np.ndarray, k: int, order: np.ndarray):
        """Documents (numbers in the segment) and scores of the k best; `at` are word numbers, ties go by `order`."""
        counts = self.blocks[at + 1] - self.blocks[at]
        block = _slices(self.blocks[at], counts)
        weight = np.repeat(weights, counts)
        bound = np.bincount(self.ranges[block], weight * self.saturation(self.most[block], self.shortest[block]), self.n_ranges)
        by_range = np.argsort(self.ranges[block], kind="stable")
        block, weight = block[by_range], weight[by_range]
        first = np.searchsorted(self.ranges[block], np.arange(self.n_ranges + 1))
        ranked = np.argsort(-bound, kind="stable")
        ranked = ranked[bound[ranked] > 0]
        scores, least, done, step = np.zeros(len(self.lengths)), 0.0, 0, max(1, -(-k // RANGE))
        while done < len(ranked):
            some = ranked[done:done + step]
            some = some[bound[some] >= least - TIE]
            if not len(some):
                break
            mine = _slices(first[some], first[some + 1] - first[some])
            sizes = self.starts[block[mine] + 1] - self.starts[block[mine]]
            posting = _slices(self.starts[block[mine]], sizes)
            doc = self.docs[posting]
            scores += np.bincount(doc, np.repeat(weight[mine], sizes) * self.saturation(
                self.tfs[posting], self.lengths[doc]), len(scores))
            if len(scores) > k:
                least = max(0.0, np.partition(scores, -k)[-k])
            done, step = done + step, step * 2
        hit = np.flatnonzero((scores > 0) & (scores >= least - TIE))
        rounded = np.round(scores[hit], 6)
        hit = hit[np.lexsort((order[hit], -rounded))]
        return hit[:k], scores[hit[:k]]


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of every pair, one after the other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts.astype(np.int64) - (ends - sizes), sizes)


def _asked(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, float]:
    """Weighted words of each query that the index has (query_id, words, weights), and the mean text length."""
    n, texts, words = index.agg(F.sum(F.size("doc_ids")), F.sum("texts"), F.sum(F.aggregate(
        "dfs", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(
        F.count("*").alias("_qtf"))
    pairs = index.select(F.explode(F.arrays_zip("words", "dfs")).alias("x")).select("x.words", "x.dfs")
    df = pairs.withColumnRenamed("words", "word").join(asked.select("word").distinct(), "word", "left_semi").groupBy(
        "word").agg(F.sum("dfs").alias("_df"))
    idf = F.log(1 + ((n or 0) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weighted = asked.join(df, "word").groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("word", (F.col("_qtf") * idf).alias("weight")))).alias("_w"))
    total = _total_length(index) if words else 0
    return weighted.select("query_id", F.col("_w.word").alias("words"), F.col("_w.weight").alias("weights")), (
        total / texts if texts else 1.0) or 1.0


def _total_length(index: DataFrame) -> int:
    """Words in all texts."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(
                int(np.frombuffer(x.as_py(), np.int32).sum(dtype=np.int64)) for x in batch.column(0))])], names=["n"])

    return index.select("lengths").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def search(index: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of a word_index for each query (query_id, text).

    Blocks of queries are broadcast to the segments while they have at most
    BROADCAST_WORDS words in all, so that nothing but results is shuffled;
    beyond, both sides are dealt to lanes.
    """
    weighted, mean = _asked(index, queries)
    weighted = materialize(weighted, "word_queries")
    size, words = weighted.agg(F.count("*"), F.sum(F.size("words"))).first()
    blocks = max(1, -(-size // QUERY_ROWS))
    # queries of one block have different hashes: at most a few more than QUERY_ROWS
    packed = weighted.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct("query_id", "words", "weights")).alias("asked"))
    types = dict(queries.dtypes)["query_id"], index.schema["doc_ids"].dataType.elementType.simpleString()
    if (words or 0) <= BROADCAST_WORDS:
        segments = index.withColumn("_lane", F.lit(0).cast("long"))
        pairs = segments.join(F.broadcast(packed.withColumn("_lane", F.lit(0).cast("long"))), "_lane")
    else:
        lanes = max(1, index.count() // 4)
        segments = index.withColumn("_lane", F.pmod(F.xxhash64("lengths", "starts"), F.lit(lanes)))
        pairs = packed.withColumn("_lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))).join(
            segments, "_lane")

    def run(batches):
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                ids, there = (column[c].slice(i, 1).flatten() for c in ("doc_ids", "words"))
                reader = _Reader({n: column[n][i].as_py() for n in (
                    "lengths", "blocks", "ranges", "starts", "most", "shortest", "docs", "tfs")}, there, k1, b, mean)
                order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                block = column["asked"].slice(i, 1).flatten()
                asked, lists, weights = block.field("query_id"), block.field("words"), block.field("weights")
                at = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), there), -1), np.int64)
                weight = weights.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))
                found = []
                for j, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
                    here = at[lo:hi] >= 0
                    if here.any():
                        docs, scores = reader.top(at[lo:hi][here], weight[lo:hi][here], k, order)
                        found.append((np.full(len(docs), j), docs, scores))
                if found:
                    j, docs, scores = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(j)), ids.take(pa.array(docs)), pa.array(scores)],
                                                     names=["query_id", "doc_id", "score"])

    found = pairs.select("asked", "doc_ids", "words", "lengths", "blocks", "ranges", "starts", "most", "shortest", "docs",
                         "tfs").mapInArrow(run, f"query_id {types[0]}, doc_id {types[1]}, score double")
    return best(found.withColumn("score", F.round("score", 6)), k)
