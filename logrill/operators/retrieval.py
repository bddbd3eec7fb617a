"""Keyword, vector and hybrid retrieval; coverage of the index."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.functions.clock import ntz
from logrill.functions.text import strip
from logrill.operators.vectorindex import matrix, nearest, unit
from logrill.operators.wordindex import best, search, word_index

RRF_CONSTANT = 60


def filter_docs(docs: DataFrame, source_ip: str | None = None, vendor: str | None = None,
                start=None, end=None) -> DataFrame:
    """The structural filters both searches apply first."""
    rows = docs
    if source_ip:
        rows = rows.where(F.col("source_ip") == source_ip)
    if vendor:
        rows = rows.where(F.col("vendor") == vendor)
    if start:
        rows = rows.where(F.col("event_time") >= ntz(start))
    if end:
        rows = rows.where(F.col("event_time") <= ntz(end))
    return rows


def _blocks(df: DataFrame, key: str, rows: int, number: str) -> DataFrame:
    """Blocks of about ``rows`` vectors, each an array of (key, embedding)."""
    count = df.agg(F.ceil(F.count("*") / rows).alias("n")).scalar()
    return df.select(F.struct(key, F.col("embedding").cast("array<double>").alias("embedding")).alias("v"), F.pmod(
        F.xxhash64(key), F.greatest(count, F.lit(1))).alias(number)).groupBy(number).agg(F.collect_list("v").alias(key + "s"))


def knn_exact(docs: DataFrame, queries: DataFrame, k: int = 10, query_rows: int = 256,
              doc_rows: int = 2048) -> DataFrame:
    """k nearest documents (doc_id, embedding) by cosine for each (query_id, embedding).

    Every block of queries is laid beside every block of documents by an
    equi-join on lanes; a pair of blocks is one matrix product, and only its
    best k per query leave the task.
    """
    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # vectors stay Arrow arrays; one pair of blocks is a matrix at a time
                asked, there = (batch.column(n).slice(i, 1).flatten() for n in ("query_ids", "doc_ids"))
                ids = there.field("doc_id")
                order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                scores = np.round(unit(matrix(there.field("embedding"))) @ unit(matrix(asked.field("embedding"))).T, 6)
                found = [np.lexsort((order, -scores[:, j]))[:k] for j in range(len(asked))]
                row, col = np.concatenate(found), np.repeat(np.arange(len(asked)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [asked.field("query_id").take(pa.array(col)), ids.take(pa.array(row)),
                     pa.array(scores[row, col], from_pandas=True)], names=["query_id", "doc_id", "score"])

    types = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
    there = _blocks(docs, "doc_id", doc_rows, "_d")
    lanes = max(1, -(-docs.count() // (4 * doc_rows)))  # about four blocks of documents each
    lane = F.pmod("_d", F.lit(lanes)).alias("_lane")
    asked = _blocks(queries, "query_id", query_rows, "_q").withColumn("_lane", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    found = asked.join(there.select("doc_ids", lane).hint("merge"), "_lane").select(
        "query_ids", "doc_ids").mapInArrow(search, f"query_id {types[0]}, doc_id {types[1]}, score double")
    return best(found, k)


def knn_approx(docs: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None,
               probes: int | None = None) -> DataFrame:
    """Neighbours from an inverted file of 8-bit codes, re-ranked by the full vectors.

    Unfiltered search only. Without `probes` no cell that could hold one of the
    k best is left out, and the rows are those of knn_exact; with it the search
    ends after so many cells.
    """
    return nearest(docs, queries, k, cells, probes=probes)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents (doc_id, text) for each query (query_id, text) that share a word with it."""
    return search(word_index(docs), queries, k, k1, b)


def fuse(rankings: list[DataFrame], k: int = 10, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) lists."""
    together = rankings[0].select("query_id", "doc_id", "rank")
    for other in rankings[1:]:
        together = together.unionByName(other.select("query_id", "doc_id", "rank"))
    summed = together.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 6).alias("score"))
    return best(summed, k)


def hybrid_search(docs: DataFrame, queries: DataFrame, k: int = 10, **filters) -> DataFrame:
    """Words and vectors, each filtered, each its best k, fused by rank.

    With filters the vector side is exact over what they leave; so it is without,
    ``knn_approx`` being the cheaper choice for a whole index. Documents and
    queries without a vector (null) take part by their words.
    """
    kept = filter_docs(docs, **filters)
    return fuse([bm25(kept.select("doc_id", "text"), queries.select("query_id", "text"), k),
                 knn_exact(kept.where("embedding IS NOT NULL"), queries.where("embedding IS NOT NULL"), k)], k)


def window_hits(docs: DataFrame, n: int | None = None, **filters) -> DataFrame:
    """Complete listing of what the filters select, oldest first; only the first ``n`` if asked."""
    rows = filter_docs(docs, **filters).orderBy("event_time", "doc_id")
    return rows if n is None else rows.limit(n)


def _matched(requests: DataFrame, rows: DataFrame, *aggregates) -> DataFrame:
    """Aggregate the rows each request selects (null fields select all).

    A row is keyed by the four combinations of (address, vendor) a request can
    ask for, so requests and rows meet in an equi-join.
    """
    mask = F.when(F.col("source_ip").isNotNull(), 1).otherwise(0) + F.when(F.col("vendor").isNotNull(), 2).otherwise(0)
    asked = requests.select(
        "request_id", mask.alias("_mask"), F.coalesce("source_ip", F.lit("")).alias("_ip"),
        F.coalesce("vendor", F.lit("")).alias("_vendor"), "start", "end")
    used = F.broadcast(asked.select("_mask").distinct())  # at most four rows
    keyed = rows.withColumn("_mask", F.explode(F.array(*[F.lit(i) for i in range(4)]))).join(
        used, "_mask", "left_semi").withColumns({
            "_ip": F.when(F.col("_mask").bitwiseAND(F.lit(1)) != 0, F.col("source_ip")).otherwise(""),
            "_vendor": F.when(F.col("_mask").bitwiseAND(F.lit(2)) != 0, F.col("vendor")).otherwise("")})
    inside = (F.col("start").isNull() | (F.col("event_time") >= F.col("start"))) & (
        F.col("end").isNull() | (F.col("event_time") <= F.col("end")))
    return keyed.drop("source_ip", "vendor").join(asked, ["_mask", "_ip", "_vendor"]).where(inside).groupBy(
        "request_id").agg(*aggregates)


def coverage(events: DataFrame, docs: DataFrame, requests: DataFrame, anomalies_only: bool = True) -> DataFrame:
    """Why a search (request_id, source_ip, vendor, start, end) came back empty.

    Looks only at requests without indexed documents that name a device or both
    ends of a range: none (no raw rows either), not_indexed_yet, never_indexed.
    """
    narrow = requests.where(F.col("source_ip").isNotNull() | (F.col("start").isNotNull() & F.col("end").isNotNull()))
    found = _matched(narrow, docs.select("source_ip", "vendor", "event_time"), F.count("*").alias("_hits"))
    empty = narrow.join(found, "request_id", "left_anti")
    raw = _matched(empty, events.select("source_ip", "vendor", "event_time", "is_anomaly"),
                   F.count("*").alias("total"), F.count_if(F.col("is_anomaly") == 1).alias("anomalous"))
    total, odd = F.coalesce("total", F.lit(0)), F.coalesce("anomalous", F.lit(0))
    never = F.lit(anomalies_only) & (odd == 0)
    return empty.join(raw, "request_id", "left").select(
        "request_id", total.alias("total"), odd.alias("anomalous"),
        F.when(total == 0, "none").when(never, "never_indexed").otherwise("not_indexed_yet").alias("verdict"))


def summarize_hits(hits: DataFrame) -> DataFrame:
    """Per category: count, severities, top three programs, an example, reasons, span."""
    rows = hits.withColumn("category", F.coalesce(F.nullif(F.col("predicted_category"), F.lit("")), F.lit("uncategorized")))
    program = F.trim(F.coalesce("program", F.lit("")))
    named = rows.where((program != "") & ~program.rlike("^[0-9]+$"))
    counts = named.groupBy("category", program.alias("program")).agg(F.count("*").alias("_n"), F.min(
        F.struct("event_time", "event_id")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("_n"), "_first"))
    top = counts.withColumn("_p", place).where("_p <= 3").groupBy("category").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_p", F.format_string("%s x%d", "program", "_n").alias("t")))),
        lambda x: x["t"]), ", ").alias("programs"))
    base = rows.groupBy("category").agg(
        F.count("*").alias("message_count"),
        F.array_join(F.array_sort(F.collect_set("severity")), "/").alias("severities"),
        F.min_by(strip("message"), F.struct("event_time", "event_id")).alias("example"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("anomaly_reasons")))), ", ").alias("reasons"),
        F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))
    return base.join(top, "category", "left")
