"""Queries over name resolution, retrieval and topics."""

from pyspark.sql import functions as F

from logrill.operators import concepts, resolve, retrieval
from logrill.session import materialize
from logrill.sources import fixture as fx

AS_OF = fx.AS_OF


def _names(spark, sf):
    """Loose names: a whole name, a fragment, words, and names that do not exist."""
    n = F.col("s_suppkey")
    text = n.cast("string")
    return fx.table(spark, sf, "supplier").select(
        n.alias("request_id"),
        F.when(n % 5 == 0, F.concat(F.lit("node-"), text)).when(n % 5 == 1, F.concat(F.lit("ODE-"), text))
        .when(n % 5 == 2, F.concat(F.lit("depot DEV-"), text)).when(n % 5 == 3, F.concat(F.lit("10.0.0."), text))
        .otherwise(F.concat(F.lit("nowhere "), text)).alias("name"))


def resolve_hostnames(spark, sf):
    return resolve.resolve_hostnames(_names(spark, sf).select("name"), fx.events(spark, sf).select("hostname"))


def resolve_programs(spark, sf):
    fragments = fx.events(spark, sf).select(F.explode(F.split("program", ",")).alias("name")).unionByName(
        fx.events(spark, sf).select(F.upper(F.substring("program", 2, 3)).alias("name"))).distinct()
    return resolve.resolve_programs(fragments, fx.events(spark, sf).select("program"))


def resolve_reasons(spark, sf):
    return resolve.resolve_reasons(fx.phrases(spark, sf))


def resolved_count(spark, sf):
    requests = _names(spark, sf).select(
        "request_id", F.when(F.col("request_id") % 7 != 0, F.col("name")).alias("hostname"),
        F.when(F.col("request_id") % 3 == 0, "interface").when(F.col("request_id") % 3 == 1, "sshd").alias("program"))
    return resolve.resolved_count(requests, fx.events(spark, sf).select("hostname", "program"))


def _docs(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _vector_queries(spark, sf):
    return fx.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), "embedding")


def knn_exact(spark, sf):
    return retrieval.knn_exact(_docs(spark, sf), _vector_queries(spark, sf), 10)


def knn_approx(spark, sf):
    return retrieval.knn_approx(_docs(spark, sf), _vector_queries(spark, sf), 10)


def bm25(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    asked = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(docs, asked, 10)


def hybrid_search(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text").join(_docs(spark, sf), "doc_id", "left")
    asked = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(
        _docs(spark, sf).withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    return retrieval.hybrid_search(docs, asked, 10)


def window_hits(spark, sf):
    docs = fx.events(spark, sf).where("is_anomaly = 1").withColumnRenamed("event_id", "doc_id")
    return retrieval.window_hits(docs, vendor="juniper", start="2024-01-05", end="2024-01-25").select(
        "doc_id", "event_time", "source_ip", "message")


def coverage(spark, sf):
    """Each device asks for a day, a vendor's hours, or everything of its own."""
    n = F.col("s_suppkey")
    day = F.make_timestamp_ntz(F.lit(2024), F.lit(1), (n % 30 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    requests = fx.table(spark, sf, "supplier").select(
        n.alias("request_id"), F.when(n % 4 != 3, fx.device_ip("s_suppkey")).alias("source_ip"),
        F.when(n % 4 > 1, "juniper").alias("vendor"), F.when(n % 4 != 1, day).alias("start"),
        F.when(n % 4 != 1, day + F.expr("interval 12 hours")).alias("end"))
    events = fx.events(spark, sf)
    return retrieval.coverage(events, events.where("is_anomaly = 1 and event_time < '2024-01-20'"), requests)


def summarize_hits(spark, sf):
    return retrieval.summarize_hits(fx.events(spark, sf))


def _topic_tables(spark, sf):
    """Retrieved hits per question, the events, and the known vendors and programs."""
    events = fx.events(spark, sf)
    asked = fx.questions(spark, sf)
    docs = events.select(F.col("event_id").alias("doc_id"), F.col("message").alias("text"))
    phrases = concepts.phrase_concept(asked, "question").select("query_id", F.col("concept").alias("text"))
    found = retrieval.bm25(docs, phrases, 15)
    hits = found.join(events.select(F.col("event_id").alias("doc_id"), "message", "program"), "doc_id").join(
        asked, "query_id")
    hits = materialize(hits.select("query_id", "question", "doc_id", "message", "program"), "hits")
    known = materialize(events.select("vendor", "program").distinct(), "known")
    return hits, events, known.select("vendor").distinct(), known.select("program").distinct()


def concept_tokens(spark, sf):
    hits, _, vendors, programs = _topic_tables(spark, sf)
    return concepts.concept_tokens(hits, vendors, programs)


def significant_programs(spark, sf):
    hits = _topic_tables(spark, sf)[0]
    return concepts.significant_programs(hits).withColumn("share", F.round("share", 6))


def concept_ranking(spark, sf):
    return concepts.concept_ranking(*_topic_tables(spark, sf), "2024-01-02", AS_OF)


def concept_ranking_vendors(spark, sf):
    return concepts.concept_ranking(*_topic_tables(spark, sf), "2024-01-02", AS_OF, by="vendor")


def concept_count(spark, sf):
    return concepts.concept_count(*_topic_tables(spark, sf), "2024-01-10", AS_OF)


def concept_listing(spark, sf):
    return concepts.concept_listing(*_topic_tables(spark, sf), "2024-01-10", AS_OF)


def phrase_concept(spark, sf):
    return concepts.phrase_concept(fx.table(spark, sf, "conversations")).select("conv_id", "turn", "concept")


def claim_audit(spark, sf):
    rows = fx.answers(spark, sf)
    return concepts.claim_audit(rows, rows.select("answer_id", "value"))


QUERIES = {f.__name__: f for f in (
    resolve_hostnames, resolve_programs, resolve_reasons, resolved_count, knn_exact, knn_approx, bm25,
    hybrid_search, window_hits, coverage, summarize_hits, concept_tokens, significant_programs,
    concept_ranking, concept_ranking_vendors, concept_count, concept_listing, phrase_concept, claim_audit)}
