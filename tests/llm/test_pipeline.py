"""The pipeline against a brute-force version of each stage, and odd rows."""

import re

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from logrill.llm.byte_bpe import Vocabulary, digests, encode_texts
from logrill.llm.secrets import BASE, MORE
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).persist())
    for before, after in zip(kept[:-2], kept[1:-1]):
        assert after.columns == docs.columns and after.count() <= before.count()
    texts = [{r["doc_id"]: r["text"] for r in df.collect()} for df in kept]
    assert len(texts[1]) >= 0.98 * len(texts[0])  # clean documents stay
    # one document of each group stays
    groups = brute(texts[1].items(), 5, 80, 100)
    assert set(texts[2]) == {i for i, (_, c) in groups.items() if c == i}
    # every document with a whole item goes, documents without a word of it stay
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {i for i, t in texts[2].items() if any(x in t for x in items)}
    assert gone == set(texts[2]) - set(texts[3])
    for i, text in texts[3].items():
        for rule in [*BASE, *MORE]:
            text = re.sub(rule.regex, lambda m, rule=rule: m[0] if len(m[rule.group]) < rule.least else f"[{rule.kind}]", text)
        assert len(texts[4][i]) == len(text) or "[" in text
        assert not re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", texts[4][i])
    vocab = Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ids, special_tokens={})
    for r in kept[5].collect():
        assert r["text"] == texts[4][r["doc_id"]] and r["ids"] == reference.encode_ordinary(r["text"])
    assert kept[5].count() == len(texts[4])


def test_odd_rows(spark, odd, empty):
    rows, none = odd, empty
    for _, stage in corpus_pipeline.STAGES[:4]:
        rows, none = stage(spark, rows, SF), stage(spark, none, SF)
        assert rows.columns == odd.columns
    ids = {r["doc_id"] for r in rows.collect()}
    assert 1 not in ids and 2 not in ids and 8 not in ids  # no letter, no language
    assert 3 in ids and 4 not in ids and 5 in ids and None in ids
    assert rows.where("text LIKE '%[assign]%'").count() == 1
    assert none.count() == 0
    last = corpus_pipeline.STAGES[4][1](spark, rows, SF)
    assert last.columns == [*odd.columns, "ids"] and last.where(F.size("ids") == 0).count() == 0


def test_texts_reach_python_in_small_batches(spark):
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat("id", F.expr("repeat(' some words', 1000)")).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    steps = [
        lambda: corpus_pipeline.language(spark, docs.limit(100), SF), lambda: corpus_pipeline.near_duplicates(spark, docs.limit(100), SF),
        lambda: encode_texts(docs, *vocabulary), lambda: digests(docs, *vocabulary)]
    before = spark.conf.get(size, None)
    try:
        for step in steps:
            spark.conf.unset(size)
            step()
            found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert sum(found) > 30_000_000 and max(found) < 5_000_000
        spark.conf.set(size, "1m")  # what the session names stays
        for step in steps:
            step()
            assert spark.conf.get(size) == "1m"
    finally:
        spark.conf.unset(size)
        if before is not None:
            spark.conf.set(size, before)
