"""Encoding gives tiktoken's ids, decoding gives the bytes back."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from logrill.llm.byte_bpe import Encoder, Vocabulary, digests, encode_texts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ids, special_tokens={})


def test_same_ids_as_tiktoken(vocab, reference):
    random.seed(3)
    texts = ["".join(random.choice("aAbe1 \n\t'sé漢!　\x1c") for _ in range(random.randrange(60))) for _ in range(2000)]
    texts += ["a" * 3000, "xyz" * 700, " " * 900, "é" * 333, "", " ", "\n", "it's  we'll 've", "end "]
    encoder = Encoder(vocab, remember=500)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert vocab.decode(ids) == text.encode()


def test_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in digests(docs, PATH, public_tokenizers.PATTERN).collect():
        ids = reference.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, odd, empty):
    rows = encode_texts(odd.withColumn("ids", odd["doc_id"]), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert bytes(r["decoded"]).decode() == (r["text"] or "") and (bool(r["ids"]) == bool(r["text"]))
    assert digests(odd, PATH, public_tokenizers.PATTERN).where("n_tokens = 0").count() == 3
    assert encode_texts(empty, PATH, public_tokenizers.PATTERN).count() == 0
