"""Query: token counts and digests of every document under the multilingual byte-level vocabulary."""

import public_tokenizers

from logrill.llm.byte_bpe import digests
from logrill.llm.common import table

SQL = None  # merges by rank are not SQL; tested against tiktoken


def query(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
