"""Stages that turn raw documents into training text.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. Every stage but the last returns the columns of `docs` as they came, also
extra ones, whatever their names, and the last replaces `text` by the text
decoded from its token ids and adds the ids. Rows of a repeated
doc_id stand and fall together where a stage decides by id, and a row without
doc_id is never dropped for another one. Null and
empty texts are dropped by the first stage, as they have no language. An empty
table stays empty, with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrill.llm.byte_bpe import encode_texts
from logrill.llm.common import fold, table
from logrill.llm.decontaminate import leaks
from logrill.llm.jaccard import jaccard_components
from logrill.llm.language import identify
from logrill.llm.secrets import BASE, MORE, masked, scan
from logrill.session import materialize

ORACLE_SQL = None  # the stages learn a model and merge by rank; tested against a brute-force version


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, lang and text beside `row`, a struct of all columns: names of extra columns clash with nothing."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "lang", "text")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in `dropped` (one column, doc_id), which may grow with docs."""
    return _packed(docs).join(dropped.hint("merge"), "doc_id", "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model of their language rejects, and those without a letter."""
    rows, held = _packed(docs), fold("doc_id", 4, 2)
    judged = identify(rows, rows.where(~held & F.col("lang").isNotNull()), held, ["row"])
    return judged.where(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group linked at a similarity of 0.8 over five-word shingles, the smallest doc_id."""
    groups = jaccard_components(docs.select("doc_id", "text"), words=5, num=80, den=100)
    return _without(docs, materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "copies"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or its template."""
    found = leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id").distinct())


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret by its kind in brackets; no document is dropped."""
    found = scan(docs, [*BASE, *MORE])
    text = masked(F.col("row.text"), F.col("spans")).alias("text")
    return found.select(*(text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text; returns all columns, the text as decoded from the ids, and the ids."""
    encoded = encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    text = F.col("decoded").cast("string")
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    return encoded.select(*(text.alias("text") if c == "text" else F.col(c) for c in kept), "ids")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
