"""Query: the toxicity of every document, learned from the labels of two thirds of them."""

from logrill.llm.common import fold, table
from logrill.llm.toxicity import toxicity

SQL = None  # a learned model; tested by held-out accuracy


def query(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 3, 1)
    return toxicity(docs.withColumn("held_out", held), labels, held, ["doc_id", "held_out"])
