"""Query: the quality of every document, learned from the labels of three quarters of them."""

from logrill.llm.common import fold, table
from logrill.llm.quality import score, train

SQL = None  # a learned model; tested by held-out accuracy


def query(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 4, 2)
    logit = train(docs, labels, "quality", held)
    return score(docs.withColumn("held_out", held), logit, ["doc_id", "held_out"])
