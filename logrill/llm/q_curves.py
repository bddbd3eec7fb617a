"""Query: the ten nearest vectors found for every hundredth embedding, by Euclidean distance."""

from logrill.llm.common import table
from logrill.llm.curves import nearest, real_vectors

SQL = None  # approximate; recall and distances are tested against brute force


def query(spark, sf_dir):
    vectors = real_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors.where("id % 100 = 0"), vectors, k=10)
