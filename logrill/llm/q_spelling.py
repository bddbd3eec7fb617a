"""Query: the spelling variants among all words of `documents`."""

from logrill.llm.common import table
from logrill.llm.spelling import spelling_variants

SQL = None  # DuckDB has no crc32; tested against a brute-force version


def query(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))
