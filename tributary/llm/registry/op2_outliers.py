"""Quality of all documents by robust distance of their statistics."""

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import table
from tributary.llm.outliers import classify

NAME = "op2_robust_outliers"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, base statistics, ``base_failed, distance, kept`` of every document."""
    judged = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"
    )
