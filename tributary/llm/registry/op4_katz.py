"""Katz scores of all documents under a model of all training documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import table
from tributary.llm.katz import score

NAME = "op4_katz_backoff"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    scored = score(table(spark, sf_dir, "documents"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
