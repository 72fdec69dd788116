"""Nearest neighbours among all embeddings."""

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.ann import nearest
from tributary.llm.common import table

NAME = "op1_posting_list_ann"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: 20 nearest of each row whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))
