"""Repair of all conversations after a defined damage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import table
from tributary.llm.conversations import damage, repair

NAME = "op13_conversation_repair"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation."""
    return repair(damage(table(spark, sf_dir, "conversations")), times=F.col("times"))
