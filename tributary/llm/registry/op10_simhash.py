"""Near copies among all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import table
from tributary.llm.simhash import near_copies

NAME = "op10_simhash_near_dedup"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    copies = near_copies(table(spark, sf_dir, "documents"))
    # Repeated rows of a document are one row of the operator's result.
    rows = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.select(F.col("id").alias("doc_id"), fingerprint.alias("fingerprint"), "component_id")
