"""All documents, shuffled whole into 16 shards."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import table
from tributary.llm.sharding import SHARDS, external_shuffle, record_bytes

NAME = "op5_external_shuffle"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document."""
    docs = table(spark, sf_dir, "documents")
    shuffled = external_shuffle(docs, size=record_bytes(docs["text"]), shards=SHARDS)
    return shuffled.select(
        "doc_id",
        record_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
