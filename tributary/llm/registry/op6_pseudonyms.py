"""Personal data of all documents under pseudonyms."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import table
from tributary.llm.pseudonyms import pseudonymise

NAME = "op6_feistel_pseudonyms"
SQL = None
#: A real run passes a secret of its own.
KEY = "not-a-secret: replace in production"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, n_replaced, kinds`` of every document."""
    done = pseudonymise(table(spark, sf_dir, "documents"), KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("replaced", lambda r: r["kind"]))), ",")
    return done.select("doc_id", "text", F.size("replaced").alias("n_replaced"), kinds.alias("kinds"))
