"""Quality of all documents by perplexity under trusted text."""

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import table
from tributary.llm.kneser_ney import classify

NAME = "op7_kneser_ney_quality"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity, high, kept`` of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, labels, keep=["doc_id", "lang"])
