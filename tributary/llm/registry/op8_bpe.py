"""Token ids of all documents, and back."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tributary.llm.bpe import encode
from tributary.llm.common import table

NAME = "op8_byte_bpe"
SQL = None
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
