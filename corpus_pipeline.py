"""From raw documents to token counts: quality, near copies, personal data, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.bpe import encode
from tributary.llm.common import table
from tributary.llm.kneser_ney import classify
from tributary.llm.mixing import mix
from tributary.llm.pseudonyms import pseudonymise
from tributary.llm.registry.op6_pseudonyms import KEY
from tributary.llm.registry.op8_bpe import RANKS
from tributary.llm.simhash import keep_one
from tributary.session import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is not above their language's threshold."""
    judged = classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return keep_one(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values under pseudonyms; ``n_chars`` counts the new text."""
    done = pseudonymise(docs, KEY)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("replaced") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long"))
    return done.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix(docs)
    # A document is taken a few times at most, so its copies are few.
    repeated = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and digests of the ids and of the bytes they decode to."""
    return encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_copies),
    ("pii_pseudonyms", privacy),
    ("source_mixing", mixture),
    ("byte_bpe", tokens),
]

#: Models and fingerprints have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
