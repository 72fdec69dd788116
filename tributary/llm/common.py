"""What several operators share: reading a table and the contract's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these (space, tab, line feed, vertical tab, form feed, return).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text in order; none for a null or empty text."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(pieces, lambda w: w != "")


def byte_words(data: bytes | None) -> list[bytes]:
    """The lower-cased (A to Z) words of UTF-8 bytes; ``bytes.split`` cuts at exactly the six white-space bytes."""
    return data.lower().split() if data else []


#: Rows of whole texts that go to a Python task at once; Spark's default of 10,000 long texts takes much memory twice.
TEXT_ROWS = 1_024


def small_batches(spark: SparkSession) -> None:
    """Let sessions send texts to Python tasks in batches of at most ``TEXT_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)
