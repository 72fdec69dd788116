"""Digests of input files and of table contents."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import quoted
from tributary.sources.ranges import all_blocks, map_blocks
from tributary.sources.tables import discover_tables

#: Bytes of a block, and digests that a node of the next level covers.
BLOCK_BYTES, FAN_OUT = 8 << 20, 1024


def content_digests(
    spark: SparkSession, root: str, files: DataFrame, *, block_bytes: int = BLOCK_BYTES, fan_out: int = FAN_OUT
) -> DataFrame:
    """``path, digest`` of ``files(path, length)`` under ``root``: a hash tree over fixed blocks, one rule for any length.

    Leaves are the SHA-256 of the file's blocks in order. Every ``fan_out``
    neighbours give one node, the SHA-256 of their digests one after the other,
    until one is left; a file of one block keeps that block's digest, which is
    the SHA-256 of the file. Blocks are read and hashed by different tasks, and
    no group holds over ``fan_out`` digests.
    """
    leaf = T.StructType([T.StructField("digest", T.StringType())])
    blocks = all_blocks(files, block_bytes)
    nodes = map_blocks(spark, root, blocks, block_bytes, lambda data: (hashlib.sha256(data).hexdigest(),), leaf)
    longest = files.agg(F.max("length")).first()[0] or 0
    widths = files.select("path", F.greatest(F.ceil(F.col("length") / block_bytes).cast("long"), F.lit(1)).alias("width"))
    nodes = nodes.join(widths, "path").select("path", "width", F.col("block").alias("place"), "digest")
    most = -(-longest // block_bytes)
    while most > 1:
        parent = F.expr(f"place div {fan_out}").alias("place")
        in_order = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda n: n["digest"])
        grouped = nodes.groupBy("path", "width", parent).agg(in_order.alias("below"))
        joined = F.sha2(F.unhex(F.array_join("below", "")), 256)
        digest = F.when(F.col("width") > 1, joined).otherwise(F.get("below", F.lit(0)))
        nodes = grouped.select("path", F.ceil(F.col("width") / fan_out).cast("long").alias("width"), "place", digest.alias("digest"))
        most = -(-most // fan_out)
    return nodes.select("path", "digest")


def file_tokens(spark: SparkSession, root: str, token: str = "stat", *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``table, relative_path, token, size`` per file.

    ``"stat"`` (length and time of change) and ``"size"`` read no contents.
    ``"sha256"`` reads all, by ``content_digests``.
    """
    if token not in ("stat", "size", "sha256"):
        raise ValueError(f"unknown token {token}")
    files = discover_tables(spark, root)
    size = F.col("length").alias("size")
    if token != "sha256":
        changed = F.unix_micros("modificationTime").cast("string")
        stat = F.concat_ws(":", F.lit("stat"), F.col("length").cast("string"), changed)
        by_size = F.concat(F.lit("size:"), F.col("length"))
        return files.select("table", "relative_path", (stat if token == "stat" else by_size).alias("token"), size)
    digests = content_digests(spark, root, files.select("path", "length"), block_bytes=block_bytes)
    return files.join(digests, "path").select("table", "relative_path", F.col("digest").alias("token"), size)


def digest_sum(digest: str) -> Column:
    """Number of MD5 digests and exact sums of their four 32-bit parts: one text, whatever their order."""
    parts = [F.conv(F.substring(digest, start, 8), 16, 10).cast("decimal(20,0)") for start in (1, 9, 17, 25)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts]
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums)


def _entries_digest(tokens: DataFrame, group: list[str]) -> DataFrame:
    """SHA-256 over the sums of the digests of ``path:token:size``, per group; one rule for any number of files."""
    entry = F.concat_ws(":", "relative_path", "token", F.col("size").cast("string"))
    hashed = tokens.select(*group, F.md5(entry).alias("entry"))
    return hashed.groupBy(*group).agg(F.sha2(digest_sum("entry"), 256).alias("fingerprint"))


def file_manifest(spark: SparkSession, root: str, token: str = "stat") -> DataFrame:
    """``table, files, bytes, fingerprint``; the digest covers ``path:token:size`` of each file."""
    tokens = file_tokens(spark, root, token)
    sizes = tokens.groupBy("table").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return sizes.join(_entries_digest(tokens, ["table"]), "table")


def data_fingerprint(spark: SparkSession, root: str, token: str = "stat") -> DataFrame:
    """One digest over all files under ``root``, by relative path."""
    return _entries_digest(file_tokens(spark, root, token), [])


def content_fingerprint(df: DataFrame) -> DataFrame:
    """``n_rows, fingerprint`` of the rows themselves, whatever their order or file layout.

    Each row gives a 128-bit digest; its four 32-bit parts are summed exactly, so
    a repeated row counts as often as it occurs.
    """
    values = [F.coalesce(quoted(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    rows = df.select(F.md5(F.concat_ws("\x1f", *values)).alias("digest"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(digest_sum("digest"), 256).alias("fingerprint"))
