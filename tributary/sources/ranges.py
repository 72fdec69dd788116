"""Fixed blocks of files, read by the tasks; no task reads a whole large file."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import closing

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemes that a task opens by itself. Files elsewhere are read by Spark, whole, which it does up to 2 GiB a file.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}
#: Blocks that one row asks for, so that a file is opened once for many.
AT_ONCE = 16


def all_blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    """``path, blocks``: every block number of ``files(path, length)``."""
    last = F.ceil(F.col("length") / block_bytes).cast("long") - 1
    first = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(AT_ONCE).cast("long")))
    starts = files.select("path", last.alias("last"), first.alias("first"))
    return starts.select("path", F.sequence("first", F.least(F.col("first") + AT_ONCE - 1, "last")).alias("blocks"))


def opened(path: str) -> pa.NativeFile:
    """A file of one of ``SCHEMES``, of which only what is asked for is read."""
    scheme, rest = path.split(":", 1)
    rest = rest.lstrip("/")
    if SCHEMES[scheme] == "file":
        return pafs.LocalFileSystem().open_input_file(f"/{rest}")
    system, _ = pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{rest.split('/', 1)[0]}")
    return system.open_input_file(rest)


def map_blocks(
    spark: SparkSession, root: str, wanted: DataFrame, block_bytes: int, use: Callable[[bytes], tuple], fields: T.StructType
) -> DataFrame:
    """``path, block`` and what ``use`` gives for the block's bytes, for ``wanted(path, blocks)`` under ``root``.

    ``use`` gives one value per field. Tasks read just the blocks of their rows.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("block", T.LongType()), *fields])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = schema.fieldNames()
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    def from_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with closing(opened(row["path"])) as f:
                    yield table([(row["path"], b, *use(f.read_at(block_bytes, b * block_bytes))) for b in row["blocks"]])

    def from_contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, blocks) in enumerate(zip(batch.column("path").to_pylist(), batch.column("blocks").to_pylist(), strict=True)):
                whole = memoryview(batch.column("content")[i].as_buffer())
                yield table([(path, b, *use(bytes(whole[b * block_bytes : (b + 1) * block_bytes]))) for b in blocks])

    arrow = spark.createDataFrame([], schema).toArrow().schema
    mine = F.regexp_extract("path", "^([A-Za-z0-9]+):", 1).isin(*SCHEMES)
    out = wanted.where(mine).repartition("path", "blocks").mapInArrow(from_files, schema)
    others = wanted.where(~mine)
    if others.isEmpty():
        return out
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    per_file = others.groupBy("path").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))
    return out.unionByName(contents.join(per_file, "path").mapInArrow(from_contents, schema))
