"""What the files of a data folder hold and whether they can be read, before any table is loaded."""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterable, Iterator
from contextlib import closing
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import orc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import quoted
from tributary.session import durable, in_parallel
from tributary.sources.ranges import all_blocks, map_blocks, opened
from tributary.sources.tables import FORMATS, discover_tables, file_format, read_folder, read_table, union_rows

#: Formats whose files end in their own row counts.
WITH_FOOTERS = ("parquet", "orc")
#: Bytes of text that are read to estimate rows, in blocks of so many bytes.
SAMPLE_BYTES, SAMPLE_BLOCK = 1_000_000, 16_384
#: Standard errors between an estimate and its bounds.
ERRORS = 3
#: Broken files that one warning each is given for; all of them are in the accounts.
WARNED = 100
#: Schemes of files that a task opens by itself to see what is wrong with them; Spark reads the others, with the session's rights.
OPENED = ("file",)
#: Bytes up to which Spark hands the contents of such a file to a task; longer ones are judged by its readers, so many at a time.
WHOLE_BYTES, AT_ONCE = 64 << 20, 8
#: Bytes of compressed text in and out at a time.
CHUNK = 1 << 20

READ, EMPTY, CUT, BROKEN = "read", "empty", "cut short", "unreadable"


def _known_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of known formats, with ``fmt`` and whether they are compressed."""
    files = discover_tables(spark, root).withColumn("fmt", file_format(F.col("path")))
    return files.where(F.col("fmt") != "").withColumn("packed", _packed())


def _packed() -> Column:
    return ~F.lower("path").rlike(r"\.(" + "|".join(FORMATS) + r")$")


def _paths(root: str, own: DataFrame) -> list[str]:
    """What to read for the files ``own`` of one table: its folder, and those directly at the root by name."""
    inside = F.instr("relative_path", "/") > 0
    loose = [r["path"] for r in own.where(~inside).select("path").collect()]
    table = own.where(inside).select("table").first()
    return loose + ([f"{root.rstrip('/')}/{table['table']}"] if table else [])


def _per_file(df: DataFrame, value: Column) -> DataFrame:
    """``path`` as listings write it, and an aggregate of each file's rows; the metadata column escapes signs."""
    found = df.groupBy(F.col("_metadata.file_path").alias("escaped")).agg(value)
    path = F.url_decode(F.replace("escaped", F.lit("+"), F.lit("%2B")))
    return found.select(path.alias("path"), *found.columns[1:])


def _ends_early(file: pa.NativeFile) -> bool:
    """Whether gzipped data have no end; neither they nor what they unpack to are held whole."""
    unpacking = zlib.decompressobj(31)
    while not unpacking.eof:
        data = unpacking.unconsumed_tail or file.read(CHUNK)
        if not unpacking.decompress(data, CHUNK) and not data and not unpacking.eof:
            return True
    return False


def _trouble(fmt: str, packed: bool, file: pa.NativeFile) -> str | None:
    """Why a file without rows can't be read, or None if it just holds none; of Parquet and ORC only the end is read."""
    try:
        if fmt == "parquet":
            pq.ParquetFile(file)
        elif fmt == "orc":
            orc.ORCFile(file)
        elif packed and file.read(2) == b"\x1f\x8b":
            file.seek(0)
            return "the compressed data end too early" if _ends_early(file) else None
    except (pa.ArrowException, OSError, zlib.error) as e:
        return f"{type(e).__name__}: {e}"[:200]
    return None


def _explain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a ``reason``, for which files that are asked for are opened."""

    def reason(path: str, fmt: str, packed: bool, asked: bool) -> str | None:
        if not asked:
            return None
        with closing(opened(path)) as file:
            return _trouble(fmt, packed, file)

    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("path", "fmt", "packed", "asked"))
        yield batch.append_column("reason", pa.array([reason(*row) for row in zip(*columns, strict=True)], pa.string()))


def _explain_contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, columns = batch.column("content"), (batch.column(n).to_pylist() for n in ("fmt", "packed"))
        files = (pa.BufferReader(content[i].as_buffer()) for i in range(len(content)))
        reasons = [_trouble(*row) for row in zip(*columns, files, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(reasons, pa.string())], ["path", "reason"])


def _by_name(path: str) -> str:
    """A path whose signs are no pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _judged(spark: SparkSession, file: Row) -> tuple[str, str | None]:
    """What Spark's own reader says of one file; columns of Parquet and ORC are not read."""
    reader = spark.read.format(FORMATS[file["fmt"]]).option("ignoreCorruptFiles", "false").schema("line string")
    try:
        reader.load(_by_name(file["path"])).count()
    except Exception as e:
        return file["path"], f"{type(e).__name__}: {e}"[:200]
    return file["path"], None


def _read_by_spark(spark: SparkSession, silent: list[Row]) -> DataFrame:
    """``path, reason`` of files that tasks can't open; only these files are read."""
    parts = [spark.createDataFrame([], "path string, reason string")]
    short = [_by_name(r["path"]) for r in silent if r["length"] <= WHOLE_BYTES]
    if short:
        contents = spark.read.format("binaryFile").load(short)
        contents = contents.select("path", "content", file_format(F.col("path")).alias("fmt"), _packed().alias("packed"))
        parts.append(contents.mapInArrow(_explain_contents, "path string, reason string"))
    # Plain text can always be read.
    long = [r for r in silent if r["length"] > WHOLE_BYTES and (r["packed"] or r["fmt"] in WITH_FOOTERS)]
    if long:
        said = in_parallel(spark, [partial(_judged, spark, r) for r in long], AT_ONCE)
        parts.append(spark.createDataFrame(said, "path string, reason string"))
    return union_rows(*parts)


def account_files(spark: SparkSession, root: str, *, schemas: dict[str, T.StructType] | None = None, decode: bool = True) -> DataFrame:
    """``table, relative_path, length, rows, stored, status, reason`` of every file of a known format.

    ``rows`` are those that reading all columns gives (with ``decode``, else
    those of the footer), ``stored`` those that the file's footer names, null
    for text. Files that give fewer rows than they store are ``cut short``;
    files that give none, and no others, are opened once more to tell ``empty``
    from ``unreadable``, and ``reason`` says what is wrong. A broken file is
    reported here, while reading with ``skip_corrupt`` leaves its rows out
    unseen. Of files on other stores than ``OPENED`` the counts are taken at
    once, as Spark must be told which to read again.
    """
    files = _known_files(spark, root)
    kinds = files.select("table", "fmt").distinct().orderBy("table", "fmt").collect()
    parts = []
    for kind in kinds:
        own = (F.col("table") == kind["table"]) & (F.col("fmt") == kind["fmt"])
        paths = _paths(root, files.where(own))
        schema = (schemas or {}).get(kind["table"])
        stored = F.lit(None).cast("long")
        try:
            df = read_table(spark, paths, fmt=kind["fmt"], schema=schema, skip_corrupt=True)
        except Exception as e:  # no file of the table gives a schema
            parts.append(files.where(own).select("path", F.lit(None).cast("long").alias("rows"), stored.alias("stored"), F.lit(str(e)[:200]).alias("failed")))
            continue
        every = F.count(F.lit(1))
        if decode and df.columns:
            # A digest of all columns, or none would be read for a count.
            every = F.when(F.bit_xor(F.xxhash64(*[quoted(c) for c in df.columns])).isNotNull(), every)
        found = _per_file(df, every.alias("rows"))
        if kind["fmt"] in WITH_FOOTERS:
            footers = _per_file(df, F.count(F.lit(1)).alias("stored"))
            found = footers.join(found, "path", "left")
        else:
            found = found.withColumn("stored", stored)
        parts.append(found.select("path", "rows", "stored", F.lit(None).cast("string").alias("failed")))
    if not parts:
        parts = [spark.createDataFrame([], "path string, rows long, stored long, failed string")]
    seen = files.join(union_rows(*parts), "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    silent = (F.col("rows") == 0) & (F.col("length") > 0)
    near = F.regexp_extract("path", "^([A-Za-z0-9]+):", 1).isin(*OPENED)
    far = not files.where(~near).isEmpty()
    if far:
        seen = durable(seen, "accounts")
    # As many tasks as other shuffles have, which small rows alone would not get.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = seen.drop("modificationTime").withColumn("asked", silent & near).repartition(tasks, "path")
    explained = asked.mapInArrow(_explain, T.StructType([*asked.schema, T.StructField("reason", T.StringType())]))
    if far:
        said = _read_by_spark(spark, seen.where(silent & ~near).select("path", "fmt", "packed", "length").collect())
        explained = explained.join(said.withColumnRenamed("reason", "said"), "path", "left").withColumn("reason", F.coalesce("reason", "said"))
    seen = explained.withColumn("reason", F.coalesce("reason", "failed"))
    status = (
        F.when(F.col("reason").isNotNull(), BROKEN)
        .when(F.col("rows") < F.col("stored"), CUT)
        .when(F.col("rows") == 0, EMPTY)
        .otherwise(READ)
    )
    return seen.select("table", "relative_path", "length", "rows", "stored", status.alias("status"), "reason")


def read_folder_checked(
    spark: SparkSession, root: str, *, schemas: dict[str, T.StructType] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables under ``root`` without their broken files, and the accounts of all files; broken ones are warned of."""
    accounts = account_files(spark, root, schemas=schemas).persist()
    bad = accounts.where(F.col("status").isin(CUT, BROKEN))
    for r in bad.orderBy("relative_path").limit(WARNED).collect():
        warnings.warn(f"{r['relative_path']} is {r['status']}: {r['reason'] or f'''{r['rows']} of {r['stored']} rows'''}", stacklevel=2)
    return read_folder(spark, root, skip_corrupt=True, schemas=schemas), accounts


def _sampled(files: DataFrame, total: int, sample_bytes: int, block_bytes: int) -> DataFrame:
    """Blocks at hashed places, as many in a file as its share of all bytes asks for."""
    wanted = F.col("length") / F.lit(float(total)) * F.lit(sample_bytes / block_bytes)
    chance = F.pmod(F.xxhash64("path"), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(wanted + chance).cast("long")
    blocks = F.greatest(F.floor(F.col("length") / block_bytes).cast("long"), F.lit(1))
    places = F.transform(F.sequence(F.lit(1).cast("long"), F.col("times")), lambda i: F.pmod(F.xxhash64("path", i), F.col("n")))
    return files.select("path", times.alias("times"), blocks.alias("n")).where("times > 0").select("path", places.alias("blocks"))


def estimate_rows(
    spark: SparkSession, root: str, *, sample_bytes: int = SAMPLE_BYTES, block_bytes: int = SAMPLE_BLOCK
) -> DataFrame:
    """``table, fmt, files, bytes, rows, low, high, method`` of every table, without scanning it.

    Parquet and ORC files name their rows in their footers (``footers``, exact).
    Of text, blocks of about ``sample_bytes`` in all are read at hashed places;
    lines per byte give the rows, and the spread between blocks the bounds
    (``sample``, ``ERRORS`` standard errors). Text of fewer bytes is read whole
    (``lines``, exact but for line breaks inside quotes). A header line per CSV
    file is taken off. Rows of compressed text can't be told from its length: null.
    """
    files = _known_files(spark, root)
    kinds = files.groupBy("table", "fmt", "packed").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    ).orderBy("table", "fmt", "packed").collect()
    fields = T.StructType([T.StructField(n, T.LongType()) for n in ("lines", "size", "open")])
    out = []
    for k in kinds:
        own = files.where((F.col("table") == k["table"]) & (F.col("fmt") == k["fmt"]) & (F.col("packed") == k["packed"]))
        base = (k["table"], k["fmt"], k["files"], k["bytes"])
        if k["fmt"] in WITH_FOOTERS:
            rows = read_table(spark, _paths(root, own), fmt=k["fmt"], skip_corrupt=True).count()
            out.append((*base, rows, rows, rows, "footers"))
            continue
        if k["packed"]:
            out.append((*base, None, None, None, "unknown"))
            continue
        headers = k["files"] if k["fmt"] == "csv" else 0
        whole = k["bytes"] <= sample_bytes
        blocks = all_blocks(own, block_bytes) if whole else _sampled(own, k["bytes"], sample_bytes, block_bytes)
        counted = map_blocks(spark, root, blocks, block_bytes, _lines, fields)
        if whole:
            last = F.max(F.struct("block", "open", "size"))
            rows = counted.groupBy("path").agg(F.sum("lines").alias("lines"), last.alias("last"))
            # A last line need not end in a line break.
            found = rows.agg(F.sum(F.col("lines") + F.col("last.open")).alias("rows")).first()["rows"] or 0
            out.append((*base, max(0, found - headers), max(0, found - headers), max(0, found - headers), "lines"))
            continue
        density = F.col("lines") / F.col("size")
        r = counted.where("size > 0").agg(
            (F.sum("lines") / F.sum("size")).alias("per_byte"), F.stddev_samp(density).alias("spread"), F.count(F.lit(1)).alias("n")
        ).first()
        rows, off = r["per_byte"] * k["bytes"] - headers, ERRORS * (r["spread"] or 0.0) * k["bytes"] / r["n"] ** 0.5
        out.append((*base, max(0, round(rows)), max(0, round(rows - off)), round(rows + off), "sample"))
    names = "table string, fmt string, files long, bytes long, rows long, low long, high long, method string"
    return spark.createDataFrame(out, names)


def _lines(data: bytes) -> tuple[int, int, int]:
    return data.count(b"\n"), len(data), int(bool(data) and not data.endswith(b"\n"))


def load_guard(estimates: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """The estimates if no table surely has over ``max_rows`` rows, else an error that names those that have."""
    over = [f"{r['table']} ({r['rows']})" for r in estimates.where(F.col("low") > max_rows).orderBy("table").collect()]
    if over:
        raise ValueError(f"tables with more than {max_rows} rows: {', '.join(over)}")
    return estimates
