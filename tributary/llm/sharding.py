"""Two-pass external shuffle of whole records into shards of equal row counts."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.session import durable

#: Bytes of records that one bucket holds; a bucket is permuted in memory.
BUCKET_BYTES = 16 << 20
SHARDS = 16
SEED = 20_261_201


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (none for null) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def external_shuffle(
    df: DataFrame, *, size: Column, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The records of ``df`` with ``shard, slot``: a random order cut into ``shards`` runs, sizes at most one apart.

    First pass: a seeded hash of the row's place in the input scatters records
    over buckets of about ``bucket_bytes``; keys and texts play no part, so
    equal rows spread too. Second pass: each bucket is permuted in memory
    (Fisher-Yates) and written to the shared folder, which fixes the order
    whatever is lost later. Row counts of the buckets then give every record
    its place. Null values travel like others; a table without rows gives none.
    Columns of ``df`` named ``shard`` or ``slot`` are replaced.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, ceil(total / bucket_bytes))
    kept = [c for c in df.columns if c not in {"shard", "slot"}]
    row = F.monotonically_increasing_id()
    record = F.struct(F.col("__row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    scattered = (
        df.withColumn("__row", row)
        .select(F.pmod(F.xxhash64(F.lit(seed), "__row"), F.lit(buckets)).alias("bucket"), record.alias("record"))
        .repartition(buckets, "bucket")
    )
    # Sorted first: a shuffled block may arrive in any order.
    gathered = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
    dealt = gathered.select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("pos", "record"))
    dealt = durable(dealt.select("bucket", "pos", "record.*").drop("__row"), "shuffled")
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("rows")
    )
    placed = dealt.join(durable(starts, "shuffled-starts"), "bucket").withColumn("place", F.col("start") + F.col("pos"))
    placed = placed.withColumn("shard_no", F.expr(f"place * {shards} div rows"))
    slot = F.expr(f"place - (shard_no * rows + {shards - 1}) div {shards}")
    values = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept)]
    return placed.select(*values, F.col("shard_no").cast("int").alias("shard"), slot.cast("long").alias("slot"))
