"""Mixing sources to target weights by nested hash thresholds, without sorting rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import WORD_CLASS
from tributary.session import durable

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Size of the whole mix as a share of all sizes, and most copies of a source.
SHARE, MOST = 1.5, 2
#: Bits of the row hash that one histogram splits, and the bits of the hash.
LEVEL_BITS, HASH_BITS = 12, 60


def word_count(text: Column) -> Column:
    """Number of words; zero for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def row_hash(key: Column, seed: str) -> Column:
    """The first 60 bits of an MD5 digest, the same on every rerun; null keys share a hash."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` for ``sizes(source, source_size)``, one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. They split
    ``share`` of all sizes by weight; a target stops at ``most`` times its
    source, and the excess goes to the others by weight until none is above.
    With sources ordered by size per weight those that stop come first, so one
    running sum finds the level: no rounds. An empty source has target zero.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    weighed = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.lit(float(share)) * F.sum("source_size").over(whole)
    capped, open_weight = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    levelled = weighed.withColumn("level", (budget - capped) / open_weight)
    # The first source that its level doesn't fill sets the level of all after it.
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(level * F.col("w"), F.col("cap")))
    return levelled.withColumn("target", target).select("source", "source_size", "target")


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, cut``: rows with a hash below ``cut`` fill the source's ``budget`` as nearly as whole hashes can.

    ``rows(source, size, hash)``; sources are numbers here. The first histogram
    covers all rows by the top bits of the hash; then only the rows of the
    bucket on the boundary are split by the next bits, until a bucket is one hash.
    """
    state = budgets.withColumns({"low": F.lit(0).cast("long"), "room": F.col("budget")})
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = rows if level == 0 else rows.join(
            state.select("source", "low"), "source"
        ).where(F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS))
        bars = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("bar"))
        filled = F.sum("bar").over(Window.partitionBy("source").orderBy("bucket"))
        summed = bars.withColumn("filled", filled).join(state.select("source", "room"), "source")
        first = summed.where(F.col("filled") > F.col("room")).groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("filled") - F.col("bar")).alias("under"), F.col("bar"))).alias("m")
        )
        past = F.lit(1 << HASH_BITS)
        low = F.when(F.col("m").isNull(), past).otherwise(F.shiftleft(F.col("m.bucket"), shift))
        # A source whose rows all fit has its cut above all hashes, and no rows on later levels.
        state = state.join(first, "source", "left").select(
            "source", "budget",
            low.alias("low"),
            F.when(F.col("m").isNull(), F.col("room")).otherwise(F.col("room") - F.col("m.under")).alias("room"),
            F.col("m.bar").alias("bar"),
        )
        state = durable(state, "mix-cuts")
    # The hash on the boundary is taken if that brings the total nearer.
    nearer = F.col("bar").isNotNull() & (F.col("bar") - F.col("room") < F.col("room"))
    return state.select("source", (F.col("low") + nearer.cast("long")).alias("cut"))


def mix(
    df: DataFrame,
    *,
    source: str = "source",
    key: str = "doc_id",
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = "mix",
) -> DataFrame:
    """``df`` with ``size, source_size, target, copies``: how often the mix takes each row.

    A source with target t and size s takes every row ``floor(t / s)`` times,
    and once more the rows whose hash is under the source's threshold. Hashes
    come from the key, so a rerun takes the same rows and repeated rows go
    together. A null source is a source of its own, a null text has size zero;
    rows of size zero follow their hash. No row is taken over ``most`` times.
    Columns of these four names in ``df`` are replaced.
    """
    counted = size if size is not None else word_count(df["text"])
    narrow = df.select(df[source].alias("source"), counted.cast("long").alias("size"), row_hash(df[key], seed).alias("hash"))
    narrow = durable(narrow, "mix-sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("base", F.least(times, F.lit(most)).cast("long"))
    targets = targets.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    # Sources are numbered so that joins on them need no null-safe comparison.
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))).cast("long")
    targets = durable(targets.withColumn("no", number), "mix-targets")
    named = F.col("source").eqNullSafe(F.col("its_source"))
    small = targets.select(F.col("source").alias("its_source"), "no")
    rows = narrow.join(small, named).select(F.col("no").alias("source"), "size", "hash")
    cuts = _thresholds(rows, targets.select(F.col("no").alias("source"), "budget"))
    plan = targets.join(cuts.withColumnRenamed("source", "no"), "no").select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), F.col("base").alias("__base"), F.col("cut").alias("__cut"),
    )
    plan = durable(plan, "mix-plan")
    kept = [c for c in df.columns if c not in {"size", "source_size", "target", "copies"}]
    joined = df.withColumns({"__size": counted.cast("long"), "__hash": row_hash(df[key], seed)}).join(
        plan, F.col(source).eqNullSafe(F.col("__source")), "left"
    )
    copies = F.least(F.col("__base") + (F.col("__hash") < F.col("__cut")).cast("long"), F.lit(most).cast("long"))
    return joined.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), copies.alias("copies"),
    )
