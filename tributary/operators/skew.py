"""Joins and windows that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import quoted
from tributary.session import durable

# A key with fewer rows than this never needs special care.
HOT_ROWS = 2_000_000
# A list of keys up to this length is held as literals.
MAX_HOT_KEYS = 1_000
SALTS = 64


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list:
    """Values of ``key`` with more than ``hot_rows`` rows and over 1/1000 of the table.

    The share bounds the list to ``MAX_HOT_KEYS`` values. Counting is combined on
    the map side, and left out where the whole table is below ``hot_rows``.
    """
    rows = df.count()
    if rows <= hot_rows:
        return []
    floor = max(hot_rows, rows // MAX_HOT_KEYS)
    counted = df.where(quoted(key).isNotNull()).groupBy(quoted(key).alias("key")).count()
    return [r["key"] for r in counted.where(F.col("count") > floor).select("key").collect()]


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate lets it broadcast ``df`` under the session's threshold."""
    allowed = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= allowed


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    *,
    hot_rows: int = HOT_ROWS,
    hot: list | None = None,
) -> DataFrame:
    """Left join to a table with one row per ``right_key``; that column is not kept.

    If the right side is small enough for Spark to broadcast, rows stay where they
    are. Otherwise rows of a hot key are spread over ``SALTS`` slots, and only the
    matching row of that key is repeated per slot: at most
    ``MAX_HOT_KEYS * SALTS`` extra rows. ``hot`` passes keys that are known already.
    """
    if hot is None:
        hot = [] if fits_broadcast(right) else hot_keys(left.select(quoted(left_key)), left_key, hot_rows)
    looked_up = right.withColumnRenamed(right_key, "__key")
    on = quoted(left_key) == F.col("__key")
    if not hot:
        return left.join(looked_up, on, "left").drop("__key")
    is_hot = F.coalesce(quoted(left_key).isin(hot), F.lit(True))
    spread = F.pmod(F.xxhash64(*[quoted(c) for c in left.columns]), F.lit(SALTS)).cast("int")
    salted = left.withColumn("__salt", F.when(is_hot, spread).otherwise(0))
    slots = F.when(F.col("__key").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = looked_up.withColumn("__slot", F.explode(slots))
    joined = salted.join(repeated, on & (F.col("__salt") == F.col("__slot")), "left")
    return joined.drop("__key", "__salt", "__slot")


def by_group_size(
    df: DataFrame,
    group: Sequence[str],
    usual: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Apply ``usual`` to groups that fit one task and ``large`` to all others."""
    if df.count() <= hot_rows:
        return usual(df)
    sizes = df.groupBy(*[quoted(g) for g in group]).count().where(F.col("count") > hot_rows).drop("count")
    big = durable(sizes, "large-groups")
    if big.isEmpty():
        return usual(df)
    # A table of n rows has fewer than n / hot_rows such groups, so the list is small.
    listed = F.broadcast(big).alias("b")
    match = [F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`")) for g in group]
    tagged = df.alias("a")
    return usual(tagged.join(listed, match, "left_anti")).unionByName(large(tagged.join(listed, match, "left_semi")))
