"""Row order at scale: contiguous numbers, lags, rolling means, running sums.

``Window.orderBy`` without a partition would send the table to one task. Here the
rows are range-partitioned, so every task sorts one slice, and slices are stitched
by their sizes (one number per slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.columns import numeric_columns, quoted
from tributary.operators.skew import HOT_ROWS, by_group_size
from tributary.session import durable

BUCKET_ROWS = 100_000
_SLICE_BITS = 33  # monotonically_increasing_id keeps the slice number above these


def _sliced(df: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    """Sorted slices, written once: ``__slice`` and position ``__pos`` inside it."""
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    fixed = durable(ordered.withColumn("__mid", F.monotonically_increasing_id()), "sorted")
    return fixed.select(
        *[quoted(c) for c in df.columns],
        F.shiftright("__mid", _SLICE_BITS).cast("int").alias("__slice"),
        F.col("__mid").bitwiseAND(F.lit((1 << _SLICE_BITS) - 1)).alias("__pos"),
    )


def _slice_starts(sliced: DataFrame, amount: Column) -> DataFrame:
    """Total of ``amount`` in all earlier slices; one row per slice, so small."""
    totals = sliced.groupBy("__slice").agg(amount.alias("__total")).orderBy("__slice").collect()
    starts, upto = [], 0
    for r in totals:
        starts.append((r["__slice"], upto))
        upto += r["__total"] or 0
    return sliced.sparkSession.createDataFrame(starts, "__slice int, __start bigint")


def _order(order_by: Sequence[str | Column]) -> list[Column]:
    return [quoted(c).asc_nulls_last() if isinstance(c, str) else c for c in order_by]


def number_rows(df: DataFrame, order_by: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Add contiguous numbers 0..n-1 in the given order, which should be unique."""
    sliced = _sliced(df, _order(order_by))
    starts = _slice_starts(sliced, F.max("__pos") + 1)
    return sliced.join(F.broadcast(starts), "__slice").select(
        *[quoted(c) for c in df.columns], (F.col("__start") + F.col("__pos")).alias(name)
    )


def running_sum(df: DataFrame, order_by: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """Sum of an integer column over all rows up to and including this one."""
    sliced = _sliced(df, _order(order_by))
    starts = _slice_starts(sliced, F.sum(quoted(value)))
    within = Window.partitionBy("__slice").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("__sum", F.sum(quoted(value)).over(within))
        .join(F.broadcast(starts), "__slice")
        .select(*[quoted(c) for c in df.columns], (F.col("__start") + F.col("__sum")).alias(name))
    )


def ensure_row_id(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Keep an ``id`` column; otherwise add ``generated_index`` 0..n-1."""
    return df if "id" in df.columns else number_rows(df, order_by, "generated_index")


def _over_neighbours(
    df: DataFrame, order_by: Sequence[str], group: Sequence[str], before: int, after: int, bucket_rows: int, steps
) -> DataFrame:
    """Run window ``steps`` over the ordered table in buckets of bounded size.

    Each bucket also gets the ``before`` rows ahead of it and the ``after`` rows
    behind it, which are dropped again once the steps are done.
    """
    size = max(bucket_rows, before, after, 1)
    numbered = number_rows(df, [*group, *order_by], "__rn")
    home = F.floor(F.col("__rn") / size).cast("bigint")
    place = F.col("__rn") % size
    copies = [F.struct(home.alias("b"), F.lit(True).alias("own"))]
    if before:
        copies.append(F.when(place >= size - before, F.struct((home + 1).alias("b"), F.lit(False).alias("own"))))
    if after:
        copies.append(F.when(place < after, F.struct((home - 1).alias("b"), F.lit(False).alias("own"))))
    spread = (
        numbered.withColumn("__copy", F.explode(F.array_compact(F.array(*copies))))
        .withColumn("__bucket", F.col("__copy.b"))
        .withColumn("__own", F.col("__copy.own"))
        .drop("__copy")
    )
    window = Window.partitionBy("__bucket", *[quoted(g) for g in group]).orderBy("__rn")
    return steps(spread, window).where("__own").drop("__rn", "__bucket", "__own")


def _ordered_steps(df, order_by, group, before, after, bucket_rows, hot_rows, steps) -> DataFrame:
    """Plain windows for groups that fit a task, buckets for the rest."""

    def bucketed(rows: DataFrame) -> DataFrame:
        return _over_neighbours(rows, order_by, group, before, after, bucket_rows, steps)

    if not group:
        return bucketed(df)
    window = Window.partitionBy(*[quoted(g) for g in group]).orderBy(*_order(order_by))
    return by_group_size(df, group, lambda rows: steps(rows, window), bucketed, hot_rows)


def lag_and_rolling(
    df: DataFrame,
    time: str,
    key: str,
    *,
    periods: Sequence[int] = (),
    windows: Sequence[int] = (),
    columns: Sequence[str] | None = None,
    group: Sequence[str] = (),
    compound: bool = True,
    bucket_rows: int = BUCKET_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``c_lag_p`` and then ``c_roll_mean_w`` for numeric columns in time order.

    With ``compound`` each further period also lags the lag columns made before
    it, and each window also averages all columns made before it, so the number
    of columns doubles per period and window.
    """
    base = list(columns) if columns is not None else numeric_columns(df, skip=[key, time, *group])
    reach = [*periods, *[w - 1 for w in windows]]
    before = (sum(reach) if compound else max(reach, default=0)) if reach else 0

    def steps(rows: DataFrame, window) -> DataFrame:
        current = list(base)
        for p in periods:
            sources = current if compound else base
            rows = rows.select("*", *[F.lag(quoted(c), p).over(window).alias(f"{c}_lag_{p}") for c in sources])
            current = current + [f"{c}_lag_{p}" for c in sources]
        for w in windows:
            sources = current if compound else base
            frame = window.rowsBetween(-(w - 1), 0)
            rows = rows.select("*", *[F.avg(quoted(c)).over(frame).alias(f"{c}_roll_mean_{w}") for c in sources])
            current = current + [f"{c}_roll_mean_{w}" for c in sources]
        return rows

    return _ordered_steps(df, [time, key], list(group), before, 0, bucket_rows, hot_rows, steps)


def lag_features(df: DataFrame, time: str, key: str, periods: Sequence[int], **options) -> DataFrame:
    return lag_and_rolling(df, time, key, periods=periods, **options)


def rolling_mean(df: DataFrame, time: str, key: str, windows: Sequence[int], **options) -> DataFrame:
    return lag_and_rolling(df, time, key, windows=windows, **options)


def forecast_target(
    df: DataFrame,
    value: str,
    horizon: int,
    time: str,
    key: str,
    *,
    group: Sequence[str] = (),
    name: str = "target",
    bucket_rows: int = BUCKET_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The value ``horizon`` rows later, null at the end of the series."""

    def steps(rows: DataFrame, window) -> DataFrame:
        return rows.select("*", F.lead(quoted(value), horizon).over(window).alias(name))

    return _ordered_steps(df, [time, key], list(group), 0, horizon, bucket_rows, hot_rows, steps)


def running_position(
    df: DataFrame, group: str, order_by: Sequence[str], *, name: str = "position", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """0-based position of each row within its group."""

    def usual(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(quoted(group)).orderBy(*_order(order_by))
        return rows.withColumn(name, F.row_number().over(window).cast("bigint") - 1)

    def large(rows: DataFrame) -> DataFrame:
        numbered = durable(number_rows(rows, [group, *order_by], "__rn"), "positions")
        first = numbered.groupBy(quoted(group).alias("__g")).agg(F.min("__rn").alias("__first"))
        # One row per large group: fewer than rows / hot_rows.
        joined = numbered.join(F.broadcast(first), quoted(group).eqNullSafe(F.col("__g")))
        return joined.withColumn(name, F.col("__rn") - F.col("__first")).drop("__rn", "__g", "__first")

    return by_group_size(df, [group], usual, large, hot_rows)


def counts_in_range(
    df: DataFrame,
    group: str,
    time_micros: str,
    key: str,
    low: int,
    high: int,
    *,
    counted: Column | None = None,
    name: str = "n_in_range",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For each row, how many ``counted`` rows of its group lie in time + [low, high].

    Null and repeated values of ``key`` are rows like others. Groups beyond ``hot_rows`` are counted by differences
    of one running sum over rows and range borders, which no single task holds.
    """
    flag = (counted if counted is not None else F.lit(True)).cast("int")
    rows_in = df.withColumn("__flag", F.coalesce(flag, F.lit(0)))

    def usual(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(quoted(group)).orderBy(quoted(time_micros)).rangeBetween(low, high)
        return rows.withColumn(name, F.coalesce(F.sum("__flag").over(window), F.lit(0))).drop("__flag")

    def large(rows: DataFrame) -> DataFrame:
        # Numbered once, so that null or repeated keys keep their rows.
        rows = durable(rows.withColumn("__row", F.monotonically_increasing_id()), "ranges")
        g, t, k = quoted(group).alias("g"), quoted(time_micros), F.col("__row").alias("k")
        data = rows.where("__flag = 1").select(
            g, t.alias("t"), F.lit(1).alias("kind"), k, F.lit(1).cast("bigint").alias("one")
        )
        nothing = F.lit(0).cast("bigint").alias("one")
        opens = rows.select(g, (t + low).alias("t"), F.lit(0).alias("kind"), k, nothing)
        closes = rows.select(g, (t + high).alias("t"), F.lit(2).alias("kind"), k, nothing)
        marks = running_sum(data.unionByName(opens).unionByName(closes), ["g", "t", "kind", "k"], "one", "upto")
        signed = F.when(F.col("kind") == 2, F.col("upto")).otherwise(-F.col("upto"))
        tallies = marks.where("kind <> 1").groupBy(F.col("k").alias("__row")).agg(F.sum(signed).alias(name))
        return rows.drop("__flag").join(tallies, "__row").drop("__row")

    return by_group_size(rows_in, [group], usual, large, hot_rows)
