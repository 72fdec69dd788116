"""Grouped and whole-table aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import hash_number, numeric_columns, quoted
from tributary.operators.quantiles import exact_quantiles
from tributary.operators.sequence import number_rows
from tributary.operators.skew import HOT_ROWS, lookup_join


def amount_aggregates(tx: DataFrame, user: str, amount: str) -> DataFrame:
    """Per user: count, sum, mean and sample deviation of an amount; undefined gives 0."""
    a = quoted(amount)
    zero = F.lit(0.0)
    return tx.where(quoted(user).isNotNull()).groupBy(quoted(user)).agg(
        F.count(F.lit(1)).alias("total_txns"),
        F.coalesce(F.sum(a), zero).alias("sum_amount"),
        F.coalesce(F.avg(a), zero).alias("avg_amount"),
        F.coalesce(F.stddev_samp(a), zero).alias("txn_std"),
    )


def count_where(df: DataFrame, group: str, condition: Column, name: str) -> DataFrame:
    """Rows per group that meet a condition; groups without such a row are absent."""
    return df.where(condition).groupBy(quoted(group)).agg(F.count(F.lit(1)).alias(name))


def group_size(df: DataFrame, group: str, name: str) -> DataFrame:
    return df.groupBy(quoted(group)).agg(F.count(F.lit(1)).alias(name))


def dedupe(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row per key in the given order.

    An aggregate rather than a window: copies are reduced before the shuffle, so
    one key may own any share of the rows.
    """
    whole = F.struct(*[quoted(c) for c in df.columns])
    rank = F.struct(*[quoted(c) for c in order_by])
    first = df.groupBy(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(whole, rank).alias("r")
    )
    return first.select("r.*")


def null_fractions(df: DataFrame) -> DataFrame:
    """``column, null_fraction`` in one pass."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.avg(quoted(c).isNull().cast("double")).alias("null_fraction"))
        for c in df.columns
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def constant_flags(df: DataFrame) -> DataFrame:
    """``column, is_constant``: no two different values, found without a distinct count."""
    cells = []
    for f in df.schema:
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            continue
        c = quoted(f.name)
        same = F.coalesce(F.min(c) == F.max(c), F.lit(True))
        cells.append(F.struct(F.lit(f.name).alias("column"), same.alias("is_constant")))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def variance_ranking(df: DataFrame) -> DataFrame:
    """``rank, column, variance`` by falling variance, then name.

    Booleans count as 0 and 1; columns without a variance rank as 0. The ranking
    sorts one row per column.
    """
    cells = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, T.NumericType):
            spread = F.var_samp(c.cast("double"))
        elif isinstance(f.dataType, T.BooleanType):
            spread = F.var_samp(c.cast("int").cast("double"))
        else:
            spread = F.lit(None).cast("double")
        cells.append(F.struct((-F.coalesce(spread, F.lit(0.0))).alias("minus"), F.lit(f.name).alias("column")))
    ranked = df.agg(F.array_sort(F.array(*cells)).alias("c"))
    return ranked.select(F.posexplode("c").alias("at", "c")).select(
        (F.col("at") + 1).alias("rank"),
        F.col("c.column").alias("column"),
        # 0 - x rather than -x: no negative zero.
        (F.lit(0.0) - F.col("c.minus")).alias("variance"),
    )


def attach_one(
    df: DataFrame,
    key: str,
    group: str,
    options: DataFrame,
    option: str,
    *,
    share: float = 0.7,
    seed: int = 42,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give about ``share`` of the rows one of their group's options, chosen by a hash of the key.

    No list per group is built: options are numbered over the whole table, a
    group is a range of numbers, and a row looks up one number in its range.
    """
    choices = options.select(quoted(group).alias("__g"), quoted(option).alias("__o")).distinct()
    choices = number_rows(choices.where("__g is not null and __o is not null"), ["__g", "__o"], "__at")
    ranges = choices.groupBy("__g").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    with_range = lookup_join(df, ranges, group, "__g", hot_rows=hot_rows)
    chosen = hash_number(seed, quoted(key)) < F.lit(int(share * (1 << 32)))
    pick = F.col("__first") + hash_number(seed, quoted(key), start=9) % F.col("__n")
    marked = with_range.withColumn("__pick", F.when(chosen, pick)).drop("__first", "__n")
    picked = choices.select("__at", F.col("__o").alias(option))
    return lookup_join(marked, picked, "__pick", "__at", hot_rows=hot_rows).drop("__pick")


def quantile_threshold(df: DataFrame, column: str, probability: float) -> float | None:
    return exact_quantiles(df, [column], [probability])[column][0]


BASELINE_PROBABILITIES = (0.25, 0.5, 0.75)


def baseline_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, probabilities: Sequence[float] = BASELINE_PROBABILITIES
) -> DataFrame:
    """``column, n, n_null, mean, std, minimum, maximum, q25, q50, q75`` of numeric columns."""
    names = list(columns) if columns is not None else numeric_columns(df)
    quantiles = exact_quantiles(df, names, probabilities)
    cells = []
    for c in names:
        v = quoted(c).cast("double")
        parts = [
            F.lit(c).alias("column"),
            F.count(v).alias("n"),
            F.count_if(v.isNull()).alias("n_null"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("minimum"),
            F.max(v).alias("maximum"),
        ]
        for p, q in zip(probabilities, quantiles[c]):
            parts.append(F.lit(q).cast("double").alias(f"q{round(p * 100):02d}"))
        cells.append(F.struct(*parts))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """``column, value, rows`` of the most frequent values, ties by value."""
    counted = df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    best = counted.orderBy(F.desc("rows"), "value").limit(n)
    return best.select(F.lit(column).alias("column"), F.col("value").cast("string").alias("value"), "rows")


def drift_bins(reference: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Inner bin borders per column: distinct quantiles of the reference rows."""
    inner = [i / bins for i in range(1, bins)]
    found = exact_quantiles(reference, columns, inner)
    return {c: sorted({q for q in found[c] if q is not None}) for c in columns}


def population_stability(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    *,
    bins: int = 10,
    borders: Mapping[str, Sequence[float]] | None = None,
    floor: float = 1e-4,
) -> DataFrame:
    """``column, psi``: how far the current distribution moved from the reference one.

    Shares per bin below ``floor`` count as ``floor``. A value equal to a border
    belongs to the bin below it; nulls form a bin of their own.
    """
    if borders is None:
        borders = drift_bins(reference, columns, bins)
    shares = []
    for side, df in (("a", reference), ("b", current)):
        cells = [
            F.struct(F.lit(c).alias("column"), _bin_of(quoted(c), borders[c]).alias("bin")) for c in columns
        ]
        counted = (
            df.select(F.explode(F.array(*cells)).alias("x"))
            .groupBy("x.column", "x.bin")
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        total = df.agg(F.count(F.lit(1)).alias("total"))
        shares.append(counted.crossJoin(F.broadcast(total)).select(
            "column", "bin", (F.col("rows") / F.col("total")).alias(side)
        ))
    both = shares[0].join(shares[1], ["column", "bin"], "full_outer")
    a = F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(floor))
    b = F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(floor))
    return both.groupBy("column").agg(F.sum((b - a) * F.ln(b / a)).alias("psi"))


def _bin_of(value: Column, borders: Sequence[float]) -> Column:
    index = F.lit(0)
    for border in borders:
        index = index + F.when(value > F.lit(border), 1).otherwise(0)
    return F.when(value.isNull(), F.lit(-1)).otherwise(index)
