"""Joins that build features: aggregated parents, dimension lookups, late labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import numeric_columns, quoted
from tributary.operators.profile import Relationship
from tributary.operators.sequence import number_rows
from tributary.operators.skew import HOT_ROWS, fits_broadcast, hot_keys, lookup_join
from tributary.sources.tables import union_rows

AGGREGATES = ("count", "sum", "mean")


def _joinable(a: T.DataType, b: T.DataType) -> bool:
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return True
    return a == b


def _taken(label: str, columns: Sequence[str], df: DataFrame) -> bool:
    return bool({f"{label}{c}_{a}" for c in columns for a in AGGREGATES} & set(df.columns))


def aggregate_join(
    anchor: DataFrame,
    tables: Mapping[str, DataFrame],
    relationships: Sequence[Relationship],
    *,
    prefix: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join count, sum and mean of every numeric parent column to the anchor.

    A relationship applies wherever the anchor has a column named ``child_col``.
    Names are ``column_count`` and so on; a relationship whose names are taken
    already is left out, so the first one wins. ``prefix=True`` names columns
    ``parent__column_count`` instead, and ``parent__child_col__column_count`` for a
    further relationship with the same parent, so all apply. All of this is
    settled from schemas before any join is planned.
    """
    hot: dict[str, list] = {}
    anchor_types = {f.name: f.dataType for f in anchor.schema}
    out = anchor
    for r in sorted(set(relationships)):
        parent = tables.get(r.parent)
        if parent is None or r.child not in tables:
            continue
        if r.parent_col not in parent.columns or r.child_col not in out.columns:
            continue
        columns = numeric_columns(parent)
        if not columns or not _joinable(parent.schema[r.parent_col].dataType, anchor_types[r.child_col]):
            continue
        label = f"{r.parent}__" if prefix else ""
        if _taken(label, columns, out) and prefix:
            label = f"{r.parent}__{r.child_col}__"
        if _taken(label, columns, out):
            continue
        parts: list[Column] = []
        for c in columns:
            v = quoted(c)
            parts += [
                F.count(v).alias(f"{label}{c}_count"),
                F.coalesce(F.sum(v), F.lit(0)).alias(f"{label}{c}_sum"),
                F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{label}{c}_mean"),
            ]
        grouped = (
            parent.where(quoted(r.parent_col).isNotNull()).groupBy(quoted(r.parent_col).alias("__parent_key")).agg(*parts)
        )
        if r.child_col not in hot and not fits_broadcast(grouped):
            # Looked for in the anchor itself, which is cheaper to read than the join so far.
            source = anchor if r.child_col in anchor.columns else out
            hot[r.child_col] = hot_keys(source.select(quoted(r.child_col)), r.child_col, hot_rows)
        out = lookup_join(out, grouped, r.child_col, "__parent_key", hot=hot.get(r.child_col, []))
        anchor_types = {f.name: f.dataType for f in out.schema}
    return out


def dimension_lookup(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    columns: Sequence[str],
    *,
    dimension_key: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join of some columns of a dimension with one row per key.

    Spark broadcasts the dimension if its measured size allows; otherwise rows of
    frequent keys are spread.
    """
    on = dimension_key or key
    wanted = dimension.select(quoted(on).alias("__dim_key"), *[quoted(c) for c in columns])
    return lookup_join(facts, wanted, key, "__dim_key", hot_rows=hot_rows)


def label_as_of(
    transactions: DataFrame,
    chargebacks: DataFrame,
    key: str,
    time: str,
    reported: str,
    as_of: Column,
    *,
    window_days: int = 90,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What was known about each transaction at ``as_of``.

    ``label`` is 1 if a chargeback was reported by then; ``mature`` is 0 while the
    reporting window is still open and the label may yet change.
    """
    known = (
        chargebacks.where(quoted(reported).cast("timestamp") <= as_of)
        .groupBy(quoted(key).alias("__charged"))
        .agg(F.min(quoted(reported).cast("timestamp")).alias("__first"))
    )
    joined = lookup_join(transactions.where(quoted(time) <= as_of), known, key, "__charged", hot_rows=hot_rows)
    open_until = F.unix_micros(quoted(time).cast("timestamp")) + F.lit(window_days * 86_400_000_000)
    return joined.withColumn("label", F.col("__first").isNotNull().cast("int")).withColumn(
        "mature", (open_until <= F.unix_micros(as_of)).cast("int")
    ).drop("__first")


def encode_categories(
    df: DataFrame, columns: Sequence[str], *, suffix: str = "_code", hot_rows: int = HOT_ROWS, learn_from: DataFrame | None = None
) -> DataFrame:
    """Add a code 0..k-1 per column, by the sorted order of its values; null stays null.

    With ``learn_from`` the values of those rows get codes, and others none.
    """
    cells = [
        F.struct(F.lit(i).alias("c"), quoted(c).cast("string").alias("v")) for i, c in enumerate(columns)
    ]
    known = df if learn_from is None else learn_from
    values = known.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("v is not null").distinct()
    numbered = number_rows(values, ["c", "v"], "rn")
    first = {r["c"]: r["first"] for r in numbered.groupBy("c").agg(F.min("rn").alias("first")).collect()}
    out = df
    for i, c in enumerate(columns):
        codes = numbered.where(F.col("c") == i).select(
            F.col("v").alias("__value"), (F.col("rn") - F.lit(first.get(i, 0))).alias(f"{c}{suffix}")
        )
        text_key = out if isinstance(df.schema[c].dataType, T.StringType) else None
        if text_key is None:
            out = out.withColumn("__text", quoted(c).cast("string"))
            out = lookup_join(out, codes, "__text", "__value", hot_rows=hot_rows).drop("__text")
        else:
            out = lookup_join(out, codes, c, "__value", hot_rows=hot_rows)
    return out


def dataset_report(tables: Mapping[str, DataFrame], labelled: str, label: str) -> DataFrame:
    """``metric, value``: rows per table and the label rate of one of them."""
    parts = [
        df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(f"n_{name}").alias("metric"), "value")
        for name, df in sorted(tables.items())
    ]
    rate = tables[labelled].agg(F.avg(quoted(label).cast("double")).alias("value"))
    return union_rows(*parts, rate.select(F.lit("label_rate").alias("metric"), "value"))
