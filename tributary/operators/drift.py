"""Statistics of runs that can be added up later, so that a reference window is never read again."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.columns import numeric_columns, quoted
from tributary.operators.quantiles import MERGE_GROUPS

#: Size parameter of the quantile sketches.
SKETCH = 4_096
#: Share of the rows by which a sketched rank is wrong at most, in 99 of 100 cases; a merged sketch keeps to it.
RANK_ERROR = 2.296 / SKETCH**0.9021
STATE = "column string, n long, n_null long, total double, squares double, minimum double, maximum double, sketch binary"


def _added(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of the same column added up, sums of squares about the common mean."""
    def add(s: Column, p: Column) -> Column:
        n = s["n"] + p["n"]
        apart = p["total"] / p["n"] - s["mean"]
        both = F.struct(
            n.alias("n"), (s["mean"] + apart * p["n"] / n).alias("mean"),
            (s["squares"] + p["squares"] + apart * apart * s["n"] * p["n"] / n).alias("squares"),
        )
        return F.when(p["n"] > 0, both).otherwise(s)

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    # At most as many parts as groups of tasks, or runs.
    squares = F.aggregate(F.collect_list(F.struct("n", "total", "squares")), none, add, lambda s: s["squares"])
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.sum("total").alias("total"), squares.alias("squares"),
        F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.expr(f"kll_merge_agg_double(sketch, {SKETCH}) AS sketch"),
    )


def column_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: counts, sums, extremes and a quantile sketch of its values; NaN counts as null.

    Each task gives one row per column; these meet in groups first, so no task merges all.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("v")) for c in names]
    stacked = df.select(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("slot"), F.inline(F.array(*cells)))
    v = F.when(~F.isnan("v"), F.col("v"))
    by_slot = stacked.withColumn("v", v).groupBy("slot", "column").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"),
        F.coalesce(F.var_pop("v") * F.count("v"), F.lit(0.0)).alias("squares"), F.min("v").alias("minimum"), F.max("v").alias("maximum"),
        F.expr(f"kll_sketch_agg_double(v, {SKETCH}) AS sketch"),
    )
    return _added(by_slot, ["column"])


def write_state(df: DataFrame, root: str, run: str, columns: Sequence[str] | None = None) -> None:
    """Keep the state of one run's rows under ``root``; a run that is written again replaces itself."""
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"{run!r} can't name a run")
    column_state(df, columns).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/run={run}")


def read_state(spark: SparkSession, root: str, runs: Sequence[str] | None = None) -> DataFrame:
    """The states of the named runs, or of all, as one. Only states are read, whatever the runs' sizes."""
    base = root.rstrip("/")
    try:
        if runs is None:
            states = spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(base)
        else:
            states = spark.read.schema(STATE).parquet(*[f"{base}/run={r}" for r in runs])
    except AnalysisException as e:
        raise ValueError(f"no states of {', '.join(runs) if runs else 'any run'} under {root}") from e
    return _added(states, ["column"])


def state_statistics(state: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``column, n, n_null, mean, std, minimum, maximum`` exactly, and quantiles within ``RANK_ERROR`` of their rank."""
    quantiles = [
        F.when(F.col("n") > 0, F.expr(f"kll_sketch_get_quantile_double(sketch, {p!r}D)")).alias(f"q{round(p * 100):02d}") for p in probabilities
    ]
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    return state.select("column", "n", "n_null", mean.alias("mean"), std.alias("std"), "minimum", "maximum", *quantiles)


def _shares(state: DataFrame, borders: dict[str, list[float]], floor: float) -> DataFrame:
    """``column, shares``: of all rows in the bins between borders, and last that of nulls."""
    n, missing = F.col("n"), F.col("n_null")
    every = F.nullif((n + missing).cast("double"), F.lit(0.0))
    # Ranks are only given at constants, so each column has a branch of its own.
    cases = []
    for c, edges in borders.items():
        inner = F.expr(f"kll_sketch_get_rank_double(sketch, array({', '.join(f'{e!r}D' for e in edges)}))") if edges else F.array().cast("array<double>")
        ends = F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))
        parts = [(F.get(ends, F.lit(i + 1)) - F.get(ends, F.lit(i))) * n for i in range(len(edges) + 1)]
        none = F.array(*[F.lit(0.0)] * (len(edges) + 1))
        cases.append(F.when(F.col("column") == c, F.concat(F.when(n > 0, F.array(*parts)).otherwise(none), F.array(missing.cast("double")))))
    shares = F.transform(F.coalesce(*cases), lambda x: F.greatest(F.coalesce(x / every, F.lit(0.0)), F.lit(floor)))
    return state.where(F.col("column").isin(*borders)).select("column", shares.alias("shares"))


def state_stability(reference: DataFrame, current: DataFrame, *, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """``column, psi`` of two states: how far the current values moved from the reference ones.

    Borders are the reference's quantiles, shares come from the sketches' ranks,
    so each is within ``RANK_ERROR`` of what counting the rows gives. A border
    belongs to the bin below it; nulls form a bin of their own; shares below
    ``floor`` count as ``floor``. Only columns that both states have are compared.
    """
    inner = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    quantiles = F.when(F.col("n") > 0, F.expr(f"kll_sketch_get_quantile_double(sketch, array({inner}))"))
    # A few numbers per column, whatever the number of rows.
    borders = {r["column"]: sorted(set(r["q"] or [])) for r in reference.select("column", quantiles.alias("q")).collect()}
    if not borders:
        return reference.sparkSession.createDataFrame([], "column string, psi double")
    before = _shares(reference, borders, floor).withColumnRenamed("shares", "a")
    both = before.join(_shares(current, borders, floor).withColumnRenamed("shares", "b"), "column")
    moved = F.zip_with("a", "b", lambda x, y: (y - x) * F.ln(y / x))
    return both.select("column", F.aggregate(moved, F.lit(0.0), lambda s, x: s + x).alias("psi"))
