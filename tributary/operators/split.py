"""Train and test rows by time, hash, stratum or group.

No split sorts or collects the table: each finds a cut value by counting and then
labels every row with one comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import hash_fraction, hash_number, micros, quoted
from tributary.operators.quantiles import kth_values
from tributary.operators.skew import HOT_ROWS, hot_keys, lookup_join
from tributary.session import durable

TRAIN, TEST = "train", "test"


def _label(is_train: Column) -> Column:
    return F.when(is_train, TRAIN).otherwise(TEST)


def _wide_hash(seed: int, key: Column) -> Column:
    """60-bit number from ``md5("seed:key")``: practically free of ties."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def split_time(df: DataFrame, time: str, key: str, train_size: float = 0.8, *, name: str = "split") -> DataFrame:
    """The first ``int(n * train_size)`` rows by time train, the rest test.

    Rows at the cut time go by ``key`` (numbers by value, text by hash); rows
    without a time come last.
    """
    is_number = isinstance(df.schema[key].dataType, T.NumericType)
    order_key = quoted(key) if is_number else _wide_hash(0, quoted(key))
    when = micros(quoted(time)) if _is_time(df, time) else quoted(time)
    view = df.select(when.alias("t"), order_key.alias("k"))
    totals = view.agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("timed")).first()
    cut = int(totals["n"] * train_size)
    if cut == 0:
        return df.withColumn(name, F.lit(TEST))
    if cut <= totals["timed"]:
        (at,) = kth_values(view, [("t", cut - 1)], {"t": totals["timed"]})
        spread = view.agg(
            F.count_if(F.col("t") < F.lit(at)).alias("before"), F.count_if(F.col("t") == F.lit(at)).alias("same")
        ).first()
        needed, tied = cut - spread["before"], spread["same"]
        before, same = F.coalesce(when < F.lit(at), F.lit(False)), F.coalesce(when == F.lit(at), F.lit(False))
        at_cut = view.where(F.col("t") == F.lit(at))
    else:
        needed, tied = cut - totals["timed"], totals["n"] - totals["timed"]
        before, same = when.isNotNull(), when.isNull()
        at_cut = view.where(F.col("t").isNull())
    if needed >= tied:
        return df.withColumn(name, _label(before | same))
    (last,) = kth_values(at_cut, [("k", needed - 1)])
    return df.withColumn(name, _label(before | (same & (order_key <= F.lit(last)))))


def _is_time(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def split_random(
    df: DataFrame, key: str, train_size: float = 0.8, seed: int = 42, *, exact: bool = False, name: str = "split"
) -> DataFrame:
    """By a hash of the key, so the choice survives repartitioning and new rows.

    ``exact=True`` trains exactly ``int(n * train_size)`` rows, those of smallest hash.
    """
    if not exact:
        return df.withColumn(name, _label(hash_fraction(seed, quoted(key)) < F.lit(train_size)))
    h = _wide_hash(seed, quoted(key))
    view = df.select(h.alias("h"))
    rows = df.count()
    cut = int(rows * train_size)
    if cut == 0:
        return df.withColumn(name, F.lit(TEST))
    (last,) = kth_values(view, [("h", cut - 1)], {"h": rows})
    return df.withColumn(name, _label(h <= F.lit(last)))


def split_stratified(
    df: DataFrame,
    key: str,
    stratum: str,
    train_size: float = 0.8,
    seed: int = 42,
    *,
    exact: bool = True,
    name: str = "split",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exactly ``int(n * train_size)`` rows of every stratum train, those of smallest hash.

    A stratum may hold most of the table, so it is not sorted: rows are counted in
    65,536 hash bins, then in 65,536 bins of the bin that holds the cut, and only
    what is left there (about n / 2^32 rows) is ranked. Null is a stratum too.
    """
    if not exact:
        return split_random(df, key, train_size, seed, name=name)
    h = _wide_hash(seed, quoted(key))
    label = F.coalesce(quoted(stratum).cast("string"), F.lit("\x00"))
    rows = df.select(label.alias("s"), h.alias("h"))
    # Every join below is on the stratum, so its large values are looked for once.
    hot = hot_keys(df.select(label.alias("s")), "s", hot_rows)
    first_bin, second_bin = F.shiftright("h", 44), F.shiftright("h", 28).bitwiseAND(F.lit(0xFFFF))

    counted = rows.groupBy("s", first_bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("s").agg(F.floor(F.sum("n") * F.lit(train_size)).alias("want"))
    cut1 = durable(_cut_bin(counted, sizes, "bin1"), "strata")
    inside = _in_bin(rows, cut1, first_bin, "bin1", hot)
    counted2 = inside.groupBy("s", second_bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    cut2 = durable(_cut_bin(counted2, cut1.select("s", "want"), "bin2"), "strata")
    last_few = _in_bin(inside, cut2, second_bin, "bin2", hot)
    ranked = last_few.withColumn("at", F.row_number().over(Window.partitionBy("s").orderBy("h")))
    borders = (
        lookup_join(ranked, cut2.select(F.col("s").alias("__s"), "want"), "s", "__s", hot=hot)
        .where(F.col("at") == F.col("want"))
        .select(F.col("s").alias("__s"), F.col("h").alias("__last"))
    )
    joined = lookup_join(df.withColumn("__stratum", label), borders, "__stratum", "__s", hot=hot)
    return joined.withColumn(name, _label(F.coalesce(h <= F.col("__last"), F.lit(False)))).drop("__stratum", "__last")


def _cut_bin(counted: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Per stratum the bin that holds the wanted-th row, and how many rows of it are wanted.

    A stratum has at most 65,536 bins, whatever its number of rows.
    """
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return (
        counted.withColumn("upto", upto)
        .join(wanted, "s")
        .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
        .select("s", F.col("bin").alias(name), (F.col("want") - F.col("upto") + F.col("n")).alias("want"))
    )


def _in_bin(rows: DataFrame, cut: DataFrame, bin_of: Column, name: str, hot: list) -> DataFrame:
    tagged = lookup_join(rows, cut.select(F.col("s").alias("__s"), name), "s", "__s", hot=hot)
    return tagged.where(bin_of == F.col(name)).select("s", "h")


def split_group(
    df: DataFrame, group: str, train_size: float = 0.8, seed: int = 42, *, name: str = "split"
) -> DataFrame:
    """Whole groups to one side, by a hash of the group key."""
    return df.withColumn(name, _label(hash_fraction(seed, quoted(group)) < F.lit(train_size)))


def assign_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42, *, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 by a hash of the key; below 2 folds everything is fold 0."""
    if folds < 2:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    return df.withColumn(name, hash_number(seed, quoted(key)) % folds)


def split_auto(
    df: DataFrame,
    key: str,
    train_size: float = 0.8,
    seed: int = 42,
    *,
    time: str | None = None,
    stratum: str | None = None,
    group: str | None = None,
    strategy: str = "auto",
    name: str = "split",
) -> DataFrame:
    """The named strategy, or for ``auto`` time if given, else strata, else random."""
    if strategy == "auto":
        strategy = "time" if time else "stratified" if stratum else "random"
    needs = {"time": time, "stratified": stratum, "group": group, "random": key}
    if strategy not in needs:
        raise ValueError(f"unknown split strategy {strategy}")
    if not needs[strategy]:
        raise ValueError(f"the {strategy} split needs a column")
    if strategy == "time":
        return split_time(df, time, key, train_size, name=name)
    if strategy == "stratified":
        return split_stratified(df, key, stratum, train_size, seed, name=name)
    if strategy == "group":
        return split_group(df, group, train_size, seed, name=name)
    return split_random(df, key, train_size, seed, name=name)


def train_test(df: DataFrame, name: str = "split") -> tuple[DataFrame, DataFrame]:
    return df.where(quoted(name) == TRAIN).drop(name), df.where(quoted(name) == TEST).drop(name)


SPLIT_STRATEGIES: Sequence[str] = ("auto", "random", "stratified", "group", "time")
