"""What a folder of tables looks like: keys, time columns, relationships, schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import is_numeric, parse_ts, quoted
from tributary.session import durable
from tributary.sources.tables import union_rows

KEY_RATIO = 0.98
KEY_MIN_ROWS = 10
BITS = 62  # columns per word in a set of columns
TIME_RATIO = 0.9
OVERLAP_RATIO = 0.9
OVERLAP_MIN_VALUES = 5
# Columns of a table that one row is stacked into at once.
STACKED = 16


@dataclass(frozen=True, order=True)
class Relationship:
    """``child.child_col`` holds values of the key ``parent.parent_col``."""

    parent: str
    parent_col: str
    child: str
    child_col: str


def _comparable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def candidate_keys(df: DataFrame) -> DataFrame:
    """``column, non_null, n_distinct`` of columns that are unique in over 98% of their values."""
    return candidate_keys_of({"": df}).drop("table")


@dataclass(frozen=True)
class Attribute:
    """One column of one table that is compared with others."""

    table: str
    column: str
    kind: str


@dataclass
class ColumnSets:
    """Which columns hold which values: for every set of columns, how many distinct values exactly these hold.

    ``sets`` has the set as words of bits, ``w0, w1, ...``, and ``n``; ``non_null``
    counts the rows of each attribute.
    """

    attributes: list[Attribute]
    sets: DataFrame
    non_null: list[int]

    def patterns(self) -> DataFrame:
        """``holders, n``: the numbers of the attributes of each set."""
        members = [
            F.when(F.col(f"w{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS)).cast("bigint")) != 0, F.lit(i))
            for i in range(len(self.attributes))
        ]
        return self.sets.select(F.array_compact(F.array(*members)).alias("holders"), "n")

    def sizes(self) -> DataFrame:
        """``attribute, size``: distinct values of each attribute."""
        return self.patterns().select(F.explode("holders").alias("attribute"), "n").groupBy("attribute").agg(F.sum("n").alias("size"))


def column_sets(tables: Mapping[str, DataFrame], attributes: Sequence[Attribute] | None = None) -> ColumnSets:
    """The values of all columns of all tables, met in one shuffle.

    Each table is stacked: a row gives one short row per column with two 64-bit
    hashes of the value, so long text does not travel and equal values of
    different types meet. What gathers at a value is the set of columns that
    hold it, built up before the shuffle. Keys and relationships both follow
    from the counts of these sets, and nothing is estimated.
    """
    if attributes is None:
        attributes = [
            Attribute(t, f.name, _value_class(f.dataType) or "other")
            for t, df in sorted(tables.items()) for f in df.schema if _comparable(f.dataType)
        ]
    attributes = list(attributes)
    spark = next(iter(tables.values())).sparkSession
    words = len(attributes) // BITS + 1
    named = [f"w{w}" for w in range(words)]
    if not attributes:
        return ColumnSets([], spark.createDataFrame([], f"{', '.join(f'{w} bigint' for w in named)}, n bigint"), [])
    counts, stacked = [], []
    for t, df in sorted(tables.items()):
        own = [(i, a) for i, a in enumerate(attributes) if a.table == t]
        for start in range(0, len(own), STACKED):
            cells, known = [], []
            for i, a in own[start : start + STACKED]:
                value = quoted(a.column)
                one, two = _hashes(value, df.schema[a.column].dataType)
                cells.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("i"), one.alias("one"), two.alias("two"))))
                known.append(F.struct(F.lit(i).alias("i"), F.count(value).alias("rows")))
            stacked.append(df.select(F.inline(F.array(*cells))).where("i IS NOT NULL"))
            counts.append(df.agg(F.array(*known).alias("x")).select(F.inline("x")))
    non_null = {r["i"]: r["rows"] for r in union_rows(*counts).collect()}
    holders = [F.coalesce(F.bit_or(F.when(F.floor(F.col("i") / BITS) == w, F.expr(f"shiftleft(1L, i % {BITS})"))), F.lit(0)).alias(n) for w, n in enumerate(named)]
    values = union_rows(*stacked).groupBy("one", "two").agg(*holders)
    # Sets repeat a lot; counting equal sets leaves few rows to pair up.
    sets = durable(values.groupBy(*named).agg(F.count(F.lit(1)).alias("n")), "column-sets")
    return ColumnSets(attributes, sets, [non_null[i] for i in range(len(attributes))])


def candidate_keys_of(tables: Mapping[str, DataFrame], sets: ColumnSets | None = None) -> DataFrame:
    """The same for several tables, with the table's name; ``sets`` are those of the tables if known already."""
    spark = next(iter(tables.values())).sparkSession
    found = sets or column_sets(tables)
    sizes = {r["attribute"]: r["size"] for r in found.sizes().collect()}
    # In the order of the columns, as the first key of a table is its main one.
    listed = [(a.table, a.column, n, sizes.get(i, 0)) for i, (a, n) in enumerate(zip(found.attributes, found.non_null))]
    rows = [r for r in listed if r[2] > KEY_MIN_ROWS and r[3] / r[2] > KEY_RATIO]
    return spark.createDataFrame(rows, "table string, column string, non_null bigint, n_distinct bigint")


def time_scores_of(tables: Mapping[str, DataFrame], *, numeric_as_time: bool = False) -> DataFrame:
    """``table, position, column, score``: share of non-null values that read as a time.

    Only columns that may hold times are read and listed. They are stacked, so
    that the parsing is compiled once and aggregated in one step.
    """
    parts = []
    for t, df in sorted(tables.items()):
        for i, field in enumerate(df.schema):
            c = quoted(field.name)
            declared = isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) or (
                numeric_as_time and is_numeric(field.dataType)
            )
            if declared or isinstance(field.dataType, T.StringType):
                text = F.lit(None).cast("string") if declared else c
                parts.append(df.where(c.isNotNull()).select(
                    F.lit(t).alias("table"), F.lit(i).alias("position"), F.lit(field.name).alias("column"),
                    F.lit(declared).alias("declared"), text.alias("text"),
                ))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, position int, column string, score double")
    good = (F.col("declared") | parse_ts(F.col("text")).isNotNull()).cast("double")
    return union_rows(*parts).groupBy("table", "position", "column").agg(F.avg(good).alias("score"))


def time_columns(tables: Mapping[str, DataFrame], **options) -> DataFrame:
    """``table, time_column``: per table the first column in which over 90% of the values read as a time."""
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(t,) for t in sorted(tables)], "table string")
    good = time_scores_of(tables, **options).where(F.col("score") > TIME_RATIO)
    first = good.groupBy("table").agg(F.min_by("column", "position").alias("time_column"))
    return names.join(first, "table", "left")


def time_column(df: DataFrame, **options) -> str | None:
    """The same for one table; null where no column is good enough."""
    return time_columns({"": df}, **options).first()["time_column"]


def _value_class(data_type: T.DataType) -> str | None:
    """Values are only compared inside a class: numbers and booleans, text, times."""
    if isinstance(data_type, (T.BooleanType, T.NumericType)):
        return "number"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return None


def _hashes(value: Column, data_type: T.DataType) -> tuple[Column, Column]:
    """Two 64-bit hashes that are equal for equal values: 1, 1.0 and true meet, text never meets numbers."""
    kind = _value_class(data_type)

    def both(tag: int, c: Column) -> tuple[Column, Column]:
        return F.xxhash64(F.lit(tag), c), F.xxhash64(F.lit(-tag), c)

    if kind == "time":
        return both(1, F.unix_micros(value.cast("timestamp")))
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        number = value.cast("double")
        is_whole = (number == F.floor(number)) & (F.abs(number) < F.lit(9.0e18))
        whole, fraction = both(2, F.when(is_whole, number).cast("bigint")), both(3, number)
        return tuple(F.when(is_whole, w).otherwise(f) for w, f in zip(whole, fraction))
    if kind == "number":
        return both(2, value.cast("bigint"))
    return both(4, value.cast("string"))


def relationships(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    *,
    same_suffix: bool = False,
    sets: ColumnSets | None = None,
) -> DataFrame:
    """``parent, parent_col, child, child_col, overlap`` for every likely foreign key.

    A key and a column belong together if at least 90% of the column's values, and
    more than five, occur in the key. Values meet once (``column_sets``): no
    group is larger than the number of columns, and no two columns are joined
    with each other. ``same_suffix`` also asks for equal names after the first
    underscore. ``sets`` are those of the tables if known already.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = "parent string, parent_col string, child string, child_col string, overlap double"
    if sets is None:
        listed = [
            Attribute(t, f.name, _value_class(f.dataType)) for t, df in sorted(tables.items()) for f in df.schema if _value_class(f.dataType)
        ]
        kinds = {a.kind for a in listed if a.column in set(keys.get(a.table, ()))}
        sets = column_sets(tables, [a for a in listed if a.kind in kinds])
    numbered = list(enumerate(sets.attributes))
    own_keys = [i for i, a in numbered if a.column in set(keys.get(a.table, ()))]
    if not own_keys:
        return spark.createDataFrame([], schema)
    patterns = sets.patterns()
    key_ids = F.array(*[F.lit(i) for i in own_keys])
    table_of = F.create_map(*[x for i, a in numbered for x in (F.lit(i), F.lit(a.table))])
    column_of = F.create_map(*[x for i, a in numbered for x in (F.lit(i), F.lit(a.column))])
    pairs = (
        patterns.select(F.explode(F.array_intersect("holders", key_ids)).alias("p"), "holders", "n")
        .select("p", F.explode("holders").alias("attribute"), "n")
        .where(table_of[F.col("p")] != table_of[F.col("attribute")])
        .groupBy("p", "attribute")
        .agg(F.sum("n").alias("common"))
        .where(F.col("common") > OVERLAP_MIN_VALUES)
    )
    found = (
        pairs.join(sets.sizes(), "attribute")
        .withColumn("overlap", F.col("common") / F.col("size"))
        .where(F.col("overlap") >= OVERLAP_RATIO)
        .select(
            table_of[F.col("p")].alias("parent"),
            column_of[F.col("p")].alias("parent_col"),
            table_of[F.col("attribute")].alias("child"),
            column_of[F.col("attribute")].alias("child_col"),
            "overlap",
        )
    )
    if same_suffix:
        tail = lambda c: F.regexp_replace(c, "^[^_]*_", "")
        found = found.where(tail(F.col("parent_col")) == tail(F.col("child_col")))
    return found


def as_relationships(found: DataFrame) -> list[Relationship]:
    """Relationship rows as sorted objects; at most one per pair of columns."""
    rows = found.select("parent", "parent_col", "child", "child_col").distinct().collect()
    return sorted(Relationship(*r) for r in rows)


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_rows(*[
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        for name, df in sorted(tables.items())
    ])


def choose_anchor(tables: Mapping[str, DataFrame], target: str | None = None) -> str:
    """The named table if it exists, else the largest; ties go to the greatest name."""
    if target and target in tables:
        return target
    return table_sizes(tables).agg(F.max(F.struct("n_rows", "table")).alias("m")).first()["m"]["table"]


def feature_schema(df: DataFrame) -> DataFrame:
    """``name, dtype, nullable, n_rows, n_columns``; nullable means nulls are present."""
    fields = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            (F.count_if(quoted(f.name).isNull()) > 0).alias("nullable"),
            F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"),
        )
        for i, f in enumerate(df.schema)
    ]
    return df.agg(F.array(*fields).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def check_schema(
    df: DataFrame,
    expected: T.StructType,
    *,
    mode: str = "strict",
    allow_new: bool = False,
    coerce: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Compare with an expected schema; returns the (cast) frame and a report.

    Report rows are ``column, expected, found, status, failed_rows``; status is ok,
    missing, new, mismatch or coerced. In ``strict`` mode a missing, mismatched or
    unwanted new column, or a value that does not cast, is an error.
    """
    if mode not in ("strict", "warn", "off"):
        raise ValueError(f"unknown mode {mode}")
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in expected}
    status: dict[str, str] = {}
    for c in [*want, *[c for c in have if c not in want]]:
        if c not in have:
            status[c] = "missing"
        elif c not in want:
            status[c] = "new"
        elif have[c] == want[c]:
            status[c] = "ok"
        else:
            status[c] = "coerced" if coerce else "mismatch"
    failed = {
        c: F.count_if(quoted(c).isNotNull() & quoted(c).try_cast(want[c]).isNull())
        for c, s in status.items()
        if s == "coerced"
    }
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(want[c].simpleString() if c in want else None).cast("string").alias("expected"),
            F.lit(have[c].simpleString() if c in have else None).cast("string").alias("found"),
            F.lit(s).alias("status"),
            failed.get(c, F.lit(0)).cast("bigint").alias("failed_rows"),
        )
        for c, s in status.items()
    ]
    report = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    if mode == "strict":
        bad = [c for c, s in status.items() if s in ("missing", "mismatch") or (s == "new" and not allow_new)]
        if not bad and failed:
            bad = [r["column"] for r in report.where("failed_rows > 0").collect()]
        if bad:
            raise ValueError(f"schema check failed for {sorted(bad)}")
    if mode == "off" or not coerce:
        return df, report
    cast = df.select(*[
        quoted(c).try_cast(want[c]).alias(c) if status[c] == "coerced" else quoted(c) for c in df.columns
    ])
    return cast, report


def data_quality(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rule, n_bad, n_rows, share`` for each rule, a condition that marks a bad row."""
    cells = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(F.coalesce(bad, F.lit(False))).alias("n_bad"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        for name, bad in rules.items()
    ]
    counted = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return counted.withColumn("share", F.col("n_bad") / F.nullif(F.col("n_rows"), F.lit(0)))
