"""Deep feature synthesis: aggregate upward from children, look up downward from parents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import datetime_parts, quoted, text_counts
from tributary.operators.profile import Relationship
from tributary.operators.skew import HOT_ROWS, lookup_join
from tributary.session import durable

# Which primitives apply to which kind of column.
NUMERIC_PRIMITIVES = ("SUM", "STD", "MAX", "SKEW", "MIN", "MEAN")
CATEGORY_PRIMITIVES = ("NUM_UNIQUE", "MODE")
# A primitive is not applied to its own result, except these.
REPEATABLE = ("MEAN", "MODE")


@dataclass(frozen=True)
class Feature:
    """A column of a feature table: its name, kind and outermost primitive."""

    name: str
    kind: str  # number, category or boolean
    primitive: str = ""


def _skew(value: Column) -> Column:
    """Bias-corrected skewness; 0 without spread, null below three values."""
    n = F.count(value).cast("double")
    adjusted = F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(F.count(value) < 3, None).when(F.min(value) == F.max(value), 0.0).otherwise(adjusted)


def _numeric_aggregate(primitive: str, value: Column) -> Column:
    wide = value.cast("double")
    return {
        "SUM": lambda: F.coalesce(F.sum(wide), F.lit(0.0)),
        "STD": lambda: F.stddev_samp(wide),
        "MAX": lambda: F.max(wide),
        "SKEW": lambda: _skew(wide),
        "MIN": lambda: F.min(wide),
        "MEAN": lambda: F.avg(wide),
    }[primitive]()


class _Synthesis:
    def __init__(self, tables, relationships, keys, text_columns, hot_rows):
        self.tables = tables
        self.relationships = sorted(set(relationships))
        self.keys = keys
        self.text = {t: set(c) for t, c in (text_columns or {}).items()}
        self.hot_rows = hot_rows
        self.joins: dict[str, set[str]] = {t: {k} for t, k in keys.items()}
        for r in self.relationships:
            self.joins.setdefault(r.parent, set()).add(r.parent_col)
            self.joins.setdefault(r.child, set()).add(r.child_col)

    def features(self, table: str, depth: int, path: tuple[str, ...]) -> tuple[DataFrame, list[Feature]]:
        """The table's key columns plus all its features up to ``depth``."""
        df, found = self._own(table, depth)
        if depth == 0:
            return df, found
        here = (*path, table)
        for r in self.relationships:
            if r.parent == table and r.child not in here:
                grouped, made = self._aggregated(r, depth - 1, here)
                df = df.join(grouped, quoted(r.parent_col) == F.col("__fk"), "left").drop("__fk")
                zero = {f.name for f in made if f.primitive in ("COUNT", "SUM")}
                df = df.select(*[
                    F.coalesce(quoted(c), F.lit(0)).alias(c) if c in zero else quoted(c) for c in df.columns
                ])
                found = found + made
        for r in self.relationships:
            if r.child == table and r.parent not in here:
                parent, above = self.features(r.parent, depth - 1, here)
                looked_up = parent.select(
                    quoted(r.parent_col).alias("__pk"),
                    *[quoted(f.name).alias(f"{r.parent}.{f.name}") for f in above],
                )
                df = lookup_join(df, looked_up, r.child_col, "__pk", hot_rows=self.hot_rows)
                found = found + [Feature(f"{r.parent}.{f.name}", f.kind, f.primitive) for f in above]
        return df, found

    def _own(self, table: str, depth: int) -> tuple[DataFrame, list[Feature]]:
        """The table's plain columns, and from depth 1 their transforms, in one projection."""
        df = self.tables[table]
        joins = sorted(self.joins.get(table, set()))
        columns = [quoted(c) for c in joins]
        found = []
        for f in df.schema:
            c, name = quoted(f.name), f.name
            if name in joins:
                continue
            if isinstance(f.dataType, T.BooleanType):
                found.append(Feature(name, "boolean"))
                columns.append(c)
            elif isinstance(f.dataType, T.NumericType):
                found.append(Feature(name, "number"))
                columns.append(c)
            elif isinstance(f.dataType, T.StringType) and name not in self.text.get(table, ()):
                found.append(Feature(name, "category"))
                columns.append(c)
            elif depth and isinstance(f.dataType, (T.TimestampType, T.DateType)):
                for p, e in datetime_parts(c).items():
                    found.append(Feature(f"{p}({name})", "category", p))
                    columns.append(e.alias(f"{p}({name})"))
            elif depth and isinstance(f.dataType, T.StringType):
                for p, e in text_counts(c).items():
                    found.append(Feature(f"{p}({name})", "number", p))
                    columns.append(e.alias(f"{p}({name})"))
        return df.select(*columns), found

    def _aggregated(self, r: Relationship, depth: int, path) -> tuple[DataFrame, list[Feature]]:
        """One row per parent key with all primitives over the child's features."""
        child, below = self.features(r.child, depth, path)
        if depth:
            # Read twice below, and costly: its own children are joined in.
            child = durable(child, "features")
        key = quoted(r.child_col)
        rows = child.where(key.isNotNull())
        made = [Feature(f"COUNT({r.child})", "number", "COUNT")]
        parts = [F.count(F.lit(1)).alias(made[0].name)]
        for f in below:
            if f.kind == "number":
                for p in NUMERIC_PRIMITIVES:
                    if (p == f.primitive and p not in REPEATABLE) or (p == "SUM" and f.primitive == "COUNT"):
                        continue
                    made.append(Feature(f"{p}({r.child}.{f.name})", "number", p))
                    parts.append(_numeric_aggregate(p, quoted(f.name)).alias(made[-1].name))
            elif f.kind == "boolean":
                made.append(Feature(f"PERCENT_TRUE({r.child}.{f.name})", "number", "PERCENT_TRUE"))
                parts.append(F.avg(quoted(f.name).cast("double")).alias(made[-1].name))
        grouped = rows.groupBy(key.alias("__fk")).agg(*parts)
        categories = [f for f in below if f.kind == "category"]
        if categories:
            values, more = self._category_aggregates(r, rows, categories)
            grouped = grouped.join(values.withColumnRenamed("__fk", "__fk2"), F.col("__fk") == F.col("__fk2"), "left")
            grouped = grouped.drop("__fk2")
            made += more
        return grouped, made

    def _category_aggregates(self, r, rows: DataFrame, categories: list[Feature]) -> tuple[DataFrame, list[Feature]]:
        """Distinct count and most frequent value per key and column.

        Values are counted per (key, column, value) first, so a key with any
        number of rows is reduced before its values meet.
        """
        cells = [
            F.struct(F.lit(i).alias("c"), quoted(f.name).cast("string").alias("v")) for i, f in enumerate(categories)
        ]
        counted = (
            rows.select(quoted(r.child_col).alias("__fk"), F.explode(F.array(*cells)).alias("x"))
            .where("x.v is not null")
            .groupBy("__fk", "x.c", "x.v")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        types = {f.name: f.dataType for f in rows.schema}
        parts, made = [], []
        for i, f in enumerate(categories):
            mine = F.col("c") == i
            for p in CATEGORY_PRIMITIVES:
                if p == f.primitive and p not in REPEATABLE:
                    continue
                name = f"{p}({r.child}.{f.name})"
                if p == "NUM_UNIQUE":
                    parts.append(F.count_if(mine).alias(name))
                    made.append(Feature(name, "number", p))
                else:
                    # Most frequent, of equals the smallest.
                    best = F.min(F.when(mine, F.struct((-F.col("n")).alias("n"), _typed(types[f.name]).alias("v"))))
                    parts.append(best["v"].alias(name))
                    made.append(Feature(name, "category", p))
        return counted.groupBy("__fk").agg(*parts), made


def _typed(data_type: T.DataType) -> Column:
    return F.col("v").cast(data_type)


def deep_features(
    tables: Mapping[str, DataFrame],
    relationships: Sequence[Relationship],
    target: str,
    keys: Mapping[str, str],
    *,
    max_depth: int = 2,
    max_features: int = 0,
    text_columns: Mapping[str, Sequence[str]] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per row of ``target``: its key and features such as ``SUM(child.col)``.

    ``keys`` names the unique key per table. A table is not visited twice on one
    path. Features are sorted by name and cut at ``max_features`` (below 1: no
    cut); what is cut is not computed. Strings are categories unless listed in
    ``text_columns``.
    """
    work = _Synthesis(tables, relationships, keys, text_columns, hot_rows)
    df, found = work.features(target, max_depth, ())
    names = sorted(f.name for f in found)
    if max_features > 0:
        names = names[:max_features]
    key = keys[target]
    return df.select(quoted(key), *[quoted(n) for n in names])
