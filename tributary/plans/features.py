"""From a set of related tables to one pruned feature matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tributary.functions.columns import is_numeric, protect_pii, sort_columns
from tributary.operators.deep import deep_features
from tributary.operators.joins import aggregate_join
from tributary.operators.profile import (
    ColumnSets,
    Relationship,
    as_relationships,
    candidate_keys_of,
    choose_anchor,
    column_sets,
    relationships,
    time_columns,
)
from tributary.operators.prune import PruneOptions, PruneReport, prune
from tributary.operators.sequence import ensure_row_id, lag_and_rolling
from tributary.session import durable


@dataclass
class FeatureOptions:
    """What to build. Relationships, keys and time column are found if not given."""

    anchor: str | None = None
    time: str | None = None
    relationships: Sequence[Relationship] | None = None
    keys: Mapping[str, Sequence[str]] | None = None
    row_key: str | None = None
    order_by: Sequence[str] | None = None
    prefix: bool = False
    deep: bool = False
    max_depth: int = 2
    deep_features: int = 0
    lag_periods: Sequence[int] = ()
    rolling_windows: Sequence[int] = ()
    sequence_columns: Sequence[str] | None = None
    group: Sequence[str] = ()
    compound: bool = True
    pii: Sequence[str] = ()
    hash_pii: bool = True
    prune: PruneOptions = field(default_factory=PruneOptions)


@dataclass
class FeatureMatrix:
    df: DataFrame
    anchor: str
    row_key: str
    time: str | None
    relationships: list[Relationship]
    dropped: PruneReport


def find_keys(tables: Mapping[str, DataFrame], sets: ColumnSets | None = None) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {name: [] for name in sorted(tables)}
    for r in candidate_keys_of(tables, sets).collect():
        found[r["table"]].append(r["column"])
    return found


def _row_key(anchor: DataFrame, options: FeatureOptions, found: Sequence[str]) -> tuple[DataFrame, str]:
    if options.row_key:
        return anchor, options.row_key
    if "id" in anchor.columns:
        return anchor, "id"
    order = options.order_by or list(found)[:1] or [
        f.name for f in anchor.schema if f.dataType.simpleString() not in ("map", "variant")
    ]
    return ensure_row_id(anchor, order), "generated_index"


def _time_of(tables: Mapping[str, DataFrame], anchor: str, columns: Sequence[str]) -> str | None:
    """The anchor's time column, else the first other table's, by name, that the matrix has too."""
    found = {r["table"]: r["time_column"] for r in time_columns(tables).collect() if r["time_column"]}
    others = [found[t] for t in sorted(found) if t != anchor]
    return next((c for c in [found.get(anchor), *others] if c in columns), None)


def build_feature_matrix(tables: Mapping[str, DataFrame], options: FeatureOptions | None = None) -> FeatureMatrix:
    """Join, sequence and prune; the joined matrix is written once, then read by column.

    Pruning reads the matrix several times (null shares, extremes, correlation),
    so it is fixed before, and each reading takes only the columns it needs.
    """
    o = options or FeatureOptions()
    anchor_name = choose_anchor(tables, o.anchor)
    keys, sets = o.keys, None
    if keys is None and (o.relationships is None or o.deep):
        # Keys and relationships come from the same pass over the tables.
        sets = column_sets(tables)
        keys = find_keys(tables, sets)
    keys = keys or {}
    found = (
        list(o.relationships) if o.relationships is not None else as_relationships(relationships(tables, keys, sets=sets))
    )
    anchor, row_key = _row_key(tables[anchor_name], o, keys.get(anchor_name, ()))
    if o.deep:
        single = {t: k[0] for t, k in keys.items() if k}
        single[anchor_name] = row_key
        matrix = deep_features(
            {**tables, anchor_name: anchor}, found, anchor_name, single, max_depth=o.max_depth, max_features=o.deep_features
        )
    else:
        matrix = aggregate_join(anchor, tables, found, prefix=o.prefix)
    time = o.time
    if not time and (o.lag_periods or o.rolling_windows):
        time = _time_of(tables, anchor_name, matrix.columns)
    if time and time in matrix.columns and (o.lag_periods or o.rolling_windows):
        matrix = durable(matrix, "joined")
        numbers = o.sequence_columns
        if numbers is None:
            keys_out = {row_key, time, *o.group}
            numbers = [f.name for f in matrix.schema if is_numeric(f.dataType) and f.name not in keys_out]
        matrix = lag_and_rolling(
            matrix,
            time,
            row_key,
            periods=o.lag_periods,
            windows=o.rolling_windows,
            columns=numbers,
            group=o.group,
            compound=o.compound,
        )
    if o.pii:
        matrix = protect_pii(matrix, o.pii, hashed=o.hash_pii)
    matrix = durable(sort_columns(matrix), "matrix")
    pruned, dropped = prune(matrix, o.prune)
    return FeatureMatrix(pruned, anchor_name, row_key, time, found, dropped)
