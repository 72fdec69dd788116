"""Queries that build, sequence, prune and split feature tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import quoted
from tributary.operators import joins, prune, sequence, split
from tributary.operators.deep import deep_features as synthesise
from tributary.operators.profile import Relationship
from tributary.plans.features import FeatureOptions, build_feature_matrix
from workloads.profiles import PAIRS, RANKED, SPARSE_COLUMNS, SPARSE_NUMBERS, SPARSE_SQL, sparse_lines
from workloads.tables import load, md5_number_sql, rounded, rounded_sql, stamp, stamp_sql


# --- sequences -------------------------------------------------------------


def _series(spark, sf_dir) -> DataFrame:
    """Event values in time, with gaps."""
    value = F.when(F.col("event_type") != "view", F.col("value"))
    return load(spark, sf_dir, "events").select("event_id", "user_id", "ts", value.alias("value"))


#: All numbers of an event but its key.
EVENT_NUMBERS = ["value", "user_id"]
SERIES_SQL = "s AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'view' THEN value END AS value FROM events)"


def _shown(df: DataFrame, *keys: str) -> DataFrame:
    numbers = [c for c in df.columns if c not in (*keys, "ts") and (c.startswith(("value", "user_id_")))]
    return df.select(*keys, *[rounded(quoted(c), 6).alias(c) for c in numbers])


def _sequence_sql(periods, windows, group="", columns=("value",)) -> tuple[str, list[str]]:
    """The columns made step by step, as nested views."""
    over = f"(PARTITION BY {group} ORDER BY ts, event_id" if group else "(ORDER BY ts, event_id"
    views, names, last = [SERIES_SQL], list(columns), "s"
    for p in periods:
        made = [f"lag({c}, {p}) OVER {over}) AS {c}_lag_{p}" for c in names]
        views.append(f"lag{p} AS (SELECT *, {', '.join(made)} FROM {last})")
        names, last = names + [f"{c}_lag_{p}" for c in names], f"lag{p}"
    for w in windows:
        made = [f"avg({c}) OVER {over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {c}_roll_mean_{w}" for c in names]
        views.append(f"roll{w} AS (SELECT *, {', '.join(made)} FROM {last})")
        names, last = names + [f"{c}_roll_mean_{w}" for c in names], f"roll{w}"
    shown = ", ".join(f"{rounded_sql(c, 6)} AS {c}" for c in names if c != "user_id")
    return f"WITH {', '.join(views)} SELECT event_id, {shown} FROM {last}", names


def lag_features(spark, sf_dir) -> DataFrame:
    out = sequence.lag_features(_series(spark, sf_dir), "ts", "event_id", [1, 3], columns=EVENT_NUMBERS)
    return _shown(out, "event_id")


def rolling_mean(spark, sf_dir) -> DataFrame:
    out = sequence.rolling_mean(_series(spark, sf_dir), "ts", "event_id", [3, 7], columns=EVENT_NUMBERS)
    return _shown(out, "event_id")


def lag_and_rolling(spark, sf_dir) -> DataFrame:
    out = sequence.lag_and_rolling(
        _series(spark, sf_dir), "ts", "event_id", periods=[1, 2], windows=[2, 3], columns=["value"]
    )
    return _shown(out, "event_id")


def panel_lag(spark, sf_dir) -> DataFrame:
    out = sequence.lag_and_rolling(
        _series(spark, sf_dir), "ts", "event_id", periods=[1, 2], windows=[3], columns=["value"], group=["user_id"]
    )
    return _shown(out, "event_id")


def forecast_target(spark, sf_dir) -> DataFrame:
    """The value two events later, over the whole series and within each user."""
    series = _series(spark, sf_dir)
    ahead = sequence.forecast_target(series, "value", 2, "ts", "event_id", name="value_ahead")
    out = sequence.forecast_target(ahead, "value", 2, "ts", "event_id", group=["user_id"], name="value_user_ahead")
    return out.select("event_id", "value", "value_ahead", "value_user_ahead")


FORECAST_SQL = f"""
WITH {SERIES_SQL}
SELECT event_id, value, lead(value, 2) OVER (ORDER BY ts, event_id) AS value_ahead,
       lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_user_ahead
FROM s"""


# --- joins -----------------------------------------------------------------

LINE_RELATIONSHIPS = [
    Relationship("orders", "o_orderkey", "lineitem", "l_orderkey"),
    Relationship("part", "p_partkey", "lineitem", "l_partkey"),
    Relationship("supplier", "s_suppkey", "lineitem", "l_suppkey"),
    # Same names as the one before, so it does not apply.
    Relationship("supplier", "s_suppkey", "orders", "l_linenumber"),
    # The anchor has no such column.
    Relationship("nation", "n_nationkey", "supplier", "s_nationkey"),
]


def aggregate_join(spark, sf_dir) -> DataFrame:
    tables = {n: load(spark, sf_dir, n) for n in ("orders", "part", "supplier", "lineitem", "nation")}
    anchor = tables["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    out = joins.aggregate_join(anchor, tables, LINE_RELATIONSHIPS)
    return out.select(*[
        rounded(quoted(c), 4).alias(c) if c.endswith(("_mean", "price_sum", "acctbal_sum")) else quoted(c)
        for c in out.columns
    ])


def _parent_sql(table: str, key: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        total = rounded_sql(f"sum({c})", 4) if kind == "double" else f"CAST(sum({c}) AS BIGINT)"
        parts.append(f"count({c}) AS {c}_count, {total} AS {c}_sum, {rounded_sql(f'avg({c})', 4)} AS {c}_mean")
    return f"LEFT JOIN (SELECT {key} AS k_{table}, {', '.join(parts)} FROM {table} GROUP BY 1) ON k_{table} = "


AGGREGATE_JOIN_SQL = f"""
SELECT * EXCLUDE (k_orders, k_part, k_supplier)
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem)
{_parent_sql("orders", "o_orderkey", {"o_orderkey": "int", "o_custkey": "int", "o_totalprice": "double"})} l_orderkey
{_parent_sql("part", "p_partkey", {"p_partkey": "int", "p_size": "int", "p_retailprice": "double"})} l_partkey
{_parent_sql("supplier", "s_suppkey", {"s_suppkey": "int", "s_nationkey": "int", "s_acctbal": "double"})} l_suppkey"""


# --- deep feature synthesis --------------------------------------------------

DEEP_RELATIONSHIPS = [
    Relationship("customer", "c_custkey", "orders", "o_custkey"),
    Relationship("orders", "o_orderkey", "lineitem", "l_orderkey"),
    Relationship("nation", "n_nationkey", "customer", "c_nationkey"),
    Relationship("region", "r_regionkey", "nation", "n_regionkey"),
]
DEEP_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey"}


def plain_name(feature: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", feature.lower()).strip("_")


def _deep(spark, sf_dir, depth: int) -> DataFrame:
    tables = {n: load(spark, sf_dir, n) for n in ("customer", "orders", "nation", "region")}
    tables["lineitem"] = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    out = synthesise(tables, DEEP_RELATIONSHIPS, "customer", DEEP_KEYS, max_depth=depth)
    types = dict(out.dtypes)
    return out.select(*[
        rounded(quoted(c), 4).alias(plain_name(c)) if types[c] == "double" else quoted(c).alias(plain_name(c))
        for c in out.columns
    ])


def deep_features(spark, sf_dir) -> DataFrame:
    return _deep(spark, sf_dir, 1)


def deep_features_2(spark, sf_dir) -> DataFrame:
    return _deep(spark, sf_dir, 2)


_PRIMITIVES = {
    "SUM": "coalesce(sum({c}), 0)", "STD": "stddev_samp({c})", "MAX": "max({c})", "MIN": "min({c})", "MEAN": "avg({c})",
    "SKEW": "CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0 ELSE skewness({c}) END",
}


class _Child:
    """SQL of all aggregates of one child view, joined by its foreign key."""

    def __init__(self, view: str, label: str, key: str):
        self.view, self.label, self.key = view, label, key
        self.parts = [f"count(*) AS {plain_name(f'COUNT({label})')}"]
        self.modes: list[str] = []
        self.numbers: list[tuple[str, str]] = [(f"COUNT({label})", "COUNT")]
        self.categories: list[str] = []

    def number(self, feature: str, primitive: str = "") -> None:
        for p, text in _PRIMITIVES.items():
            if (p == primitive and p != "MEAN") or (p == "SUM" and primitive == "COUNT"):
                continue
            name = f"{p}({self.label}.{feature})"
            self.parts.append(f"CAST({text.format(c=plain_name(feature) + '::DOUBLE')} AS DOUBLE) AS {plain_name(name)}")
            self.numbers.append((name, p))

    def category(self, feature: str) -> None:
        column = plain_name(feature)
        unique, mode = f"NUM_UNIQUE({self.label}.{feature})", f"MODE({self.label}.{feature})"
        self.parts.append(f"count(DISTINCT {column}) AS {plain_name(unique)}")
        self.numbers.append((unique, "NUM_UNIQUE"))
        self.modes.append(
            f"LEFT JOIN (SELECT {self.key}, arg_min(v, (-n, v)) AS {plain_name(mode)} FROM"
            f" (SELECT {self.key}, {column} AS v, count(*) AS n FROM {self.view} WHERE {column} IS NOT NULL GROUP BY 1, 2)"
            f" GROUP BY 1) USING ({self.key})"
        )
        self.categories.append(mode)

    def sql(self) -> str:
        return f"SELECT * FROM (SELECT {self.key}, {', '.join(self.parts)} FROM {self.view} GROUP BY 1) {' '.join(self.modes)}"


def _deep_sql(depth: int) -> str:
    views = []
    orders = _Child("orders", "orders", "o_custkey")
    if depth == 2:
        lines = _Child("lineitem", "lineitem", "l_orderkey")
        lines.number("l_quantity")
        lines.number("l_discount")
        lines.category("l_returnflag")
        views.append(f"lines AS ({lines.sql()})")
        zeros = [plain_name(n) for n, p in lines.numbers if p in ("COUNT", "SUM")]
        others = [plain_name(n) for n, p in lines.numbers if p not in ("COUNT", "SUM")]
        others += [plain_name(c) for c in lines.categories]
        parts = {"day": "day", "month": "month", "weekday": "isodow", "year": "year"}
        dates = [
            f"CAST({f}(o_orderdate){' - 1' if f == 'isodow' else ''} AS INTEGER) AS {plain_name(f'{p}(o_orderdate)')}"
            for p, f in parts.items()
        ]
        views.append(
            f"rich AS (SELECT orders.*, {', '.join(dates)}, {', '.join(f'coalesce({z}, 0) AS {z}' for z in zeros)},"
            f" {', '.join(others)} FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)"
        )
        orders.view = "rich"
        for feature, primitive in lines.numbers:
            orders.number(feature, primitive)
        for p in parts:
            orders.category(f"{p.upper()}(o_orderdate)")
        for feature in lines.categories:
            orders.category(feature)
    orders.number("o_totalprice")
    orders.category("o_orderstatus")
    orders.category("o_orderpriority")
    views.append(f"per_customer AS ({orders.sql()})")
    shown = []
    for feature, primitive in orders.numbers:
        c = plain_name(feature)
        if primitive in ("COUNT", "NUM_UNIQUE"):
            shown.append(f"coalesce({c}, 0) AS {c}" if primitive == "COUNT" else c)
        else:
            value = f"coalesce({c}, 0)" if primitive == "SUM" else c
            shown.append(f"{rounded_sql(value, 4)} AS {c}")
    shown += [plain_name(c) for c in orders.categories]
    shown += ["c_name", "c_mktsegment", f"{rounded_sql('c_acctbal', 4)} AS c_acctbal", "n_name AS nation_n_name"]
    region = ""
    if depth == 2:
        shown.append("r_name AS nation_region_r_name")
        region = "LEFT JOIN region ON r_regionkey = n_regionkey"
    return f"""WITH {", ".join(views)} SELECT c_custkey, {", ".join(shown)} FROM customer
        LEFT JOIN per_customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey {region}"""


# --- pruning -----------------------------------------------------------------


def _kept(df: DataFrame, dropped) -> DataFrame:
    gone = set(dropped)
    rows = [(c, int(c not in gone)) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column_name string, kept int")


def prune_missing(spark, sf_dir) -> DataFrame:
    df = sparse_lines(spark, sf_dir)
    return _kept(df, prune.missing_columns(df, 0.8))


PRUNE_MISSING_SQL = f"WITH {SPARSE_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.8 THEN 0 ELSE 1 END AS kept FROM sparse"
    for c in SPARSE_COLUMNS
)


def prune_constant(spark, sf_dir) -> DataFrame:
    df = sparse_lines(spark, sf_dir)
    return _kept(df, prune.constant_columns(df))


PRUNE_CONSTANT_SQL = f"WITH {SPARSE_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) <= 1 THEN 0 ELSE 1 END AS kept FROM sparse"
    for c in SPARSE_COLUMNS
)


def prune_correlated(spark, sf_dir) -> DataFrame:
    df = sparse_lines(spark, sf_dir).select(*SPARSE_NUMBERS)
    return _kept(df, prune.correlated_columns(df, 0.9))


_WALK_NAMES = " UNION ALL ".join(f"SELECT '{c}' AS c" for c in SPARSE_NUMBERS)
PRUNE_CORRELATED_SQL = f"""
WITH RECURSIVE {SPARSE_SQL},
p AS (SELECT a, b, abs(r) AS r FROM ({PAIRS})),
means AS (
  SELECT c, round(avg(r), 10) AS m FROM (
    SELECT a AS c, r FROM p UNION ALL SELECT b, r FROM p
    UNION ALL SELECT DISTINCT x, 1.0 FROM (SELECT a AS x, r FROM p UNION ALL SELECT b, r FROM p) WHERE r IS NOT NULL)
  GROUP BY c),
hits AS (
  SELECT row_number() OVER (ORDER BY p.a, p.b) AS k, p.a, p.b, CASE WHEN ma.m > mb.m THEN p.a ELSE p.b END AS loser
  FROM p JOIN means ma ON ma.c = p.a JOIN means mb ON mb.c = p.b WHERE p.r >= 0.9),
walk AS (
  SELECT 0::BIGINT AS k, ''::VARCHAR AS turn, false AS skipped, []::VARCHAR[] AS gone
  UNION ALL
  SELECT h.k, h.a,
         CASE WHEN h.a = w.turn THEN w.skipped ELSE list_contains(w.gone, h.a) END,
         CASE WHEN NOT (CASE WHEN h.a = w.turn THEN w.skipped ELSE list_contains(w.gone, h.a) END)
                   AND NOT list_contains(w.gone, h.b)
              THEN list_append(w.gone, h.loser) ELSE w.gone END
  FROM walk w JOIN hits h ON h.k = w.k + 1)
SELECT c AS column_name, CASE WHEN list_contains((SELECT gone FROM walk ORDER BY k DESC LIMIT 1), c) THEN 0 ELSE 1 END AS kept
FROM ({_WALK_NAMES})"""


def prune_cap(spark, sf_dir) -> DataFrame:
    kept, _ = prune.cap_columns(sparse_lines(spark, sf_dir), 6)
    rows = [(i + 1, c) for i, c in enumerate(kept.columns)]
    return spark.createDataFrame(rows, "rank int, column_name string")


PRUNE_CAP_SQL = f"WITH {SPARSE_SQL}, {RANKED} SELECT rank, column_name FROM ranked WHERE rank <= 6"


# --- the whole matrix ---------------------------------------------------------

MATRIX_RELATIONSHIPS = [Relationship("customer", "c_custkey", "orders", "o_custkey")]


def feature_matrix(spark, sf_dir) -> DataFrame:
    """Orders with their customer's aggregates, lagged and averaged in time, pruned."""
    tables = {n: load(spark, sf_dir, n) for n in ("orders", "customer")}
    options = FeatureOptions(
        anchor="orders",
        time="o_orderdate",
        relationships=MATRIX_RELATIONSHIPS,
        row_key="o_orderkey",
        lag_periods=[1],
        rolling_windows=[3],
        sequence_columns=["o_totalprice"],
    )
    options.prune.protect = ["o_orderkey", "o_orderdate"]
    out = build_feature_matrix(tables, options).df
    types = dict(out.dtypes)
    shown = []
    for c in out.columns:
        if types[c] == "double":
            shown.append(rounded(quoted(c), 4).alias(c))
        elif types[c] == "timestamp":
            shown.append(stamp(quoted(c)).alias(c))
        else:
            shown.append(quoted(c))
    return out.select(*shown)


FEATURE_MATRIX_SQL = f"""
WITH l AS (
  SELECT orders.*, c_acctbal, c_custkey, c_nationkey,
         lag(o_totalprice, 1) OVER (ORDER BY o_orderdate, o_orderkey) AS o_totalprice_lag_1
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT c_acctbal AS c_acctbal_mean, c_custkey::DOUBLE AS c_custkey_mean, c_nationkey::DOUBLE AS c_nationkey_mean,
       {stamp_sql("o_orderdate")} AS o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice,
       o_totalprice_lag_1,
       {rounded_sql("avg(o_totalprice_lag_1) OVER (ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING)", 4)}
         AS o_totalprice_lag_1_roll_mean_3,
       {rounded_sql("avg(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING)", 4)}
         AS o_totalprice_roll_mean_3
FROM l"""


# --- splits --------------------------------------------------------------------


def split_time(spark, sf_dir) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return split.split_time(orders, "o_orderdate", "o_orderkey").select("o_orderkey", "split")


def split_auto(spark, sf_dir) -> DataFrame:
    """What the automatic split takes with a time, with strata only, and with neither."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    df = split.split_auto(df, "o_orderkey", time="o_orderdate", stratum="o_orderpriority", name="by_time")
    df = split.split_auto(df, "o_orderkey", stratum="o_orderpriority", name="by_stratum")
    return split.split_auto(df, "o_orderkey", name="by_hash").select("o_orderkey", "by_time", "by_stratum", "by_hash")


def split_random(spark, sf_dir) -> DataFrame:
    return split.split_random(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def split_random_exact(spark, sf_dir) -> DataFrame:
    return split.split_random(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", exact=True)


def split_stratified(spark, sf_dir) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return split.split_stratified(orders, "o_orderkey", "o_orderpriority")


def split_group(spark, sf_dir) -> DataFrame:
    return split.split_group(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


def kfold_assign(spark, sf_dir) -> DataFrame:
    return split.assign_folds(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


def _side(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'train' ELSE 'test' END AS split"


_CUT = "floor(count(*) OVER ({over}) * 0.8)"
_WIDE = md5_number_sql("'42:' || o_orderkey", 1, 15)
SPLIT_TIME_SQL = f"""
SELECT o_orderkey, {_side(f"row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= {_CUT.format(over='')}")} FROM orders"""
SPLIT_EXACT_SQL = f"""
SELECT o_orderkey, {_side(f"row_number() OVER (ORDER BY {_WIDE}) <= {_CUT.format(over='')}")} FROM orders"""
SPLIT_STRATA_SQL = f"""
SELECT o_orderkey, o_orderpriority,
       {_side(f"row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_WIDE}) <= {_CUT.format(over='PARTITION BY o_orderpriority')}")}
FROM orders"""


def _hash_side(key: str) -> str:
    number = md5_number_sql(f"'42:' || {key}")
    return _side(f"{number} / 4294967296.0 < 0.8")


def _named(side: str, name: str) -> str:
    return side.removesuffix("split") + name


SPLIT_AUTO_SQL = f"""
SELECT o_orderkey,
       {_named(_side(f"row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= {_CUT.format(over='')}"), "by_time")},
       {_named(_side(f"row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_WIDE}) <= {_CUT.format(over='PARTITION BY o_orderpriority')}"), "by_stratum")},
       {_named(_hash_side("o_orderkey"), "by_hash")}
FROM orders"""


QUERIES = {
    "feature_matrix": feature_matrix,
    "aggregate_join": aggregate_join,
    "deep_features": deep_features,
    "deep_features_2": deep_features_2,
    "lag_features": lag_features,
    "rolling_mean": rolling_mean,
    "lag_and_rolling": lag_and_rolling,
    "panel_lag": panel_lag,
    "forecast_target": forecast_target,
    "prune_missing": prune_missing,
    "prune_constant": prune_constant,
    "prune_correlated": prune_correlated,
    "prune_cap": prune_cap,
    "split_time": split_time,
    "split_auto": split_auto,
    "split_random": split_random,
    "split_random_exact": split_random_exact,
    "split_stratified": split_stratified,
    "split_group": split_group,
    "kfold_assign": kfold_assign,
}

ORACLES = {
    "feature_matrix": FEATURE_MATRIX_SQL,
    "aggregate_join": AGGREGATE_JOIN_SQL,
    "deep_features": _deep_sql(1),
    "deep_features_2": _deep_sql(2),
    "lag_features": _sequence_sql([1, 3], [], columns=EVENT_NUMBERS)[0],
    "rolling_mean": _sequence_sql([], [3, 7], columns=EVENT_NUMBERS)[0],
    "lag_and_rolling": _sequence_sql([1, 2], [2, 3])[0],
    "panel_lag": _sequence_sql([1, 2], [3], "user_id")[0],
    "forecast_target": FORECAST_SQL,
    "prune_missing": PRUNE_MISSING_SQL,
    "prune_constant": PRUNE_CONSTANT_SQL,
    "prune_correlated": PRUNE_CORRELATED_SQL,
    "prune_cap": PRUNE_CAP_SQL,
    "split_time": SPLIT_TIME_SQL,
    "split_auto": SPLIT_AUTO_SQL,
    "split_random": f"SELECT o_orderkey, {_hash_side('o_orderkey')} FROM orders",
    "split_random_exact": SPLIT_EXACT_SQL,
    "split_stratified": SPLIT_STRATA_SQL,
    "split_group": f"SELECT o_orderkey, o_custkey, {_hash_side('o_custkey')} FROM orders",
    "kfold_assign": f"SELECT o_orderkey, {md5_number_sql(chr(39) + '42:' + chr(39) + ' || o_orderkey')} % 5 AS fold FROM orders",
}
