"""Queries on keys, time columns, relationships, schema and column statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import parse_ts, valid_ipv4
from tributary.operators import aggregates as agg
from tributary.operators import drift, profile
from tributary.operators.prune import correlation_pairs as pair_correlations
from tributary.operators.sequence import number_rows
from tributary.plans.features import find_keys
from tributary.session import shared_dir
from tributary.sources.tables import union_rows
from workloads.tables import load, load_all, rounded, rounded_sql

# Name and kind of every column of the given tables, for the SQL checks.
COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "text"},
    "nation": {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {
        "p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int",
        "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "double",
        "o_orderdate": "time", "o_orderpriority": "text",
    },
    "lineitem": {
        "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "double",
        "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "text",
        "l_linestatus": "text", "l_shipdate": "time",
    },
    "events": {
        "event_id": "int", "ts": "time", "user_id": "int", "event_type": "text", "value": "double", "props": "text",
    },
    "documents": {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"},
    "embeddings": {"vec_id": "int", "label": "int"},
    "pages": {"page_id": "int", "url": "text", "html": "text"},
    "benchmark": {"item_id": "int", "text": "text"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "text", "text": "text"},
}


def _each_column(kinds=("int", "double", "text", "time")):
    return [(t, c, k) for t, cols in COLUMNS.items() for c, k in cols.items() if k in kinds]


def candidate_keys(spark, sf_dir) -> DataFrame:
    found = profile.candidate_keys_of(load_all(spark, sf_dir))
    return found.withColumnsRenamed({"table": "table_name", "column": "column_name"})


_KEY_STATS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(\"{c}\") AS non_null, count(DISTINCT \"{c}\") AS n_distinct FROM {t}"
    for t, c, _ in _each_column()
)
KEYS_SQL = f"SELECT * FROM ({_KEY_STATS}) WHERE non_null > 10 AND n_distinct > 0.98 * non_null"


def time_column(spark, sf_dir) -> DataFrame:
    return profile.time_columns(load_all(spark, sf_dir)).withColumnRenamed("table", "table_name")


def _time_share(c: str, kind: str) -> str:
    if kind == "time":
        return "1.0"
    if kind == "text":
        return f'count(TRY_CAST("{c}" AS TIMESTAMP)) / nullif(count("{c}"), 0)'
    return "0.0"


TIME_SQL = (
    "WITH s AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS position, {_time_share(c, k)} AS share FROM {t}"
        for t, cols in COLUMNS.items()
        for i, (c, k) in enumerate(cols.items())
    )
    + ") SELECT table_name, arg_min(column_name, position) FILTER (share > 0.9) AS time_column FROM s GROUP BY 1"
)


def relationships(spark, sf_dir) -> DataFrame:
    tables = load_all(spark, sf_dir)
    sets = profile.column_sets(tables)
    found = profile.relationships(tables, find_keys(tables, sets), sets=sets)
    return found.withColumn("overlap", rounded(F.col("overlap"), 6))


def _sql_value(c: str, kind: str) -> str:
    if kind == "double":
        return f'CASE WHEN "{c}" = floor("{c}") THEN CAST(CAST("{c}" AS BIGINT) AS VARCHAR) ELSE CAST("{c}" AS VARCHAR) END'
    if kind == "time":
        return f'CAST(epoch_us("{c}") AS VARCHAR)'
    return f'CAST("{c}" AS VARCHAR)'


_VALUES = " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{'number' if k in ('int', 'double') else k}' AS class, {_sql_value(c, k)} AS v FROM {t}"
    for t, c, k in _each_column()
)
RELATIONSHIPS_SQL = f"""
WITH keys AS ({KEYS_SQL}),
vals AS (SELECT * FROM ({_VALUES}) WHERE v IS NOT NULL),
sizes AS (SELECT t, c, count(*) AS n FROM vals GROUP BY 1, 2),
pairs AS (
  SELECT p.t AS parent, p.c AS parent_col, k.t AS child, k.c AS child_col, count(*) AS common
  FROM vals p JOIN keys ON keys.table_name = p.t AND keys.column_name = p.c
  JOIN vals k ON k.class = p.class AND k.v = p.v AND k.t <> p.t
  GROUP BY 1, 2, 3, 4)
SELECT parent, parent_col, child, child_col, {rounded_sql("common / n", 6)} AS overlap
FROM pairs JOIN sizes ON sizes.t = child AND sizes.c = child_col
WHERE common > 5 AND common >= 0.9 * n"""


def choose_anchor(spark, sf_dir) -> DataFrame:
    tables = load_all(spark, sf_dir)
    anchor = profile.choose_anchor(tables)
    sizes = profile.table_sizes(tables)
    return sizes.select(F.col("table").alias("table_name"), "n_rows", (F.col("table") == anchor).cast("int").alias("is_anchor"))


_SIZES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in COLUMNS)
ANCHOR_SQL = f"""
SELECT table_name, n_rows,
       CASE WHEN row_number() OVER (ORDER BY n_rows DESC, table_name DESC) = 1 THEN 1 ELSE 0 END AS is_anchor
FROM ({_SIZES})"""


def row_id(spark, sf_dir) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return number_rows(orders, ["o_orderdate", "o_orderkey"], "generated_index").select("o_orderkey", "generated_index")


ROW_ID_SQL = """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS generated_index FROM orders"""


def sparse_lines(spark, sf_dir) -> DataFrame:
    """Line items with missing, constant and dependent columns derived from them."""
    q, price, disc = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.when(F.col("l_returnflag") == "A", F.col("l_tax")).alias("tax_returned"),
        F.when((q > 45) & (disc > 0.05), price).alias("rare_price"),
        F.lit(7).alias("fixed"),
        F.when(F.col("l_linestatus") == "F", F.lit("x")).alias("fixed_or_null"),
        F.lit(None).cast("double").alias("never"),
        (price * 2 + 5).alias("price_twice"),
        (price * (F.lit(1.0) - disc)).alias("price_net"),
        (q > 25).alias("many"),
        F.when(F.col("l_linestatus") == "O", -q).alias("q_open"),
    )


SPARSE_SQL = """sparse AS (
  SELECT l_orderkey, l_quantity, l_extendedprice, l_discount,
         CASE WHEN l_returnflag = 'A' THEN l_tax END AS tax_returned,
         CASE WHEN l_quantity > 45 AND l_discount > 0.05 THEN l_extendedprice END AS rare_price,
         7 AS fixed, CASE WHEN l_linestatus = 'F' THEN 'x' END AS fixed_or_null, NULL::DOUBLE AS never,
         l_extendedprice * 2 + 5 AS price_twice, l_extendedprice * (1.0::DOUBLE - l_discount) AS price_net,
         l_quantity > 25 AS many, CASE WHEN l_linestatus = 'O' THEN -l_quantity END AS q_open
  FROM lineitem)"""

SPARSE_COLUMNS = {
    "l_orderkey": "bigint", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double",
    "tax_returned": "double", "rare_price": "double", "fixed": "int", "fixed_or_null": "string", "never": "double",
    "price_twice": "double", "price_net": "double", "many": "boolean", "q_open": "double",
}
SPARSE_NUMBERS = [c for c, k in SPARSE_COLUMNS.items() if k in ("bigint", "int", "double")]


def feature_schema(spark, sf_dir) -> DataFrame:
    out = profile.feature_schema(sparse_lines(spark, sf_dir))
    return out.withColumn("nullable", F.col("nullable").cast("int"))


SCHEMA_SQL = f"WITH {SPARSE_SQL} " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS name, '{k}' AS dtype, CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS nullable,"
    f" count(*) AS n_rows, {len(SPARSE_COLUMNS)} AS n_columns FROM sparse"
    for i, (c, k) in enumerate(SPARSE_COLUMNS.items())
)


def schema_check(spark, sf_dir) -> DataFrame:
    """Events against a schema with a missing, a new and three differing columns."""
    expected = (
        T.StructType()
        .add("event_id", "long").add("user_id", "string").add("event_type", "string")
        .add("value", "integer").add("props", "double").add("session", "string").add("ts", "timestamp")
    )
    events = load(spark, sf_dir, "events").withColumn("extra", F.lit(1))
    _, report = profile.check_schema(events, expected, mode="warn", coerce=True)
    return report.withColumnRenamed("column", "column_name")


SCHEMA_CHECK_SQL = """
SELECT * FROM (VALUES
  ('event_id', 'bigint', 'bigint', 'ok'), ('user_id', 'string', 'bigint', 'coerced'),
  ('event_type', 'string', 'string', 'ok'), ('value', 'int', 'double', 'coerced'),
  ('props', 'double', 'string', 'coerced'), ('session', 'string', NULL, 'missing'),
  ('ts', 'timestamp', 'timestamp', 'ok'), ('extra', NULL, 'int', 'new')) AS r(column_name, expected, found, status)
CROSS JOIN LATERAL (
  SELECT CASE column_name
    WHEN 'props' THEN (SELECT count(*) FROM events WHERE props IS NOT NULL AND TRY_CAST(props AS DOUBLE) IS NULL)
    WHEN 'value' THEN (SELECT count(*) FROM events WHERE value IS NOT NULL AND TRY_CAST(value AS INTEGER) IS NULL)
    ELSE 0 END AS failed_rows)"""


def data_quality(spark, sf_dir) -> DataFrame:
    """Bad addresses, dates, amounts and gaps, derived from events and customers."""
    number = F.col("event_id")
    ip = F.concat_ws(".", *[(number % m).cast("string") for m in (300, 200, 100)], F.lit("7"))
    address = F.when(number % 50 == 0, "not_an_ip").when(number % 50 == 1, "").otherwise(ip)
    date = F.when(F.col("event_type") == "error", "someday").otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    events = load(spark, sf_dir, "events").select(
        address.alias("ip"), date.alias("seen"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("device")
    )
    on_events = profile.data_quality(events, {
        "invalid_ip": ~valid_ipv4(F.col("ip")),
        "unreadable_date": F.col("seen").isNotNull() & parse_ts(F.col("seen")).isNull(),
        "missing_device": F.col("device").isNull(),
    })
    on_customers = profile.data_quality(load(spark, sf_dir, "customer"), {"negative_balance": F.col("c_acctbal") < 0})
    return union_rows(on_events, on_customers).withColumn("share", rounded(F.col("share"), 6))


def _rule_sql(name: str, bad: str, table: str) -> str:
    return (
        f"SELECT '{name}' AS rule, count(*) FILTER ({bad}) AS n_bad, count(*) AS n_rows,"
        f" {rounded_sql(f'count(*) FILTER ({bad}) / count(*)', 6)} AS share FROM {table}"
    )


QUALITY_SQL = " UNION ALL ".join([
    _rule_sql("invalid_ip", "event_id % 50 IN (0, 1) OR event_id % 300 > 255", "events"),
    _rule_sql("unreadable_date", "event_type = 'error'", "events"),
    _rule_sql("missing_device", "event_type = 'view'", "events"),
    _rule_sql("negative_balance", "c_acctbal < 0", "customer"),
])


def null_fraction(spark, sf_dir) -> DataFrame:
    out = agg.null_fractions(sparse_lines(spark, sf_dir))
    return out.select(F.col("column").alias("column_name"), rounded(F.col("null_fraction"), 8).alias("null_fraction"))


NULL_SQL = f"WITH {SPARSE_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {rounded_sql(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 8)} AS null_fraction FROM sparse"
    for c in SPARSE_COLUMNS
)


def constant_columns(spark, sf_dir) -> DataFrame:
    out = agg.constant_flags(sparse_lines(spark, sf_dir))
    return out.select(F.col("column").alias("column_name"), F.col("is_constant").cast("int").alias("is_constant"))


CONSTANT_SQL = f"WITH {SPARSE_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) <= 1 THEN 1 ELSE 0 END AS is_constant FROM sparse"
    for c in SPARSE_COLUMNS
)


def variance_rank(spark, sf_dir) -> DataFrame:
    out = agg.variance_ranking(sparse_lines(spark, sf_dir))
    return out.select("rank", F.col("column").alias("column_name"), rounded(F.col("variance"), 2).alias("variance"))


def variance_sql(c: str) -> str:
    kind = SPARSE_COLUMNS[c]
    if kind == "string":
        return "max(0.0)"
    value = f"CAST({c} AS INTEGER)" if kind == "boolean" else c
    return f"coalesce(var_samp({value}), 0.0)"


RANKED = "v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {variance_sql(c)} AS variance FROM sparse" for c in SPARSE_COLUMNS
) + "), ranked AS (SELECT CAST(row_number() OVER (ORDER BY variance DESC, column_name) AS INTEGER) AS rank, column_name, variance FROM v)"
VARIANCE_SQL = f"WITH {SPARSE_SQL}, {RANKED} SELECT rank, column_name, {rounded_sql('variance', 2)} AS variance FROM ranked"


def correlation_pairs(spark, sf_dir) -> DataFrame:
    return pair_correlations(sparse_lines(spark, sf_dir), SPARSE_NUMBERS).withColumn("r", rounded(F.col("r"), 8))


def pair_sql(a: str, b: str) -> str:
    """Pearson over rows with both values, null without spread."""
    both = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    spread = f"min({a}) FILTER {both} < max({a}) FILTER {both} AND min({b}) FILTER {both} < max({b}) FILTER {both}"
    return f"CASE WHEN {spread} THEN corr({a}::DOUBLE, {b}::DOUBLE) END"


_NUMBERS = sorted(SPARSE_NUMBERS)
PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {pair_sql(a, b)} AS r FROM sparse"
    for i, a in enumerate(_NUMBERS)
    for b in _NUMBERS[i + 1 :]
)
CORRELATION_SQL = f"WITH {SPARSE_SQL}, p AS ({PAIRS}) SELECT a, b, {rounded_sql('r', 8)} AS r FROM p"


def quantile_threshold(spark, sf_dir) -> DataFrame:
    """Where to cut order totals for the top 1.8%, and who is above."""
    orders = load(spark, sf_dir, "orders")
    cut = agg.quantile_threshold(orders, "o_totalprice", 0.982)
    return orders.agg(
        rounded(F.lit(cut), 6).alias("threshold"),
        F.count_if(F.col("o_totalprice") >= F.lit(cut)).alias("n_above"),
        F.count(F.lit(1)).alias("n_rows"),
    )


QUANTILE_SQL = f"""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.982) AS t FROM orders)
SELECT {rounded_sql("(SELECT t FROM q)", 6)} AS threshold, count(*) FILTER (o_totalprice >= (SELECT t FROM q)) AS n_above,
       count(*) AS n_rows
FROM orders"""

BASELINE_COLUMNS = ["l_quantity", "l_extendedprice", "tax_returned", "price_net"]


def baseline_stats(spark, sf_dir) -> DataFrame:
    out = agg.baseline_statistics(sparse_lines(spark, sf_dir), BASELINE_COLUMNS)
    values = ["mean", "std", "minimum", "maximum", "q25", "q50", "q75"]
    return out.select(
        F.col("column").alias("column_name"), "n", "n_null", *[rounded(F.col(v), 4).alias(v) for v in values]
    )


BASELINE_SQL = f"WITH {SPARSE_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS n_null, "
    + ", ".join(
        f"{rounded_sql(e, 4)} AS {n}"
        for n, e in {
            "mean": f"avg({c})", "std": f"stddev_samp({c})", "minimum": f"min({c})", "maximum": f"max({c})",
            "q25": f"quantile_cont({c}, 0.25)", "q50": f"quantile_cont({c}, 0.5)", "q75": f"quantile_cont({c}, 0.75)",
        }.items()
    )
    + " FROM sparse"
    for c in BASELINE_COLUMNS
)


def top_values(spark, sf_dir) -> DataFrame:
    out = agg.top_values(load(spark, sf_dir, "part"), "p_brand", 10)
    return out.select(F.col("column").alias("column_name"), "value", F.col("rows").alias("n"))


TOP_SQL = """
SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 10"""

DRIFT_COLUMNS = ["o_totalprice", "o_custkey"]


def drift_psi(spark, sf_dir) -> DataFrame:
    """Orders up to the end of 1999 against later ones."""
    orders = load(spark, sf_dir, "orders").select("o_orderdate", *DRIFT_COLUMNS)
    early = F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")
    out = agg.population_stability(orders.where(early), orders.where(~early), DRIFT_COLUMNS)
    return out.select(F.col("column").alias("column_name"), rounded(F.col("psi"), 8).alias("psi"))


def drift_state(spark, sf_dir) -> DataFrame:
    """Statistics of all orders from the kept states of three years' worth and the rest, which are not read again.

    Medians are sketched; ``median_within`` says whether an exact count of all
    rows finds each within the sketches' bound.
    """
    orders = load(spark, sf_dir, "orders").select("o_orderdate", *DRIFT_COLUMNS)
    root = f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}"
    part = F.least(F.greatest(F.year("o_orderdate"), F.lit(1998)), F.lit(2001))
    for year in range(1998, 2002):
        drift.write_state(orders.where(part == year), root, f"year-{year}", DRIFT_COLUMNS)
    found = drift.state_statistics(drift.read_state(spark, root), [0.5])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in DRIFT_COLUMNS])
    ranks = orders.select(F.inline(cells)).join(found.select("column", "q50"), "column").groupBy("column").agg(
        F.avg((F.col("v") < F.col("q50")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("q50")).cast("double")).alias("upto")
    )
    within = (F.col("below") - drift.RANK_ERROR <= 0.5) & (F.col("upto") + drift.RANK_ERROR >= 0.5)
    both = found.join(ranks, "column").withColumn("median_within", within.cast("int"))
    numbers = [rounded(F.col(v), 4).alias(v) for v in ("mean", "std", "minimum", "maximum")]
    return both.select(F.col("column").alias("column_name"), "n", "n_null", *numbers, "median_within")


DRIFT_STATE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS n_null, {rounded_sql(f'avg({c})', 4)} AS mean,"
    f" {rounded_sql(f'stddev_samp({c})', 4)} AS std, {rounded_sql(f'min({c})', 4)} AS minimum, {rounded_sql(f'max({c})', 4)} AS maximum,"
    f" 1 AS median_within FROM orders"
    for c in DRIFT_COLUMNS
)


def _psi_sql(c: str) -> str:
    bins = " + ".join(f"(CASE WHEN {c} > q[{i}] THEN 1 ELSE 0 END)" for i in range(1, 10))
    return f"""SELECT '{c}' AS column_name, {rounded_sql("sum((b - a) * ln(b / a))", 8)} AS psi FROM (
      SELECT greatest(count(*) FILTER (early) / (SELECT count(*) FROM o WHERE early), 1e-4) AS a,
             greatest(count(*) FILTER (NOT early) / (SELECT count(*) FROM o WHERE NOT early), 1e-4) AS b
      FROM (SELECT early, {bins} AS bin
            FROM o, (SELECT quantile_cont({c}::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM o WHERE early))
      GROUP BY bin)"""


DRIFT_SQL = (
    "WITH o AS (SELECT *, o_orderdate < TIMESTAMP '2000-01-01' AS early FROM orders) "
    + " UNION ALL ".join(_psi_sql(c) for c in DRIFT_COLUMNS)
)


QUERIES = {
    "candidate_keys": candidate_keys,
    "time_column": time_column,
    "relationships": relationships,
    "choose_anchor": choose_anchor,
    "row_id": row_id,
    "feature_schema": feature_schema,
    "schema_check": schema_check,
    "data_quality": data_quality,
    "null_fraction": null_fraction,
    "constant_columns": constant_columns,
    "variance_rank": variance_rank,
    "correlation_pairs": correlation_pairs,
    "quantile_threshold": quantile_threshold,
    "baseline_stats": baseline_stats,
    "top_values": top_values,
    "drift_psi": drift_psi,
    "drift_state": drift_state,
}

ORACLES = {
    "candidate_keys": KEYS_SQL,
    "time_column": TIME_SQL,
    "relationships": RELATIONSHIPS_SQL,
    "choose_anchor": ANCHOR_SQL,
    "row_id": ROW_ID_SQL,
    "feature_schema": SCHEMA_SQL,
    "schema_check": SCHEMA_CHECK_SQL,
    "data_quality": QUALITY_SQL,
    "null_fraction": NULL_SQL,
    "constant_columns": CONSTANT_SQL,
    "variance_rank": VARIANCE_SQL,
    "correlation_pairs": CORRELATION_SQL,
    "quantile_threshold": QUANTILE_SQL,
    "baseline_stats": BASELINE_SQL,
    "top_values": TOP_SQL,
    "drift_psi": DRIFT_SQL,
    "drift_state": DRIFT_STATE_SQL,
}
