"""Queries on sources, sinks, fingerprints and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import columns as c
from tributary.operators import aggregates as agg
from tributary.operators import joins
from tributary.session import shared_dir
from tributary.sources import accounts, fingerprint, tables
from workloads.tables import (
    TABLE_NAMES,
    load,
    load_all,
    md5_number_sql,
    rounded,
    rounded_sql,
    stamp,
    stamp_sql,
)


def discover_tables(spark, sf_dir) -> DataFrame:
    return tables.table_summary(spark, sf_dir).withColumnRenamed("table", "table_name")


def file_accounts(spark, sf_dir) -> DataFrame:
    """Rows of every table by what became of its files; broken or cut files would have rows of their own."""
    found = accounts.account_files(spark, sf_dir)
    return found.groupBy(F.col("table").alias("table_name"), "status").agg(F.sum("rows").alias("n_rows"))


FILE_ACCOUNTS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS table_name, 'read' AS status, count(*) AS n_rows FROM {n}" for n in TABLE_NAMES)


def row_estimates(spark, sf_dir) -> DataFrame:
    """Rows of every table from the footers of its files."""
    found = accounts.load_guard(accounts.estimate_rows(spark, sf_dir), 1 << 40)
    return found.select(F.col("table").alias("table_name"), F.col("rows").alias("n_rows"), "low", "high", "method")


ROW_ESTIMATES_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(*) AS low, count(*) AS high, 'footers' AS method FROM {n}" for n in TABLE_NAMES
)


def file_digests(spark, sf_dir) -> DataFrame:
    """The hash tree's root of every file's contents."""
    found = fingerprint.file_tokens(spark, sf_dir, "sha256")
    return found.select(F.col("table").alias("table_name"), "relative_path", "token", "size")


def written_features(spark, sf_dir) -> DataFrame:
    """Orders as a feature table that is written whole and read back."""
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    tables.write_features(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return tables.read_table(spark, path)


def drop_columns(spark, sf_dir) -> DataFrame:
    """Customers without their name, nor anything that ends in a balance."""
    return c.drop_columns(load(spark, sf_dir, "customer"), ["c_name"], suffix="bal")


def csv_roundtrip(spark, sf_dir) -> DataFrame:
    """Orders written as CSV and read back with their schema."""
    orders = load(spark, sf_dir, "orders")
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(orders, path)
    return tables.read_csv(spark, path, orders.schema).withColumn("o_orderdate", stamp(F.col("o_orderdate")))


CSV_SQL = f"SELECT * REPLACE ({stamp_sql('o_orderdate')} AS o_orderdate) FROM orders"


def sample_rows(spark, sf_dir) -> DataFrame:
    return tables.sample_rows(load(spark, sf_dir, "orders"), 200, "o_orderkey").select("o_orderkey", "o_totalprice")


SAMPLE_SQL = f"""
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY {md5_number_sql("'42:' || o_orderkey")}, o_orderkey LIMIT 200"""


def row_guard(spark, sf_dir) -> DataFrame:
    return tables.size_report(load_all(spark, sf_dir), 50_000).withColumnRenamed("table", "table_name")


ROW_GUARD_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, CASE WHEN count(*) <= 50000 THEN 1 ELSE 0 END AS within_cap FROM {n}"
    for n in TABLE_NAMES
)


def file_manifest(spark, sf_dir) -> DataFrame:
    return fingerprint.file_manifest(spark, sf_dir).withColumnRenamed("table", "table_name")


def data_fingerprint(spark, sf_dir) -> DataFrame:
    return fingerprint.data_fingerprint(spark, sf_dir)


def content_fingerprint(spark, sf_dir) -> DataFrame:
    return fingerprint.content_fingerprint(load(spark, sf_dir, "orders"))


_PIECES = ", ".join(
    f"CAST(coalesce(sum(CAST('0x' || substr(d, {s}, 8) AS BIGINT)), 0) AS HUGEINT) AS s{i}"
    for i, s in enumerate((1, 9, 17, 25))
)
CONTENT_SQL = f"""
WITH r AS (
  SELECT md5(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), {stamp_sql("o_orderdate")}, CAST(o_orderkey AS VARCHAR),
             o_orderpriority, o_orderstatus, CAST(o_totalprice AS VARCHAR))) AS d FROM orders),
s AS (SELECT count(*) AS n_rows, {_PIECES} FROM r)
SELECT n_rows, sha256(concat_ws(':', CAST(n_rows AS VARCHAR), CAST(s0 AS VARCHAR), CAST(s1 AS VARCHAR),
       CAST(s2 AS VARCHAR), CAST(s3 AS VARCHAR))) AS fingerprint
FROM s"""


def union_rows(spark, sf_dir) -> DataFrame:
    """Customers and suppliers under common names; suppliers have no segment."""
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return tables.union_rows(customers, suppliers)


UNION_SQL = """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier"""


def parse_ts(spark, sf_dir) -> DataFrame:
    """Order dates as text in every known layout, with junk between them."""
    ts, which = F.col("o_orderdate"), F.col("o_orderkey") % 8
    text = (
        F.when(which == 0, F.date_format(ts, "yyyy.MM.dd HH:mm:ss"))
        .when(which == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(which == 2, F.date_format(ts, "MMM dd yyyy HH:mm:ss"))
        .when(which == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(which == 4, F.lit(""))
        .when(which == 5, F.lit("not a date"))
        .when(which == 6, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    orders = load(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return orders.select("o_orderkey", stamp(c.parse_ts(F.col("text"))).alias("parsed"))


PARSE_SQL = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (4, 5) THEN NULL ELSE {stamp_sql("o_orderdate")} END AS parsed FROM orders"""


def to_number(spark, sf_dir) -> DataFrame:
    """Amounts as text, some of it no number."""
    text = (
        F.when(F.col("event_type") == "error", F.lit("n/a"))
        .when(F.col("event_type") == "view", F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
        .when(F.col("event_type") == "signup", F.lit("NaN"))
        .otherwise(F.col("value").cast("string"))
    )
    events = load(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return events.select("event_id", c.to_number(F.col("text")).alias("number"))


TO_NUMBER_SQL = "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS number FROM events"


def fill_defaults(spark, sf_dir) -> DataFrame:
    """All orders, counted for the even customers next below; odd customers have none and get constants."""
    buyer = F.col("o_custkey") - F.col("o_custkey") % 2
    spent = load(spark, sf_dir, "orders").groupBy(buyer.alias("buyer")).agg(
        F.count("*").alias("n_orders"), F.max("o_totalprice").alias("largest"), F.max("o_orderpriority").alias("priority")
    )
    joined = load(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("buyer"), "left")
    picked = joined.select("c_custkey", "n_orders", "largest", "priority")
    return c.fill(picked, {"n_orders": 0, "largest": 365.0, "priority": "none"})


FILL_SQL = """
SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(largest, 365.0) AS largest, coalesce(priority, 'none') AS priority
FROM customer LEFT JOIN (
  SELECT o_custkey - o_custkey % 2 AS buyer, count(*) AS n, max(o_totalprice) AS largest, max(o_orderpriority) AS priority
  FROM orders GROUP BY 1) ON buyer = c_custkey"""


def dedupe(spark, sf_dir) -> DataFrame:
    """One line per order and line number, which repeat."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    out = agg.dedupe(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.withColumn("l_shipdate", stamp(F.col("l_shipdate")))


DEDUPE_SQL = f"""
SELECT l_orderkey, l_linenumber, {stamp_sql("l_shipdate")} AS l_shipdate, l_partkey, l_suppkey, l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
WHERE n = 1"""


def clip(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        "c_custkey", c.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("balance")
    )


def logistic(spark, sf_dir) -> DataFrame:
    scaled = (F.col("c_acctbal") - 4500.0) / 3000.0
    return load(spark, sf_dir, "customer").select("c_custkey", rounded(c.logistic(scaled), 8).alias("p"))


LOGISTIC_SQL = f"""
SELECT c_custkey, {rounded_sql("1.0 / (1.0 + exp(-((c_acctbal - 4500.0::DOUBLE) / 3000.0::DOUBLE)))", 8)} AS p FROM customer"""


def _addresses(spark, sf_dir) -> DataFrame:
    nation = F.col("c_nationkey")
    at = F.when(nation == 0, "").when(nation == 1, "@home@").otherwise("@")
    address = F.concat(F.col("c_name"), at, F.lower("c_mktsegment"), F.lit(".com"))
    return load(spark, sf_dir, "customer").select("c_custkey", address.alias("email"))


def email_domain(spark, sf_dir) -> DataFrame:
    return _addresses(spark, sf_dir).select("c_custkey", c.email_domain(F.col("email")).alias("domain"))


EMAIL_SQL = "SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN lower(c_mktsegment) || '.com' END AS domain FROM customer"


def protect_pii(spark, sf_dir) -> DataFrame:
    customers = load(spark, sf_dir, "customer").drop("c_acctbal")
    hashed = c.protect_pii(customers, ["c_name"], salt="pepper")
    return c.protect_pii(hashed, ["c_nationkey"], hashed=False)


def encode_categories(spark, sf_dir) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return joins.encode_categories(orders, ["o_orderpriority", "o_orderstatus"])


ENCODE_SQL = """
SELECT o_orderkey, o_orderpriority, o_orderstatus,
       dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_code,
       dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus_code
FROM orders"""


def dfs_transforms(spark, sf_dir) -> DataFrame:
    """Calendar parts of every event, text counts of its properties."""
    parts = {**c.datetime_parts(F.col("ts")), **c.text_counts(F.col("props"))}
    return load(spark, sf_dir, "events").select("event_id", *[e.alias(n.lower()) for n, e in parts.items()])


TRANSFORMS_SQL = """
SELECT event_id, CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month,
       CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(year(ts) AS INTEGER) AS year,
       CAST(length(props) AS INTEGER) AS num_characters,
       CAST(length(regexp_extract_all(props, '[^ \\t\\n\\r\\f\\v]+')) AS INTEGER) AS num_words
FROM events"""


def text_counts(spark, sf_dir) -> DataFrame:
    """Counts over whole document texts."""
    counts = c.text_counts(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", *[e.alias(n.lower()) for n, e in counts.items()])


TEXT_SQL = """
SELECT doc_id, CAST(length(text) AS INTEGER) AS num_characters,
       CAST(length(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS INTEGER) AS num_words
FROM documents"""


QUERIES = {
    "discover_tables": discover_tables,
    "file_accounts": file_accounts,
    "row_estimates": row_estimates,
    "file_digests": file_digests,
    "written_features": written_features,
    "drop_columns": drop_columns,
    "csv_roundtrip": csv_roundtrip,
    "sample_rows": sample_rows,
    "row_guard": row_guard,
    "file_manifest": file_manifest,
    "data_fingerprint": data_fingerprint,
    "content_fingerprint": content_fingerprint,
    "union_rows": union_rows,
    "parse_ts": parse_ts,
    "to_number": to_number,
    "fill_defaults": fill_defaults,
    "dedupe": dedupe,
    "clip": clip,
    "logistic": logistic,
    "email_domain": email_domain,
    "protect_pii": protect_pii,
    "encode_categories": encode_categories,
    "dfs_transforms": dfs_transforms,
    "text_counts": text_counts,
}

ORACLES = {
    "file_accounts": FILE_ACCOUNTS_SQL,
    "row_estimates": ROW_ESTIMATES_SQL,
    "written_features": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders",
    "drop_columns": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "csv_roundtrip": CSV_SQL,
    "sample_rows": SAMPLE_SQL,
    "row_guard": ROW_GUARD_SQL,
    "content_fingerprint": CONTENT_SQL,
    "union_rows": UNION_SQL,
    "parse_ts": PARSE_SQL,
    "to_number": TO_NUMBER_SQL,
    "fill_defaults": FILL_SQL,
    "dedupe": DEDUPE_SQL,
    "clip": "SELECT c_custkey, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS balance FROM customer",
    "logistic": LOGISTIC_SQL,
    "email_domain": EMAIL_SQL,
    "protect_pii": "SELECT c_custkey, sha256('pepper' || c_name) AS c_name, c_mktsegment FROM customer",
    "encode_categories": ENCODE_SQL,
    "dfs_transforms": TRANSFORMS_SQL,
    "text_counts": TEXT_SQL,
}
