"""The given tables, and the users, transactions, logins ... they stand in for.

Every Spark view here has its SQL twin in ``FRAUD_VIEWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.columns import clip
from tributary.operators.joins import dimension_lookup
from tributary.session import configure
from tributary.sources.tables import read_table

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_loaded: dict[tuple[str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; files are listed and the schema is read once per application."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _loaded:
        configure(spark)
        _loaded[known] = read_table(spark, path)
    return _loaded[known]


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: load(spark, sf_dir, name) for name in TABLE_NAMES}


def rounded(value: Column, digits: int) -> Column:
    """Round half-way cases down a little, so that the last bits of a sum do not decide."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * F.lit(scale) + F.lit(0.4997)) / F.lit(scale)


def rounded_sql(value: str, digits: int) -> str:
    scale = f"{10**digits}.0"
    return f"(floor(({value})::DOUBLE * {scale} + 0.4997) / {scale})"


def stamp(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def md5_number_sql(text: str, start: int = 1, length: int = 8) -> str:
    return f"CAST('0x' || substr(md5({text}), {start}, {length}) AS BIGINT)"


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers; a low account balance stands for risk."""
    risk = clip(F.lit(1.0) - (F.col("s_acctbal") + 1000.0) / 11000.0, 0.0, 1.0)
    return load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("merchant_id"),
        F.col("s_name").alias("merchant_name"),
        F.col("s_nationkey").alias("merchant_category"),
        risk.alias("merchant_risk"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; the merchant is the first supplier among the order's lines."""
    first = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line_order")).agg(
        F.min("l_suppkey").alias("merchant_id")
    )
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("transaction_time"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
    )
    with_merchant = orders.join(first, F.col("transaction_id") == F.col("line_order"), "left").drop("line_order")
    return dimension_lookup(with_merchant, merchants(spark, sf_dir), "merchant_id", ["merchant_risk"])


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; sign-up is the first order."""
    first = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("buyer")).agg(
        F.min("o_orderdate").alias("signup_date")
    )
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("account_type"),
        F.col("c_nationkey").alias("country"),
        F.col("c_acctbal").alias("income"),
    )
    return customers.join(first, F.col("user_id") == F.col("buyer"), "left").drop("buyer")


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events; an error stands for a failed login."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("login_id"),
        "user_id",
        F.col("ts").alias("login_time"),
        (F.col("event_type") != "error").cast("int").alias("success"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct devices per user; the number in an event's properties is the device."""
    device = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return load(spark, sf_dir, "events").select(device.alias("device_id"), "user_id").distinct()


def chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are charged back 30 to 90 days later."""
    orders = load(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    delay = (F.lit(30) + F.col("o_orderkey") % 61).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        (F.col("o_orderdate") + F.make_dt_interval(days=delay)).alias("reported_date"),
    )


def last_time(df: DataFrame, column: str) -> Column:
    """The latest time of a column as a constant, in place of a wall clock."""
    micros = df.agg(F.max(F.unix_micros(F.col(column).cast("timestamp"))).alias("m")).first()["m"]
    return F.timestamp_micros(F.lit(micros))


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-device edges: buying the same part shipped on the same day stands for sharing a device."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat_ws("/", F.col("l_partkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("device_id")
    )
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("device_id", "user_id")


# The same views for the SQL check, by name.
FRAUD_VIEWS = {
    "merchants": """
        SELECT s_suppkey AS merchant_id, s_name AS merchant_name, s_nationkey AS merchant_category,
               greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (s_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE)) AS merchant_risk
        FROM supplier""",
    "transactions": """
        SELECT o_orderkey AS transaction_id, o_custkey AS user_id, o_orderdate AS transaction_time,
               o_totalprice AS amount, o_orderstatus AS status, f.merchant_id, m.merchant_risk
        FROM orders
        LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS merchant_id FROM lineitem GROUP BY 1) f ON f.l_orderkey = o_orderkey
        LEFT JOIN merchants m ON m.merchant_id = f.merchant_id""",
    "users": """
        SELECT c_custkey AS user_id, c_mktsegment AS account_type, c_nationkey AS country, c_acctbal AS income,
               f.signup_date
        FROM customer
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS signup_date FROM orders GROUP BY 1) f ON f.o_custkey = c_custkey""",
    "logins": """
        SELECT event_id AS login_id, user_id, ts AS login_time,
               CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS success
        FROM events""",
    "devices": """
        SELECT DISTINCT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS device_id, user_id FROM events""",
    "chargebacks": """
        SELECT o_orderkey AS transaction_id,
               o_orderdate + to_days(CAST(30 + o_orderkey % 61 AS INTEGER)) AS reported_date
        FROM orders WHERE o_orderstatus = 'F'""",
    "shared_lines": """
        SELECT CAST(l_partkey AS VARCHAR) || '/' || strftime(l_shipdate, '%Y-%m-%d') AS device_id, o_custkey AS user_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named views, in dependency order, ending in a comma if asked for more."""
    wanted = [n for n in FRAUD_VIEWS if n in names or (n == "merchants" and "transactions" in names)]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({FRAUD_VIEWS[n]})" for n in wanted)
