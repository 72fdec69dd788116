"""Queries on users, their activity and fraud patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.columns import age_days, quoted
from tributary.operators import aggregates as agg
from tributary.operators import joins, patterns, risk
from tributary.operators.sequence import running_position
from workloads import tables as t
from workloads.tables import load, rounded, rounded_sql, stamp, stamp_sql, with_views


def _inputs(spark: SparkSession, sf_dir: str):
    return t.users(spark, sf_dir), t.transactions(spark, sf_dir), t.logins(spark, sf_dir), t.devices(spark, sf_dir)


def _as_of(spark, sf_dir):
    return t.last_time(load(spark, sf_dir, "orders"), "o_orderdate")


def user_aggregates(spark, sf_dir) -> DataFrame:
    out = risk.user_aggregates(*_inputs(spark, sf_dir), _as_of(spark, sf_dir))
    return out.select(
        "user_id",
        "total_txns",
        rounded(F.col("sum_amount"), 2).alias("sum_amount"),
        rounded(F.col("avg_amount"), 4).alias("avg_amount"),
        rounded(F.col("txn_std"), 4).alias("txn_std"),
        "failed_logins",
        "num_devices",
        "recent_txns",
        rounded(F.col("avg_merchant_risk"), 6).alias("avg_merchant_risk"),
        "account_age_days",
    )


USER_SIGNALS = """
base AS (
  SELECT u.user_id, u.account_type, u.country,
         coalesce(a.total_txns, 0) AS total_txns, coalesce(a.sum_amount, 0) AS sum_amount,
         coalesce(a.avg_amount, 0) AS avg_amount, coalesce(a.txn_std, 0) AS txn_std,
         coalesce(l.failed_logins, 0) AS failed_logins, coalesce(d.num_devices, 0) AS num_devices,
         coalesce(a.recent_txns, 0) AS recent_txns, coalesce(a.avg_merchant_risk, 0) AS avg_merchant_risk,
         coalesce(floor((epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(u.signup_date)) / 86400000000.0), 365.0) AS account_age_days
  FROM users u
  LEFT JOIN (
    SELECT user_id, count(*) AS total_txns, sum(amount) AS sum_amount, avg(amount) AS avg_amount,
           stddev_samp(amount) AS txn_std,
           count(*) FILTER (transaction_time >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY) AS recent_txns,
           avg(merchant_risk) AS avg_merchant_risk
    FROM transactions {where} GROUP BY 1) a USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) AS failed_logins FROM logins WHERE success = 0 GROUP BY 1) l USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) AS num_devices FROM devices GROUP BY 1) d USING (user_id)
)"""

USER_AGGREGATES_SQL = f"""
{with_views("users", "transactions", "logins", "devices")},
{USER_SIGNALS.format(where="")}
SELECT user_id, total_txns, {rounded_sql("sum_amount", 2)} AS sum_amount, {rounded_sql("avg_amount", 4)} AS avg_amount,
       {rounded_sql("txn_std", 4)} AS txn_std, failed_logins, num_devices, recent_txns,
       {rounded_sql("avg_merchant_risk", 6)} AS avg_merchant_risk, account_age_days::DOUBLE AS account_age_days
FROM base"""


def risk_labels(spark, sf_dir) -> DataFrame:
    """Users with score and label, all transactions counted."""
    return risk.risk_score(*_inputs(spark, sf_dir), _as_of(spark, sf_dir))


def risk_score(spark, sf_dir) -> DataFrame:
    return risk_labels(spark, sf_dir).select(
        "user_id",
        "account_type",
        "total_txns",
        rounded(F.col("sum_amount"), 2).alias("sum_amount"),
        "failed_logins",
        "num_devices",
        "recent_txns",
        "account_age_days",
        rounded(F.col("avg_merchant_risk"), 6).alias("avg_merchant_risk"),
        rounded(F.col("score"), 6).alias("score"),
        rounded(F.col("probability"), 6).alias("probability"),
        "is_fraud",
    )


def _norm(c: str) -> str:
    return f"(CASE WHEN m.{c} > 0 THEN b.{c} / (m.{c} + 1e-9::DOUBLE) ELSE 0 END)"


RISK_VIEWS = f"""
{with_views("users", "transactions", "logins", "devices")},
{USER_SIGNALS.format(where="")},
m AS (SELECT {", ".join(f"max({c})::DOUBLE AS {c}" for c in risk.WEIGHTS)} FROM base),
scored AS (
  SELECT b.*, ({" + ".join(f"({w}::DOUBLE) * {_norm(c)}" for c, w in risk.WEIGHTS.items())})
         * (1.0::DOUBLE + 0.8::DOUBLE * ({_norm("recent_txns")} * 0.5::DOUBLE + (1.0::DOUBLE - {_norm("account_age_days")}) * 0.5::DOUBLE)) AS score
  FROM base b, m),
prob AS (
  SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-((score - (SELECT avg(score) FROM scored)) * 3.0::DOUBLE))) AS probability
  FROM scored),
labelled AS (
  SELECT *, CASE WHEN probability >= (SELECT quantile_cont(probability, 0.982) FROM prob) THEN 1 ELSE 0 END AS is_fraud
  FROM prob)"""

RISK_SQL = f"""
{RISK_VIEWS}
SELECT user_id, account_type, total_txns, {rounded_sql("sum_amount", 2)} AS sum_amount, failed_logins, num_devices,
       recent_txns, account_age_days::DOUBLE AS account_age_days,
       {rounded_sql("avg_merchant_risk", 6)} AS avg_merchant_risk, {rounded_sql("score", 6)} AS score,
       {rounded_sql("probability", 6)} AS probability, is_fraud
FROM labelled"""


def tx_aggregates(spark, sf_dir) -> DataFrame:
    tx = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("amount"))
    out = agg.amount_aggregates(tx, "user_id", "amount")
    return out.select(
        "user_id",
        "total_txns",
        rounded(F.col("sum_amount"), 2).alias("sum_amount"),
        rounded(F.col("avg_amount"), 4).alias("avg_amount"),
        rounded(F.col("txn_std"), 4).alias("txn_std"),
    )


TX_AGGREGATES_SQL = f"""
SELECT o_custkey AS user_id, count(*) AS total_txns, {rounded_sql("sum(o_totalprice)", 2)} AS sum_amount,
       {rounded_sql("avg(o_totalprice)", 4)} AS avg_amount,
       {rounded_sql("coalesce(stddev_samp(o_totalprice), 0)", 4)} AS txn_std
FROM orders GROUP BY 1"""


def failed_logins(spark, sf_dir) -> DataFrame:
    return agg.count_where(t.logins(spark, sf_dir), "user_id", F.col("success") == 0, "failed_logins")


def group_size(spark, sf_dir) -> DataFrame:
    return agg.group_size(t.devices(spark, sf_dir), "user_id", "num_devices")


def recent_counts(spark, sf_dir) -> DataFrame:
    out = risk.recent_activity(t.transactions(spark, sf_dir), _as_of(spark, sf_dir))
    return out.select("user_id", "recent_txns", rounded(F.col("avg_merchant_risk"), 6).alias("avg_merchant_risk"))


RECENT_SQL = f"""
{with_views("transactions")}
SELECT user_id,
       count(*) FILTER (transaction_time >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY) AS recent_txns,
       {rounded_sql("coalesce(avg(merchant_risk), 0)", 6)} AS avg_merchant_risk
FROM transactions GROUP BY 1"""


def account_age(spark, sf_dir) -> DataFrame:
    as_of = _as_of(spark, sf_dir)
    return t.users(spark, sf_dir).select("user_id", age_days(F.col("signup_date"), as_of).alias("account_age_days"))


ACCOUNT_AGE_SQL = f"""
{with_views("users")}
SELECT user_id, coalesce(date_diff('day', signup_date, (SELECT max(o_orderdate) FROM orders)), 365)::DOUBLE AS account_age_days
FROM users"""


def merchant_lookup(spark, sf_dir) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("merchant_id"), "l_extendedprice"
    )
    out = joins.dimension_lookup(lines, t.merchants(spark, sf_dir), "merchant_id", ["merchant_name", "merchant_risk"])
    return out.withColumn("merchant_risk", rounded(F.col("merchant_risk"), 6))


MERCHANT_LOOKUP_SQL = f"""
{with_views("merchants")}
SELECT l_orderkey, l_suppkey AS merchant_id, l_extendedprice, merchant_name, {rounded_sql("merchant_risk", 6)} AS merchant_risk
FROM lineitem LEFT JOIN merchants ON merchant_id = l_suppkey"""


def label_as_of(spark, sf_dir) -> DataFrame:
    tx = t.transactions(spark, sf_dir).select("transaction_id", "transaction_time")
    as_of = F.lit("2001-03-31 00:00:00").cast("timestamp")
    out = joins.label_as_of(
        tx, t.chargebacks(spark, sf_dir), "transaction_id", "transaction_time", "reported_date", as_of
    )
    return out.select("transaction_id", stamp(F.col("transaction_time")).alias("transaction_time"), "label", "mature")


LABEL_AS_OF_SQL = f"""
{with_views("transactions", "chargebacks")}
SELECT x.transaction_id, {stamp_sql("x.transaction_time")} AS transaction_time,
       CASE WHEN c.transaction_id IS NOT NULL THEN 1 ELSE 0 END AS label,
       CASE WHEN x.transaction_time + INTERVAL 90 DAY <= TIMESTAMP '2001-03-31' THEN 1 ELSE 0 END AS mature
FROM transactions x
LEFT JOIN (SELECT DISTINCT transaction_id FROM chargebacks WHERE reported_date <= TIMESTAMP '2001-03-31') c
  ON c.transaction_id = x.transaction_id
WHERE x.transaction_time <= TIMESTAMP '2001-03-31'"""


def attach_device(spark, sf_dir) -> DataFrame:
    tx = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("user_id")
    )
    return agg.attach_one(tx, "transaction_id", "user_id", t.devices(spark, sf_dir), "device_id")


_PICK = "('42:' || o_orderkey)"
ATTACH_SQL = f"""
{with_views("devices")},
numbered AS (
  SELECT user_id, device_id, row_number() OVER (PARTITION BY user_id ORDER BY device_id) - 1 AS place,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM devices)
SELECT o_orderkey AS transaction_id, o_custkey AS user_id,
       CASE WHEN {t.md5_number_sql(_PICK)} < {int(0.7 * (1 << 32))} THEN device_id END AS device_id
FROM orders
LEFT JOIN numbered ON user_id = o_custkey AND place = {t.md5_number_sql(_PICK, 9)} % n"""


def running_count(spark, sf_dir) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = running_position(orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    return out.select(
        "o_orderkey", "o_custkey", "position", (F.col("position") % 50 == 0).cast("int").alias("every_50th")
    )


RUNNING_SQL = """
SELECT o_orderkey, o_custkey, position, CASE WHEN position % 50 = 0 THEN 1 ELSE 0 END AS every_50th
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)"""


def shared_devices(spark, sf_dir) -> DataFrame:
    return patterns.shared_devices(t.shared_lines(spark, sf_dir), "device_id", "user_id")


SHARED_SQL = f"""
{with_views("shared_lines")}
SELECT device_id AS device, count(DISTINCT user_id) AS n_users FROM shared_lines GROUP BY 1 HAVING count(DISTINCT user_id) >= 2"""


def rings(spark, sf_dir) -> DataFrame:
    return patterns.rings(t.shared_lines(spark, sf_dir), "device_id", "user_id").withColumnRenamed("user", "user_id")


RINGS_SQL = f"""
{with_views("shared_lines", recursive=True)},
edges AS (
  SELECT DISTINCT a.user_id AS a, b.user_id AS b
  FROM shared_lines a JOIN shared_lines b ON a.device_id = b.device_id AND a.user_id <> b.user_id),
reach(a, b) AS (
  SELECT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT a AS user_id, min(b) AS ring FROM reach GROUP BY a"""


def velocity_bursts(spark, sf_dir) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    out = patterns.velocity_bursts(events, "user_id", "ts", "event_id", count=2, seconds=1800)
    return out.select("event_id", "user_id", F.unix_micros("ts").alias("ts_micros"), "n_in_span")


VELOCITY_SQL = """
SELECT * FROM (
  SELECT event_id, user_id, epoch_us(ts) AS ts_micros,
         count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS n_in_span
  FROM events)
WHERE n_in_span >= 2"""


def takeover(spark, sf_dir) -> DataFrame:
    out = patterns.takeovers(
        t.logins(spark, sf_dir), "user_id", "login_time", "login_id", "success", failures=3, seconds=86_400
    )
    return out.select("login_id", "user_id", F.unix_micros("login_time").alias("login_micros"), "n_failed")


TAKEOVER_SQL = f"""
{with_views("logins")}
SELECT login_id, user_id, login_micros, n_failed FROM (
  SELECT login_id, user_id, success, epoch_us(login_time) AS login_micros,
         CAST(coalesce(sum(1 - success) OVER (PARTITION BY user_id ORDER BY epoch_us(login_time)
             RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_failed
  FROM logins)
WHERE success = 1 AND n_failed >= 3"""


def merchant_concentration(spark, sf_dir) -> DataFrame:
    tx = t.transactions(spark, sf_dir).where("merchant_id is not null")
    out = patterns.merchant_concentration(tx, "merchant_id", "amount", "merchant_risk")
    return out.select(
        "merchant_id",
        "n_txns",
        rounded(F.col("amount"), 2).alias("amount"),
        rounded(F.col("share"), 8).alias("share"),
        rounded(F.col("mean_risk"), 6).alias("mean_risk"),
        "high_risk",
    )


MERCHANT_SQL = f"""
{with_views("transactions")},
known AS (SELECT * FROM transactions WHERE merchant_id IS NOT NULL)
SELECT merchant_id, count(*) AS n_txns, {rounded_sql("sum(amount)", 2)} AS amount,
       {rounded_sql("sum(amount) / (SELECT sum(amount) FROM known)", 8)} AS share,
       {rounded_sql("avg(merchant_risk)", 6)} AS mean_risk,
       CASE WHEN avg(merchant_risk) >= 0.8 THEN 1 ELSE 0 END AS high_risk
FROM known GROUP BY 1"""


def category_concentration(spark, sf_dir) -> DataFrame:
    """Volume and risk of merchants in their category, and of categories, in one grouping."""
    merchants = t.merchants(spark, sf_dir).select("merchant_id", "merchant_category")
    tx = t.transactions(spark, sf_dir).where("merchant_id is not null").join(merchants, "merchant_id", "left")
    out = patterns.merchant_concentration(tx, "merchant_id", "amount", "merchant_risk", category="merchant_category")
    return out.select(
        "level",
        "merchant_id",
        "merchant_category",
        "n_txns",
        rounded(F.col("amount"), 2).alias("amount"),
        rounded(F.col("share"), 8).alias("share"),
        rounded(F.col("mean_risk"), 6).alias("mean_risk"),
        "high_risk",
    )


CATEGORY_SQL = f"""
{with_views("transactions", "merchants")},
known AS (SELECT x.*, m.merchant_category FROM transactions x LEFT JOIN merchants m USING (merchant_id) WHERE x.merchant_id IS NOT NULL),
per AS (
  SELECT 'merchant' AS level, merchant_id, merchant_category, count(*) AS n_txns, sum(amount) AS amount, avg(merchant_risk) AS risk
  FROM known GROUP BY 2, 3
  UNION ALL
  SELECT 'category', NULL, merchant_category, count(*), sum(amount), avg(merchant_risk) FROM known GROUP BY 3)
SELECT level, merchant_id, merchant_category, n_txns, {rounded_sql("amount", 2)} AS amount,
       {rounded_sql("amount / (SELECT sum(amount) FROM known)", 8)} AS share, {rounded_sql("risk", 6)} AS mean_risk,
       CASE WHEN risk >= 0.8 THEN 1 ELSE 0 END AS high_risk
FROM per"""


def near_duplicates(spark, sf_dir) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    return patterns.near_duplicates(parts, "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


NEAR_DUPLICATES_SQL = """
SELECT sha256(concat_ws(chr(31), p_name, p_brand, p_type, CAST(p_size AS VARCHAR))) AS digest, count(*) AS copies,
       min(p_partkey) AS first_key, max(p_partkey) AS last_key
FROM part GROUP BY p_name, p_brand, p_type, p_size HAVING count(*) > 1"""


LEAK_COLUMNS = ["total", "hint", "opposite", "flag"]


def leakage_scan(spark, sf_dir) -> DataFrame:
    """Two columns that give the label away are planted next to two that do not."""
    orders = load(spark, sf_dir, "orders")
    label = (F.col("o_orderstatus") == "F").cast("int")
    frame = orders.select(
        label.alias("label"),
        F.col("o_totalprice").alias("total"),
        F.when(F.col("o_orderpriority") == "1-URGENT", label).alias("hint"),
        (F.lit(1) - label).alias("opposite"),
        (F.col("o_totalprice") > 250000).cast("int").alias("flag"),
    )
    out = patterns.leakage_scan(frame, "label", LEAK_COLUMNS)
    return out.select(
        F.col("column").alias("column_name"),
        "n",
        rounded(F.col("correlation"), 6).alias("correlation"),
        rounded(F.col("agreement"), 6).alias("agreement"),
        "suspect",
    )


LEAKAGE_SQL = f"""
WITH f AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice AS total,
         CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END END AS hint,
         CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS opposite,
         CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS flag
  FROM orders),
s AS (
{" UNION ALL ".join(f'''SELECT '{c}' AS column_name, count({c}) AS n, abs(corr({c}::DOUBLE, label::DOUBLE)) AS correlation,
  greatest(avg(CASE WHEN {c} = label THEN 1.0 ELSE 0.0 END) FILTER ({c} IS NOT NULL),
           avg(CASE WHEN {c} = 1 - label THEN 1.0 ELSE 0.0 END) FILTER ({c} IS NOT NULL)) AS agreement FROM f''' for c in LEAK_COLUMNS)})
SELECT column_name, n, {rounded_sql("correlation", 6)} AS correlation, {rounded_sql("agreement", 6)} AS agreement,
       CASE WHEN correlation >= 0.95 OR agreement >= 0.95 THEN 1 ELSE 0 END AS suspect
FROM s"""


def dataset_report(spark, sf_dir) -> DataFrame:
    frames = {
        "users": risk_labels(spark, sf_dir),
        "merchants": t.merchants(spark, sf_dir),
        "transactions": load(spark, sf_dir, "orders"),
        "logins": t.logins(spark, sf_dir),
        "devices": t.devices(spark, sf_dir),
        "chargebacks": t.chargebacks(spark, sf_dir),
    }
    out = joins.dataset_report(frames, "users", "is_fraud")
    return out.select("metric", rounded(quoted("value"), 6).alias("value"))


DATASET_SQL = f"""
{RISK_VIEWS}
SELECT 'n_users' AS metric, count(*)::DOUBLE AS value FROM labelled
UNION ALL SELECT 'n_merchants', count(*)::DOUBLE FROM supplier
UNION ALL SELECT 'n_transactions', count(*)::DOUBLE FROM orders
UNION ALL SELECT 'n_logins', count(*)::DOUBLE FROM events
UNION ALL SELECT 'n_devices', count(*)::DOUBLE FROM devices
UNION ALL SELECT 'n_chargebacks', count(*)::DOUBLE FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'label_rate', {rounded_sql("avg(is_fraud)", 6)} FROM labelled"""


QUERIES = {
    "risk_score": risk_score,
    "user_aggregates": user_aggregates,
    "tx_aggregates": tx_aggregates,
    "failed_logins": failed_logins,
    "group_size": group_size,
    "recent_counts": recent_counts,
    "account_age": account_age,
    "merchant_lookup": merchant_lookup,
    "label_as_of": label_as_of,
    "attach_device": attach_device,
    "running_count": running_count,
    "shared_devices": shared_devices,
    "rings": rings,
    "velocity_bursts": velocity_bursts,
    "takeover": takeover,
    "merchant_concentration": merchant_concentration,
    "category_concentration": category_concentration,
    "near_duplicates": near_duplicates,
    "leakage_scan": leakage_scan,
    "dataset_report": dataset_report,
}

ORACLES = {
    "risk_score": RISK_SQL,
    "user_aggregates": USER_AGGREGATES_SQL,
    "tx_aggregates": TX_AGGREGATES_SQL,
    "failed_logins": "SELECT user_id, count(*) AS failed_logins FROM events WHERE event_type = 'error' GROUP BY 1",
    "group_size": f"{with_views('devices')} SELECT user_id, count(*) AS num_devices FROM devices GROUP BY 1",
    "recent_counts": RECENT_SQL,
    "account_age": ACCOUNT_AGE_SQL,
    "merchant_lookup": MERCHANT_LOOKUP_SQL,
    "label_as_of": LABEL_AS_OF_SQL,
    "attach_device": ATTACH_SQL,
    "running_count": RUNNING_SQL,
    "shared_devices": SHARED_SQL,
    "rings": RINGS_SQL,
    "velocity_bursts": VELOCITY_SQL,
    "takeover": TAKEOVER_SQL,
    "merchant_concentration": MERCHANT_SQL,
    "category_concentration": CATEGORY_SQL,
    "near_duplicates": NEAR_DUPLICATES_SQL,
    "leakage_scan": LEAKAGE_SQL,
    "dataset_report": DATASET_SQL,
}
