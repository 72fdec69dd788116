import pytest
from pyspark.sql import functions as F

from tributary.functions.columns import MICROS_PER_DAY
from tributary.operators import patterns as p
from tributary.operators import risk


def at(seconds):
    return F.timestamp_micros((seconds * 1_000_000).cast("bigint"))


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_ten_in_half_an_hour_is_a_burst(spark, hot_rows):
    rows = [(1, 200 * i) for i in range(10)] + [(2, 200 * i) for i in range(9)] + [(2, 1801)] + [(3, 225 * i) for i in range(10)]
    tx = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "id int, u int, s int").withColumn("at", at(F.col("s")))
    found = p.velocity_bursts(tx, "u", "at", "id", hot_rows=hot_rows).collect()
    # User 1: ten in exactly 1,800 s. User 2: the tenth is a second late. User 3: over 2,025 s.
    assert [(r["u"], r["s"], r["n_in_span"]) for r in found] == [(1, 1800, 10)]


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_success_after_three_failures(spark, hot_rows):
    rows = [
        (1, 0, 0), (1, 100, 0), (1, 300, 0), (1, 360, 1),  # the first failure is exactly 360 s back
        (2, 0, 0), (2, 100, 0), (2, 300, 0), (2, 361, 1),  # a second too late
        (3, 0, 0), (3, 1, 0), (3, 2, 0), (3, 2, 1),        # at the same instant as a failure
        (4, 0, 0), (4, 1, 0), (4, 2, 1), (4, 3, 0),
    ]
    logins = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, u int, s int, ok int").withColumn("at", at(F.col("s")))
    found = p.takeovers(logins, "u", "at", "id", "ok", hot_rows=hot_rows).collect()
    assert [(r["u"], r["s"], r["n_failed"]) for r in found] == [(1, 360, 3)]


def groups_by_search(edges):
    by_device, by_user = {}, {}
    for d, u in edges:
        by_device.setdefault(d, set()).add(u)
        by_user.setdefault(u, set()).add(d)
    out, seen = {}, set()
    for start in sorted(by_user):
        if start in seen:
            continue
        group, todo = set(), [start]
        while todo:
            u = todo.pop()
            if u not in group:
                group.add(u)
                todo += [v for d in by_user[u] for v in by_device[d]]
        seen |= group
        if len(group) > 1:
            out.update({u: start for u in group})
    return out


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_rings_hubs_and_chains(spark, hot_rows):
    edges = [("hub", u) for u in range(100, 160)]
    edges += [(f"c{i}", 200 + i) for i in range(30)] + [(f"c{i}", 201 + i) for i in range(30)]  # a chain
    edges += [("x", 1), ("x", 2), ("y", 2), ("y", 3), ("solo", 50), ("z", 155), ("z", 7), (None, 3), ("x", None)]
    df = spark.createDataFrame(edges + edges[:5], "device string, user bigint")
    found = {r["user"]: r["ring"] for r in p.rings(df, "device", "user", hot_rows=hot_rows).collect()}
    assert found == groups_by_search([e for e in edges if None not in e])
    shared = {r["device"]: r["n_users"] for r in p.shared_devices(df, "device", "user").collect()}
    assert shared["hub"] == 60 and "solo" not in shared


def test_copies(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "b"), (4, "ab", None)], "id int, x string, y string")
    assert [(r["copies"], r["first_key"], r["last_key"]) for r in p.near_duplicates(df, "id", ["x", "y"]).collect()] == [(2, 1, 2)]


def test_leaks(spark):
    df = spark.range(200).select(
        (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") < 10, F.col("id") % 2).alias("hint"),
        (F.col("id") % 2 * -3 + 1).alias("linear"),
        F.floor(F.col("id") / 2).alias("free"),
        F.lit(4).alias("flat"),
    )
    found = {r["column"]: r["suspect"] for r in p.leakage_scan(df, "label").collect()}
    assert found == {"hint": 1, "linear": 1, "free": 0, "flat": 0}


@pytest.mark.parametrize(("n", "flagged"), [(505, 10), (5_050, 91)])
def test_known_label_rates(spark, n, flagged):
    """The label rates published for the two sample data sets."""
    users = spark.range(n).select(F.col("id").alias("user_id"), F.timestamp_micros(F.col("id") * 3_600_000_000).alias("signup_date"))
    tx = spark.range(n * 4).select(
        (F.xxhash64("id") % n).alias("user_id"),
        F.timestamp_micros(F.col("id") * 7_000_000_000).alias("transaction_time"),
        (F.col("id") * 37 % 1_009).cast("double").alias("amount"),
        (F.col("id") % 11 / 10).alias("merchant_risk"),
    )
    logins = spark.range(n * 2).select((F.col("id") * 13 % n).alias("user_id"), (F.col("id") % 3).cast("int").alias("success"))
    devices = spark.range(n).select((F.col("id") * 3 % n).alias("user_id"))
    as_of = F.timestamp_micros(F.lit(400 * MICROS_PER_DAY))
    out = risk.risk_score(users, tx, logins, devices, as_of)
    assert out.agg(F.sum("is_fraud")).first()[0] == flagged
    assert out.count() == n


def test_users_without_activity(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id int").withColumn("signup_date", F.lit(None).cast("timestamp"))
    tx = spark.createDataFrame(
        [(1, 5.0, 0.4), (None, 3.0, 0.1)], "user_id int, amount double, merchant_risk double"
    ).withColumn("transaction_time", F.lit("2020-01-01").cast("timestamp"))
    logins = spark.createDataFrame([], "user_id int, success int")
    devices = spark.createDataFrame([], "user_id int")
    out = risk.user_aggregates(users, tx, logins, devices, F.lit("2024-01-01").cast("timestamp")).orderBy("user_id").collect()
    assert (out[0]["total_txns"], out[0]["txn_std"], out[0]["recent_txns"], out[0]["account_age_days"]) == (1, 0.0, 0, 365.0)
    assert (out[1]["total_txns"], out[1]["sum_amount"], out[1]["avg_merchant_risk"]) == (0, 0.0, 0.0)


def test_label_rate_bounds():
    assert risk.RiskOptions().label_rate == pytest.approx(0.018)
    assert risk.RiskOptions(base_rate=0.0).label_rate == 0.0001
    assert risk.RiskOptions(base_rate=0.9, drift=3.0).label_rate == 0.5
