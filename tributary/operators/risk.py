"""User-level risk: signals per user, a weighted score, and a calibrated label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import age_days, logistic, max_norm, micros, MICROS_PER_DAY
from tributary.operators.quantiles import exact_quantiles
from tributary.session import durable
from tributary.sources.tables import union_rows

# Weight of each normalised signal in the score.
WEIGHTS = {
    "total_txns": 0.35,
    "avg_amount": 0.5,
    "txn_std": 0.25,
    "failed_logins": 0.7,
    "num_devices": 0.4,
    "recent_txns": 0.8,
    "avg_merchant_risk": 0.9,
    "account_age_days": -0.001,
}
SCORE_STEEPNESS = 3.0
RATE_BOUNDS = (0.0001, 0.5)
RECENT_DAYS = 7


@dataclass
class RiskOptions:
    base_rate: float = 0.02
    drift: float = 0.8
    recent_days: int = RECENT_DAYS

    @property
    def label_rate(self) -> float:
        """Share of users to label, after drift and within fixed bounds."""
        low, high = RATE_BOUNDS
        return min(max(self.base_rate * (1.0 + (self.drift - 1.0) * 0.5), low), high)


def recent_cutoff(as_of: Column, days: int) -> Column:
    return micros(as_of) - F.lit(days * MICROS_PER_DAY)


def recent_activity(tx: DataFrame, as_of: Column, days: int = RECENT_DAYS) -> DataFrame:
    """Per user: transactions since ``as_of`` minus some days, and mean merchant risk."""
    is_recent = micros(F.col("transaction_time")) >= recent_cutoff(as_of, days)
    return tx.groupBy("user_id").agg(
        F.count_if(F.coalesce(is_recent, F.lit(False))).alias("recent_txns"),
        F.coalesce(F.avg("merchant_risk"), F.lit(0.0)).alias("avg_merchant_risk"),
    )


def user_aggregates(
    users: DataFrame,
    tx: DataFrame,
    logins: DataFrame,
    devices: DataFrame,
    as_of: Column,
    options: RiskOptions | None = None,
) -> DataFrame:
    """Every user with its signals; users without activity get zeros.

    Transactions, logins and devices are stacked and grouped once, so all signals
    of a user cost one shuffle of partly aggregated rows instead of one per table.
    """
    o = options or RiskOptions()
    is_recent = micros(F.col("transaction_time")) >= recent_cutoff(as_of, o.recent_days)
    activity = union_rows(
        tx.select(
            "user_id",
            F.lit(1).alias("tx"),
            F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"),
            F.col("merchant_risk").cast("double").alias("risk"),
            F.when(is_recent, 1).alias("recent"),
        ),
        logins.where(F.col("success") == 0).select("user_id", F.lit(1).alias("failed")),
        devices.select("user_id", F.lit(1).alias("device")),
    )
    zero = F.lit(0.0)
    signals = activity.where("user_id is not null").groupBy(F.col("user_id").alias("__user")).agg(
        F.count("tx").alias("total_txns"),
        F.coalesce(F.sum("amount"), zero).alias("sum_amount"),
        F.coalesce(F.avg("amount"), zero).alias("avg_amount"),
        F.coalesce(F.stddev_samp("amount"), zero).alias("txn_std"),
        F.count("failed").alias("failed_logins"),
        F.count("device").alias("num_devices"),
        F.count("recent").alias("recent_txns"),
        F.coalesce(F.avg("risk"), zero).alias("avg_merchant_risk"),
    )
    names = [c for c in signals.columns if c != "__user"]
    joined = users.join(signals, F.col("user_id") == F.col("__user"), "left")
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]
    return joined.select(
        *[F.col(c) for c in users.columns], *filled, age_days(F.col("signup_date"), as_of).alias("account_age_days")
    )


def risk_score(
    users: DataFrame,
    tx: DataFrame,
    logins: DataFrame,
    devices: DataFrame,
    as_of: Column,
    options: RiskOptions | None = None,
) -> DataFrame:
    """Users with ``score``, ``probability`` and ``is_fraud`` next to their signals.

    The raw tables are read once. What follows works on one row per user: a
    one-row aggregate of maxima, one of the mean, and an exact quantile.
    """
    o = options or RiskOptions()
    base = durable(user_aggregates(users, tx, logins, devices, as_of, o), "user-signals")
    maxima = base.agg(*[F.max(c).cast("double").alias(c) for c in WEIGHTS]).first()
    norm = {c: max_norm(F.col(c), F.lit(maxima[c]).cast("double")) for c in WEIGHTS}
    drifted = norm["recent_txns"] * 0.5 + (F.lit(1.0) - norm["account_age_days"]) * 0.5
    weighted = sum((F.lit(w) * norm[c] for c, w in WEIGHTS.items()), F.lit(0.0))
    scored = base.withColumn("score", weighted * (F.lit(1.0) + F.lit(o.drift) * drifted))
    mean = scored.agg(F.avg("score").alias("m")).first()["m"] or 0.0
    with_p = scored.withColumn("probability", logistic((F.col("score") - F.lit(mean)) * F.lit(SCORE_STEEPNESS)))
    threshold = exact_quantiles(with_p, ["probability"], [1.0 - o.label_rate])["probability"][0]
    return with_p.withColumn("is_fraud", (F.col("probability") >= F.lit(threshold).cast("double")).cast("int"))
