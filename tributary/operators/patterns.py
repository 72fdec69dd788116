"""Fraud patterns: shared devices and rings, bursts, takeovers, copies, leaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import is_numeric, quoted
from tributary.operators.sequence import counts_in_range
from tributary.operators.skew import HOT_ROWS, lookup_join
from tributary.session import durable

SECOND = 1_000_000
BURST_COUNT, BURST_SECONDS = 10, 1_800
TAKEOVER_FAILURES, TAKEOVER_SECONDS = 3, 360


def shared_devices(edges: DataFrame, device: str, user: str, min_users: int = 2) -> DataFrame:
    """``device, n_users`` of devices used by several users."""
    pairs = edges.select(quoted(device).alias("device"), quoted(user).alias("user")).where(
        "device is not null and user is not null"
    )
    return (
        pairs.distinct()
        .groupBy("device")
        .agg(F.count(F.lit(1)).alias("n_users"))
        .where(F.col("n_users") >= min_users)
    )


def rings(edges: DataFrame, device: str, user: str, *, max_rounds: int = 50, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``user, ring`` for users linked by shared devices; the ring is its smallest user.

    Each device links its users to the smallest of them, which keeps the groups
    the same with as many links as edges, so a device with many users is no
    special case and no pairs are formed. Groups are then found by the two-step
    star contraction of Kiveris et al. (2014), whose number of rounds grows with
    the logarithm of the group size. Users that share no device are left out.
    """
    pairs = edges.select(quoted(device).alias("device"), quoted(user).alias("user")).where(
        "device is not null and user is not null"
    )
    pairs = durable(pairs.distinct(), "ring-edges")
    centres = pairs.groupBy("device").agg(F.min("user").alias("centre"))
    links = lookup_join(pairs, centres.withColumnRenamed("device", "__device"), "device", "__device", hot_rows=hot_rows)
    links = links.where("user <> centre").select(F.col("user").alias("a"), F.col("centre").alias("b")).distinct()
    links = durable(links, "ring-links")
    before = None
    for _ in range(max_rounds):
        links = durable(_small_star(durable(_large_star(links, hot_rows), "ring-links"), hot_rows), "ring-links")
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"rings not settled after {max_rounds} rounds")
    members = links.select(F.col("a").alias("user"), F.col("b").alias("ring"))
    heads = links.select(F.col("b").alias("user"), F.col("b").alias("ring")).distinct()
    return members.unionByName(heads)


def _large_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Link every larger neighbour of a user to the user's smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("m"))
    linked = lookup_join(both, least, "a", "__a", hot_rows=hot_rows)
    return linked.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Link a user and its smaller neighbours to the smallest of them."""
    least = links.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("m"))
    linked = lookup_join(links, least, "a", "__a", hot_rows=hot_rows)
    others = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("__a").alias("a"), F.col("m").alias("b"))
    return others.unionByName(own).distinct()


def velocity_bursts(
    tx: DataFrame,
    user: str,
    time: str,
    key: str,
    *,
    count: int = BURST_COUNT,
    seconds: int = BURST_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Transactions that end a span of ``seconds`` with at least ``count`` of the user's transactions."""
    timed = tx.where(quoted(time).isNotNull()).withColumn("__t", F.unix_micros(quoted(time).cast("timestamp")))
    counted = counts_in_range(timed, user, "__t", key, -seconds * SECOND, 0, name="n_in_span", hot_rows=hot_rows)
    return counted.where(F.col("n_in_span") >= count).drop("__t")


def takeovers(
    logins: DataFrame,
    user: str,
    time: str,
    key: str,
    success: str,
    *,
    failures: int = TAKEOVER_FAILURES,
    seconds: int = TAKEOVER_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Successful logins with at least ``failures`` failed ones in the ``seconds`` before."""
    timed = logins.where(quoted(time).isNotNull()).withColumn("__t", F.unix_micros(quoted(time).cast("timestamp")))
    counted = counts_in_range(
        timed, user, "__t", key, -seconds * SECOND, -1, counted=quoted(success) == 0, name="n_failed", hot_rows=hot_rows
    )
    return counted.where((quoted(success) == 1) & (F.col("n_failed") >= failures)).drop("__t")


def merchant_concentration(
    tx: DataFrame, merchant: str, amount: str, risk: str, high_risk: float = 0.8, *, category: str | None = None
) -> DataFrame:
    """Per merchant: transactions, amount, share of all amounts, mean risk, high-risk flag.

    With ``category`` there are rows of ``level`` "merchant" for each merchant in
    its category, and of "category" for each category, whose merchant is null;
    a null category is one of its own. All levels and the total come from one
    grouping, so the transactions travel once.
    """
    keys = [quoted(merchant)] + ([quoted(category)] if category else [])
    levels = [keys, keys[1:], []] if category else [keys, []]
    # grouping_id has a bit for each column that a level leaves out, the first column's highest.
    per = tx.groupingSets(levels, *keys).agg(
        F.grouping_id().alias("__level"), F.count(F.lit(1)).alias("n_txns"), F.sum(quoted(amount)).alias("amount"), F.avg(quoted(risk)).alias("mean_risk")
    )
    per = durable(per, "concentration")
    total = per.where(F.col("__level") == (1 << len(keys)) - 1).select(F.col("amount").alias("total"))
    level = F.when(F.col("__level") == 0, "merchant").when(F.col("__level") == 2, "category")
    out = per.where(F.col("__level") != (1 << len(keys)) - 1).crossJoin(F.broadcast(total))
    return out.select(
        *([level.alias("level")] if category else []),
        *keys,
        "n_txns",
        "amount",
        (F.col("amount") / F.nullif(F.col("total"), F.lit(0.0))).alias("share"),
        "mean_risk",
        (F.col("mean_risk") >= high_risk).cast("int").alias("high_risk"),
    )


def near_duplicates(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """``digest, copies, first_key, last_key`` of rows that differ only in their key.

    A group of copies is reduced to its count and ends before the shuffle.
    """
    values = [F.coalesce(quoted(c).cast("string"), F.lit("\x00")) for c in attributes]
    return (
        df.groupBy(F.sha2(F.concat_ws("\x1f", *values), 256).alias("digest"))
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(quoted(key)).alias("first_key"),
            F.max(quoted(key)).alias("last_key"),
        )
        .where("copies > 1")
    )


def leakage_scan(df: DataFrame, label: str, columns: Sequence[str] | None = None, suspect: float = 0.95) -> DataFrame:
    """``column, n, correlation, agreement, suspect`` of numeric columns against a 0/1 label.

    ``agreement`` is the share of present values equal to the label, or to its
    opposite if that is more; one pass for all columns.
    """
    names = list(columns) if columns is not None else [
        f.name for f in df.schema if is_numeric(f.dataType) and f.name != label
    ]
    y = quoted(label).cast("double")
    cells = []
    for c in names:
        x = quoted(c).cast("double")
        both = x.isNotNull() & y.isNotNull()
        xs, ys = F.when(both, x), F.when(both, y)
        spread = F.stddev_pop(xs) * F.stddev_pop(ys)
        same = F.avg((xs == ys).cast("double"))
        opposite = F.avg((xs == (F.lit(1.0) - ys)).cast("double"))
        cells.append(F.struct(
            F.lit(c).alias("column"),
            F.count(xs).alias("n"),
            F.abs(F.covar_pop(xs, ys) / F.nullif(spread, F.lit(0.0))).alias("correlation"),
            F.greatest(same, opposite).alias("agreement"),
        ))
    scanned = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    hit = (F.col("correlation") >= suspect) | (F.col("agreement") >= suspect)
    return scanned.withColumn("suspect", F.coalesce(hit, F.lit(False)).cast("int"))
