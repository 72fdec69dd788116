import pytest
from pyspark.sql import functions as F

from tributary.operators import aggregates as agg
from tributary.operators import joins as j
from tributary.operators.deep import deep_features
from tributary.operators.profile import Relationship


@pytest.fixture()
def tables(spark):
    return {
        "people": spark.createDataFrame([(1, 10.0), (2, None), (2, 5.0), (None, 7.0)], "pid bigint, pay double"),
        "shops": spark.createDataFrame([(7, 1.5), (8, 2.5)], "sid bigint, pay double"),
        "sales": spark.createDataFrame([(1, 1, 7), (2, 2, 8), (3, 9, 8), (4, None, 7)], "id bigint, buyer bigint, shop bigint"),
    }


RELATIONSHIPS = [Relationship("people", "pid", "sales", "buyer"), Relationship("shops", "sid", "sales", "shop")]


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_aggregates_nulls_and_unmatched_rows(tables, hot_rows):
    out = j.aggregate_join(tables["sales"], tables, RELATIONSHIPS[:1], hot_rows=hot_rows).orderBy("id").collect()
    assert [(r["pid_count"], r["pay_count"], r["pay_sum"], r["pay_mean"]) for r in out] == [
        (1, 1, 10.0, 10.0), (2, 1, 5.0, 5.0), (None,) * 4, (None,) * 4,
    ]


def test_first_relationship_wins_and_prefix_keeps_both(tables):
    shops_alike = {**tables, "shops": tables["shops"].withColumnRenamed("sid", "pid")}
    both = [RELATIONSHIPS[0], Relationship("shops", "pid", "sales", "shop")]
    out = j.aggregate_join(tables["sales"], shops_alike, both)
    assert len(out.columns) == 3 + 6
    assert out.where("id = 1").first()["pay_sum"] == 10.0
    prefixed = j.aggregate_join(tables["sales"], shops_alike, both, prefix=True)
    assert len(prefixed.columns) == 3 + 12
    assert prefixed.where("id = 1").first()["shops__pay_sum"] == 1.5


def test_text_key_does_not_meet_a_number(spark, tables):
    named = {**tables, "people": tables["people"].withColumn("pid", F.col("pid").cast("string"))}
    assert j.aggregate_join(tables["sales"], named, RELATIONSHIPS[:1]).columns == tables["sales"].columns


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_codes_follow_sorted_values(spark, hot_rows):
    df = spark.createDataFrame([(1, "b", 5), (2, "a", 7), (3, None, 5), (4, "c", None)], "id int, x string, n int")
    out = j.encode_categories(df, ["x", "n"], hot_rows=hot_rows).orderBy("id").collect()
    assert [(r["x_code"], r["n_code"]) for r in out] == [(1, 0), (0, 1), (None, 0), (2, None)]


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_attached_devices_are_the_users_own(spark, hot_rows):
    devices = spark.createDataFrame([(u, f"d{u}{i}") for u in range(4) for i in range(u)], "user int, device string")
    rows = spark.range(400).select("id", (F.col("id") % 5).cast("int").alias("user"))
    out = agg.attach_one(rows, "id", "user", devices, "device", hot_rows=hot_rows)
    assert out.count() == 400
    assert out.where("device is not null and substring(device, 2, 1) <> cast(user as string)").isEmpty()
    share = out.where("user in (1, 2, 3)").agg(F.avg(F.col("device").isNotNull().cast("double"))).first()[0]
    assert 0.6 < share < 0.8
    assert out.where("user in (0, 4) and device is not null").isEmpty()
    assert out.where("user = 3").select("device").distinct().count() == 4  # three devices and null


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 2, "y"), (2, 9, "z"), (None, 1, "n"), (None, 0, "m")], "k int, o int, v string")
    assert {r["v"] for r in agg.dedupe(df, ["k"], ["o"]).collect()} == {"y", "z", "m"}


def test_labels_known_at_a_time(spark):
    day = lambda d: F.lit(f"2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.lit(d))  # noqa: E731, F541
    tx = spark.range(4).select("id", day(0).alias("at"))
    reports = spark.createDataFrame([(0,), (1,), (1,)], "id bigint").withColumn(
        "reported", F.when(F.col("id") == 0, day(30)).otherwise(day(80))
    )
    early = j.label_as_of(tx, reports, "id", "at", "reported", day(40)).orderBy("id").collect()
    assert [(r["label"], r["mature"]) for r in early] == [(1, 0), (0, 0), (0, 0), (0, 0)]
    late = j.label_as_of(tx, reports, "id", "at", "reported", day(90)).orderBy("id").collect()
    assert [(r["label"], r["mature"]) for r in late] == [(1, 1), (1, 1), (0, 1), (0, 1)]


def test_deep_features_names_ties_and_limits(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,)], "aid int"),
        "b": spark.createDataFrame(
            [(1, 1, "y", True, 2.0), (2, 1, "x", False, 2.0), (3, 1, None, None, 2.0)],
            "bid int, aid int, kind string, ok boolean, v double",
        ),
        "c": spark.createDataFrame([(1, 5.0), (1, 7.0), (3, 1.0)], "bid int, w double"),
    }
    rels = [Relationship("a", "aid", "b", "aid"), Relationship("b", "bid", "c", "bid")]
    keys = {"a": "aid", "b": "bid"}
    one = deep_features(tables, rels, "a", keys, max_depth=1).orderBy("aid").collect()
    assert (one[0]["COUNT(b)"], one[0]["MODE(b.kind)"], one[0]["NUM_UNIQUE(b.kind)"]) == (3, "x", 2)
    assert one[0]["PERCENT_TRUE(b.ok)"] == 0.5 and one[0]["SKEW(b.v)"] == 0.0 and one[0]["STD(b.v)"] == 0.0
    assert (one[1]["COUNT(b)"], one[1]["SUM(b.v)"], one[1]["MEAN(b.v)"]) == (0, 0.0, None)
    two = deep_features(tables, rels, "a", keys, max_depth=2).where("aid = 1").first()
    assert two["MAX(b.SUM(c.w))"] == 12.0 and two["MEAN(b.COUNT(c))"] == 1.0 and two["MIN(b.SUM(c.w))"] == 0.0
    assert "SUM(b.SUM(c.w))" not in two.asDict() and "SUM(b.COUNT(c))" not in two.asDict()
    down = deep_features(tables, rels, "c", {**keys, "c": "bid"}, max_depth=2, max_features=3)
    assert len(down.columns) == 4
