import pytest
from pyspark.sql import functions as F

from tributary.operators import skew


@pytest.fixture()
def facts(spark):
    """Key 0 holds half of the rows, a tenth has no key, key 99 has no match."""
    key = F.when(F.col("id") % 10 == 3, None).when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7)
    return spark.range(2_000).select("id", F.when(F.col("id") == 5, 99).otherwise(key).alias("k"))


def test_hot_keys(facts):
    assert skew.hot_keys(facts, "k", hot_rows=500) == [0]
    assert skew.hot_keys(facts, "k", hot_rows=5_000) == []


def test_lookup_is_the_same_with_and_without_spreading(spark, facts):
    names = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "k bigint, name string")
    plain = facts.join(names, "k", "left").select("id", "k", "name")
    spread = skew.lookup_join(facts, names, "k", "k", hot_rows=100)
    assert sorted(map(tuple, spread.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert spread.columns == ["id", "k", "name"]


def test_spread_rows_do_not_meet_in_one_task(spark, facts):
    names = spark.range(7).select(F.col("id").alias("k"), F.col("id").alias("name"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = skew.lookup_join(facts, names, "k", "k", hot=[0]).withColumn("task", F.spark_partition_id())
        largest = out.where("k = 0").groupBy("task").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert largest < 600


def test_groups_by_size(facts):
    tag = lambda name: lambda df: df.withColumn("how", F.lit(name))
    out = skew.by_group_size(facts, ["k"], tag("usual"), tag("large"), hot_rows=150)
    counts = {r["how"]: r["count"] for r in out.groupBy("how").count().collect()}
    sizes = {r["k"]: r["count"] for r in facts.groupBy("k").count().collect()}
    assert counts["large"] == sum(n for n in sizes.values() if n > 150)
    assert sum(counts.values()) == 2_000
