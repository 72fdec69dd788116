import pytest
from pyspark.sql import functions as F

from tributary.operators import split as s


@pytest.fixture()
def rows(spark):
    """Half of the rows share one time; one has none; one class holds most rows."""
    return spark.range(1_000).select(
        "id",
        F.when(F.col("id") == 7, None).when(F.col("id") % 2 == 0, 500).otherwise(F.col("id")).alias("t"),
        F.when(F.col("id") < 3, "rare").when(F.col("id") < 50, None).otherwise("usual").alias("c"),
        (F.col("id") % 13).alias("g"),
    )


def ids(df, side):
    return [r["id"] for r in df.where(F.col("split") == side).orderBy("id").collect()]


@pytest.mark.parametrize("size", [0.0005, 0.1, 0.4, 0.7, 0.9995])
def test_time_split_is_a_cut_of_the_sorted_rows(rows, size):
    pdf = rows.toPandas().sort_values(["t", "id"], na_position="last")
    cut = int(len(pdf) * size)
    out = s.split_time(rows, "t", "id", size)
    assert ids(out, "train") == sorted(pdf["id"][:cut].tolist())
    assert ids(out, "test") == sorted(pdf["id"][cut:].tolist())


def test_random_split_follows_the_key(rows):
    first = ids(s.split_random(rows, "id"), "train")
    assert ids(s.split_random(rows.repartition(7).where("id < 900"), "id"), "train") == [i for i in first if i < 900]
    assert 740 < len(first) < 860
    assert first != ids(s.split_random(rows, "id", seed=1), "train")
    assert len(ids(s.split_random(rows, "id", exact=True), "train")) == 800


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_every_stratum_is_cut_exactly(rows, hot_rows):
    out = s.split_stratified(rows, "id", "c", 0.7, hot_rows=hot_rows)
    assert out.columns == [*rows.columns, "split"]
    counts = {(r["c"], r["split"]): r["count"] for r in out.groupBy("c", "split").count().collect()}
    assert counts == {
        ("rare", "train"): 2, ("rare", "test"): 1, (None, "train"): 32, (None, "test"): 15,
        ("usual", "train"): 665, ("usual", "test"): 285,
    }


def test_groups_stay_whole(rows):
    assert s.split_group(rows, "g").groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()


def test_folds(rows):
    sizes = {r["fold"]: r["count"] for r in s.assign_folds(rows, "id", 4).groupBy("fold").count().collect()}
    assert set(sizes) == {0, 1, 2, 3} and min(sizes.values()) > 180
    assert s.assign_folds(rows, "id", 0).where("fold <> 0").isEmpty()


def test_strategy_choice(rows):
    same = lambda a, b: ids(a, "train") == ids(b, "train")
    assert same(s.split_auto(rows, "id", time="t", stratum="c"), s.split_time(rows, "t", "id"))
    assert same(s.split_auto(rows, "id", stratum="c"), s.split_stratified(rows, "id", "c"))
    assert same(s.split_auto(rows, "id", strategy="group", group="g"), s.split_group(rows, "g"))
    with pytest.raises(ValueError):
        s.split_auto(rows, "id", strategy="group")
    with pytest.raises(ValueError):
        s.split_auto(rows, "id", strategy="other")
