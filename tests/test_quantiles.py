import numpy as np
import pytest

from tributary.operators import quantiles as q

PROBABILITIES = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.982, 1.0]


@pytest.fixture()
def frame(spark):
    rng = np.random.default_rng(7)
    n = 6_000
    values = rng.normal(size=n).round(3)
    values[: n // 3] = 0.25  # a third of all rows share one value
    heavy = np.exp(rng.normal(scale=6, size=n))
    rows = [
        (None if i % 11 == 0 else float(v), float(h), int(k))
        for i, (v, h, k) in enumerate(zip(values, heavy, rng.integers(0, 5, n)))
    ]
    return spark.createDataFrame(rows, "v double, h double, k bigint")


@pytest.mark.parametrize("finish", [65_536, 40])
def test_equal_to_a_full_sort(frame, monkeypatch, finish):
    monkeypatch.setattr(q, "FINISH_VALUES", finish)
    monkeypatch.setattr(q, "SKETCH_ACCURACY", 200)
    found = q.exact_quantiles(frame, ["v", "h", "k"], PROBABILITIES)
    pdf = frame.toPandas()
    for c in ("v", "h", "k"):
        assert np.allclose(found[c], pdf[c].dropna().quantile(PROBABILITIES).to_numpy(), rtol=1e-12)


def test_kth_value_of_large_whole_numbers(spark):
    big = 2**61
    df = spark.createDataFrame([(big + i,) for i in range(50)], "x bigint")
    assert q.kth_values(df, [("x", 0), ("x", 49)]) == [big, big + 49]


def test_decimals_alone(spark):
    df = spark.range(40).selectExpr("CAST(id / 4 AS DECIMAL(20, 2)) AS d")
    assert q.kth_values(df, [("d", 0), ("d", 7), ("d", 39)]) == [0.0, 1.75, 9.75]


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert q.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}
    with pytest.raises(ValueError):
        q.kth_values(df, [("x", 0)])


def test_skewed_partitions_and_ties(spark, monkeypatch):
    monkeypatch.setattr(q, "FINISH_VALUES", 10)
    monkeypatch.setattr(q, "SKETCH_ACCURACY", 64)
    df = spark.range(0, 20_000, numPartitions=7).selectExpr("id", "IF(id < 9000, 5, id % 97) AS v", "CAST(id AS DECIMAL(20, 2)) AS d")
    pdf = df.selectExpr("id", "v", "CAST(d AS DOUBLE) AS d").toPandas()
    found = q.exact_quantiles(df, ["id", "v", "d"], PROBABILITIES)
    for c in ("id", "v", "d"):
        assert np.allclose(found[c], pdf[c].quantile(PROBABILITIES).to_numpy(), rtol=1e-12)


def test_nan_comes_last_and_infinities_are_values(spark, monkeypatch):
    monkeypatch.setattr(q, "FINISH_VALUES", 4)
    rows = [(float(i),) for i in range(40)] + [(float("-inf"),), (float("inf"),)] + [(float("nan"),)] * 20 + [(None,)] * 5
    df = spark.createDataFrame(rows, "x double")
    found = q.kth_values(df, [("x", 0), ("x", 1), ("x", 41), ("x", 50)])
    assert found[:3] == [float("-inf"), 0.0, float("inf")] and np.isnan(found[3])


def test_no_task_merges_the_sketches_of_all_others(spark):
    target = q._Target("id", 5, 1_000)
    plan = q._merged_sketches(spark.range(1_000), [[target]], ["bigint"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(merge_group" in plan
