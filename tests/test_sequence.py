import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tributary.operators import sequence as s


@pytest.fixture()
def series(spark):
    """Gaps, equal times and one group with most of the rows."""
    rng = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "g": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 9, n)),
        "t": rng.integers(0, 300, n),
        "x": np.where(rng.random(n) < 0.2, None, rng.random(n).round(4)),
    })
    rows = [(int(r.id), int(r.g), int(r.t), None if r.x is None else float(r.x)) for r in pdf.itertuples()]
    pdf["x"] = pdf["x"].astype(float)
    return spark.createDataFrame(rows, "id bigint, g int, t bigint, x double"), pdf.sort_values(["t", "id"])


def made_by_pandas(pdf, periods, windows, by=None):
    out = pdf.copy()
    grouped = (lambda c: out.groupby(by)[c]) if by else (lambda c: out[c])
    for p in periods:
        for c in [c for c in out if c.startswith("x")]:
            out[f"{c}_lag_{p}"] = grouped(c).shift(p)
    for w in windows:
        for c in [c for c in out if c.startswith("x")]:
            if by:
                out[f"{c}_roll_mean_{w}"] = grouped(c).transform(lambda v: v.rolling(w, min_periods=1).mean())
            else:
                out[f"{c}_roll_mean_{w}"] = out[c].rolling(w, min_periods=1).mean()
    return out


def assert_same(df, expected):
    found = df.toPandas().set_index("id").sort_index()
    expected = expected.set_index("id").sort_index()
    assert list(found.columns) == list(expected.columns)
    for c in expected.columns:
        assert np.allclose(found[c].astype(float), expected[c].astype(float), equal_nan=True), c


@pytest.mark.parametrize("bucket", [7, 100, 100_000])
def test_whole_table_in_buckets(series, bucket):
    df, pdf = series
    out = s.lag_and_rolling(df, "t", "id", periods=[1, 3], windows=[2, 5], columns=["x"], bucket_rows=bucket)
    assert_same(out, made_by_pandas(pdf, [1, 3], [2, 5]))


@pytest.mark.parametrize("partitions", ["1", "4", "200"])
def test_any_number_of_partitions(spark, series, partitions):
    df, pdf = series
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = s.lag_features(df, "t", "id", [2], columns=["x"], bucket_rows=50)
        assert_same(out, made_by_pandas(pdf, [2], []))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_within_groups_of_any_size(series, hot_rows):
    df, pdf = series
    out = s.lag_and_rolling(
        df, "t", "id", periods=[1], windows=[3], columns=["x"], group=["g"], hot_rows=hot_rows, bucket_rows=20
    )
    assert_same(out, made_by_pandas(pdf, [1], [3], by="g"))


def test_no_step_gathers_the_table(series):
    df, _ = series
    out = s.lag_features(df, "t", "id", [1], columns=["x"])
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_not_compound(series):
    df, _ = series
    out = s.lag_and_rolling(df, "t", "id", periods=[1, 2], windows=[3], columns=["x"], compound=False)
    assert out.columns[4:] == ["x_lag_1", "x_lag_2", "x_roll_mean_3"]


def test_ranges_count_rows_with_null_and_repeated_keys(spark):
    rows = [(None, 1, 0), (None, 1, 5), (7, 1, 6), (7, 1, 6), (8, None, 6), (9, 2, 100)]
    df = spark.createDataFrame(rows, "k int, g int, t long")
    found = [
        sorted(map(str, s.counts_in_range(df, "g", "t", "k", -6, 0, hot_rows=hot).collect())) for hot in (1, 1_000_000)
    ]
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_row_numbers(series):
    df, pdf = series
    assert s.ensure_row_id(df, ["t", "id"]).columns == df.columns
    renamed = df.withColumnRenamed("id", "key")
    found = s.ensure_row_id(renamed, ["t", "key"]).orderBy("generated_index").toPandas()
    assert found["generated_index"].tolist() == list(range(len(pdf)))
    assert found["key"].tolist() == pdf["id"].tolist()


def test_running_sum(series):
    df, pdf = series
    found = s.running_sum(df, ["t", "id"], "g", "upto").orderBy("t", "id").toPandas()
    assert found["upto"].tolist() == pdf["g"].cumsum().tolist()


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_positions_and_counts_in_range(series, hot_rows):
    df, pdf = series
    at = s.running_position(df, "g", ["t", "id"], hot_rows=hot_rows).toPandas().set_index("id")["position"]
    expected = pdf.set_index("id").groupby("g").cumcount()
    assert at.sort_index().tolist() == expected.sort_index().tolist()
    out = s.counts_in_range(df, "g", "t", "id", -20, -1, counted=F.col("x") > 0.5, hot_rows=hot_rows).toPandas()
    for r in out.sample(60, random_state=1).itertuples():
        near = pdf[(pdf.g == r.g) & (pdf.t >= r.t - 20) & (pdf.t <= r.t - 1) & (pdf.x > 0.5)]
        assert r.n_in_range == len(near)


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_forecast_target(series, hot_rows):
    df, pdf = series
    out = s.forecast_target(df, "x", 3, "t", "id", group=["g"], hot_rows=hot_rows, bucket_rows=11)
    expected = pdf.assign(target=pdf.groupby("g")["x"].shift(-3))
    assert_same(out, expected)
