import datetime as dt

from pyspark.sql import functions as F

from tributary.functions import columns as c


def one(spark, expr, **values):
    names = ", ".join(f"{k} string" for k in values)
    df = spark.createDataFrame([tuple(values.values())], names) if values else spark.range(1)
    return df.select(expr).first()[0]


def test_dates_in_every_layout(spark):
    good = ["2024-03-05T10:20:30", "2024-03-05T10:20:30Z", "2024-03-05 10:20:30", "2024.03.05 10:20:30",
            "2024/03/05 10:20:30", "Mar 05 2024 10:20:30", "  2024-03-05T10:20:30 "]
    bad = ["", "junk", "10:20", "2024-13-45", "x" * 500, None]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select(c.parse_ts(F.col("t")).alias("p"))
    found = [r["p"] for r in df.collect()]
    assert found == [dt.datetime(2024, 3, 5, 10, 20, 30)] * len(good) + [None] * len(bad)


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("x",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in df.select(c.to_number(F.col("t"))).collect()] == [1.5, 2.0, None, None, None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(c.clip(F.col("x"), 0, 1)).collect()] == [0.0, 0.5, 1.0, None]


def test_email_domain(spark):
    assert one(spark, c.email_domain(F.col("e")), e="a@b@c.org") == "c.org"
    assert one(spark, c.email_domain(F.col("e")), e="nobody") is None


def test_ip_addresses(spark):
    good, bad = ["1.2.3.4", "255.255.255.255", "0.0.0.0"], ["256.256.256.256", "999.999.999", "not_an_ip", "", "1.2.3.4 ", None]
    df = spark.createDataFrame([(a,) for a in good + bad], "a string").select(c.valid_ipv4(F.col("a")))
    assert [r[0] for r in df.collect()] == [True] * 3 + [False] * 6


def test_age_rounds_down_and_defaults(spark):
    df = spark.createDataFrame([("2024-01-01 12:00:00",), ("2024-01-01 11:59:59",), (None,)], "t string")
    as_of = F.lit("2024-01-11 11:59:59").cast("timestamp")
    ages = df.select(c.age_days(F.col("t").cast("timestamp"), as_of)).collect()
    assert [a[0] for a in ages] == [9.0, 10.0, 365.0]


def test_max_norm_without_positive_maximum(spark):
    df = spark.createDataFrame([(0.0,), (None,)], "x double")
    assert [r[0] for r in df.select(c.max_norm(F.col("x"), F.lit(0.0))).collect()] == [0.0, 0.0]


def test_nan_becomes_null_and_fill(spark):
    df = c.clean_floats(spark.createDataFrame([(float("nan"), 1), (2.0, None)], "x double, n int"))
    assert [tuple(r) for r in df.collect()] == [(None, 1), (2.0, None)]
    assert [tuple(r) for r in c.fill(df, {"x": 7, "n": 3}).collect()] == [(7.0, 1), (2.0, 3)]


def test_words_and_characters(spark):
    df = spark.createDataFrame([("",), ("  a  b\nc ",), (None,)], "t string")
    counts = c.text_counts(F.col("t"))
    assert [tuple(r) for r in df.select(*counts.values()).collect()] == [(0, 0), (9, 3), (None, None)]


def test_columns_by_suffix_and_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b_norm int, a int, c int")
    assert c.drop_columns(df, ["c"], suffix="_norm").columns == ["a"]
    assert c.sort_columns(df).columns == ["a", "b_norm", "c"]


def test_pii(spark):
    df = spark.createDataFrame([("x", 1), (None, 2)], "name string, n int")
    hashed = [r["name"] for r in c.protect_pii(df, ["name"], salt="s").collect()]
    assert len(hashed[0]) == 64 and hashed[1] is None
    assert c.protect_pii(df, ["name"], hashed=False).columns == ["n"]
