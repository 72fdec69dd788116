import numpy as np
from pyspark.sql import functions as F

from tributary.operators import prune as p
from tributary.operators.aggregates import variance_ranking


def test_missing_bar_is_strict(spark):
    share = lambda n: F.when(F.col("id") >= n, F.col("id"))
    df = spark.range(100).select(share(79).alias("m79"), share(80).alias("m80"), share(81).alias("m81"))
    assert p.missing_columns(df, 0.8) == ["m81"]


def test_constant(spark):
    df = spark.range(10).select(
        F.lit(1).alias("one"),
        F.when(F.col("id") > 3, "x").alias("one_or_null"),
        F.lit(None).cast("int").alias("never"),
        "id",
        F.array("id").alias("list"),
    )
    assert p.constant_columns(df) == ["never", "one", "one_or_null"]


def frame(spark, columns):
    names = list(columns)
    rows = [tuple(None if v is None or np.isnan(v) else float(v) for v in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def test_correlation_equals_pandas(spark):
    rng = np.random.default_rng(5)
    n = 400
    base = rng.normal(size=n)
    data = {
        "a": base + 1_000,
        "b": np.where(rng.random(n) < 0.3, np.nan, base * 2 + rng.normal(size=n)),
        "c": rng.random(n),
        "flat": np.full(n, 3.3),
        "early": np.where(np.arange(n) < 200, base, np.nan),
        "late": np.where(np.arange(n) >= 200, base, np.nan),
    }
    df = frame(spark, data).repartition(5)
    expected = df.toPandas().corr()
    for r in p.correlation_pairs(df).collect():
        want = expected.loc[r["a"], r["b"]]
        assert (r["r"] is None and np.isnan(want)) or abs(r["r"] - want) < 1e-9


def test_tiles_give_the_same_as_one(spark, monkeypatch):
    """Pairs of tiles, a last narrow tile, several chunks and slabs, gaps, and centring in Python."""
    monkeypatch.setattr(p, "CHUNK_BYTES", 8 * 4 * 30)
    monkeypatch.setattr(p, "WIDE", 5)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(500, 4))
    data = {f"c{i:02d}": base[:, i % 4] * (i + 1) + rng.normal(size=500) * (0.1 + i % 3) + 100 * i for i in range(14)}
    data["c03"][::3] = np.nan
    data["c07"][:] = 5.0
    df = frame(spark, data).repartition(7)
    expected = df.toPandas().corr()
    for tile in (4, 5, 14, 512):
        found = {(r["a"], r["b"]): r["r"] for r in p.correlation_pairs(df, tile=tile).collect()}
        assert len(found) == 14 * 13 // 2
        for (a, b), r in found.items():
            want = expected.loc[a, b]
            assert (r is None and np.isnan(want)) or abs(r - want) < 1e-9
    whole = p.correlated_columns(df, 0.9, tile=512)
    assert whole and p.correlated_columns(df, 0.9, tile=4) == p.correlated_columns(df, 0.9, tile=3) == whole


def test_of_two_equal_columns_the_later_goes(spark):
    x = np.arange(50.0)
    noise = np.random.default_rng(2).random(50)
    df = frame(spark, {"a": x, "b": x, "z": noise})
    assert p.correlated_columns(df, 0.95) == ["b"]
    assert p.correlated_columns(df, 0.0) == []


def test_the_better_connected_column_goes_and_still_meets_its_partners(spark):
    """``a`` is close to b, c and d, which are less close to each other."""
    rng = np.random.default_rng(11)
    a = rng.normal(size=4_000)
    spread = 0.32
    data = {"a": a, **{c: a + rng.normal(scale=spread, size=a.size) for c in ("b", "c", "d")}}
    df = frame(spark, data)
    r = {(x["a"], x["b"]): x["r"] for x in p.correlation_pairs(df).collect()}
    assert min(r["a", c] for c in "bcd") > 0.94 > max(r["b", "c"], r["b", "d"], r["c", "d"])
    # a loses to b (larger mean), and goes on to lose to c and d; nothing else is marked.
    assert p.correlated_columns(df, 0.94) == ["a"]


def test_variance_rank_and_cap(spark):
    df = spark.range(10).select(
        (F.col("id") * 3).alias("wide"),
        F.col("id").alias("n1"),
        F.col("id").alias("n0"),
        (F.col("id") > 4).alias("flag"),
        F.lit("t").alias("text"),
    )
    ranked = [r["column"] for r in variance_ranking(df).orderBy("rank").collect()]
    assert ranked == ["wide", "n0", "n1", "flag", "text"]
    kept, dropped = p.cap_columns(df, 3)
    assert kept.columns == ["wide", "n0", "n1"] and dropped == ["flag", "text"]
    kept, _ = p.cap_columns(df, 3, protect=["text"])
    assert kept.columns == ["wide", "n0", "text"]
    assert p.cap_columns(df, 5)[0].columns == df.columns


def test_all_steps_keep_protected_columns(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("twice"), F.lit(1).alias("label"), F.lit(1).alias("one"))
    out, report = p.prune(df, p.PruneOptions(protect=["label", "id"]))
    assert out.columns == ["id", "twice", "label"]
    assert report.rows() == [("constant", "one")]


def test_infinite_values_have_no_correlation(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.1, float("inf")), (3.0, 6.0, 7.0), (4.0, 8.2, 1.0)]
    pairs = p.correlation_pairs(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()
    found = {(r.a, r.b): r.r for r in pairs}
    assert found["a", "b"] > 0.99 and found["a", "c"] is None and found["b", "c"] is None
