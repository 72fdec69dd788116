import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tributary.operators import forest as fo
from tributary.operators import models as m

COLUMNS = ["x.a", "b", "few"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(4000):
        a, b, few = float(rng.normal()), float(rng.random()), int(rng.integers(0, 3))
        rows.append((i, a, None if i % 11 == 0 else b, few, float(3 * a + 5 * (few == 2) + 2 * b * b + rng.normal(scale=0.1))))
    return spark.createDataFrame(rows, "id bigint, `x.a` double, b double, few int, y double").repartition(3, "id").cache()


def options(**more):
    return m.ModelOptions("forest", task=m.REGRESSION, **({"trees": 40} | more))


def trees(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.pipeline.stages[-1].trees]


@pytest.fixture
def from_blocks(monkeypatch):
    monkeypatch.setattr(m, "FOREST_BYTES", 0)
    monkeypatch.setattr(fo, "BLOCK", 300)


def test_large_forests_do_not_hand_their_rows_to_the_memory_of_spark_ml(points, from_blocks, monkeypatch):
    given, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df, *a: given.append(df.count()) or fit(self, df, *a))
    model = m.fit_model(points, COLUMNS, "y", options(), key="id")
    assert sum(given) <= 2
    assert len(trees(model)) == 40
    # Every tree takes about as many rows as there are.
    taken = [t._call_java("rootNode").impurityStats().rawCount() for t in model.pipeline.stages[-1].trees]
    assert all(abs(n - 4000) < 5 * 4000**0.5 for n in taken) and len(set(taken)) > 10


def test_blocks_learn_what_spark_ml_learns(points, monkeypatch, tmp_path):
    train, test = points.where("id % 5 <> 0"), points.where("id % 5 = 0")
    plain = m.fit_model(train, COLUMNS, "y", options(), key="id")
    monkeypatch.setattr(m, "FOREST_BYTES", 0)
    monkeypatch.setattr(fo, "BLOCK", 300)
    model = m.fit_model(train, COLUMNS, "y", options(), key="id")
    known, found = m.evaluate(plain, test)["rmse"], m.evaluate(model, test)["rmse"]
    assert found == pytest.approx(known, rel=0.1)
    assert [f for f, _ in model.importance()] == [f for f, _ in plain.importance()]
    assert dict(model.importance()) == pytest.approx(dict(plain.importance()), abs=0.08)
    model.save(str(tmp_path / "model"))
    again = m.FittedModel.load(str(tmp_path / "model"))
    pick = lambda x: [r["prediction"] for r in x.score(test).orderBy("id").collect()]
    assert pick(again) == pick(model)


def test_groups_of_trees_grow_the_same_trees(points, from_blocks, monkeypatch):
    whole = m.fit_model(points, COLUMNS, "y", options(trees=5, max_depth=3), key="id")
    monkeypatch.setattr(fo, "HELD", 1)
    assert trees(m.fit_model(points, COLUMNS, "y", options(trees=5, max_depth=3), key="id")) == trees(whole)


@pytest.mark.parametrize("few", [0, 1])
def test_splits_equal_those_of_a_loop(few):
    rng = np.random.default_rng(9 + few)
    bins, n = 6, 500
    x, y = rng.integers(0, bins, (4, n)).astype(np.uint8), rng.normal(size=n) + 3
    levels = [fo.Level(np.array([2]), np.array([bins - 1 if few else 2], np.uint8))]
    features = np.array([[0, 3], [1, 2]])
    sums = np.zeros((fo.SUMS, features.size * bins))
    fo._add(sums, x, y, np.random.default_rng([1]), levels, features, bins, squares=True)
    w = fo.poisson(np.random.default_rng([1]), n).astype(float)
    found = fo.best_splits(sums.reshape(fo.SUMS, 2, 2, bins), features).to_dict("records")
    spread = lambda on: (w[on] @ y[on] ** 2 - (w[on] @ y[on]) ** 2 / w[on].sum()) if w[on].sum() else 0.0
    for node, got in enumerate(found):
        here = (x[2] > levels[0].bin[0]) == bool(node)
        assert got["rows"] == w[here].sum()
        if few and node:
            assert got["rows"] == 0 and not got["gain"] > 0
            continue
        tried = {}
        for f in features[node]:
            for b in range(bins):
                left = here & (x[f] <= b)
                if w[left].sum() and w[here & ~left].sum():
                    tried[f, b] = (spread(here) - spread(left) - spread(here & ~left)) / w[here].sum()
        best = max(tried, key=tried.get)
        assert (got["feature"], got["bin"]) == best and got["gain"] == pytest.approx(tried[best])
        left = here & (x[best[0]] <= best[1])
        expected = [w[here] @ y[here], w[here] @ y[here] ** 2, w[left].sum(), w[left] @ y[left], w[left] @ y[left] ** 2]
        assert [got[c] for c in ("total", "squares", "left_rows", "left_total", "left_squares")] == pytest.approx(expected)


def test_thresholds_separate_values():
    assert fo.cut_points(np.array([3.0, 1.0, 1.0, 7.0]), 31).tolist() == [2.0, 5.0]
    assert fo.cut_points(np.array([4.0, 4.0]), 31).tolist() == []
    cuts = fo.cut_points(np.random.default_rng(3).normal(size=10_000), 31)
    shares = np.bincount(np.searchsorted(cuts, np.random.default_rng(3).normal(size=10_000))) / 10_000
    assert len(cuts) == 31 and shares.min() > 0.03 and shares.max() < 0.033


def test_labels_that_are_no_numbers_and_constant_features(spark, points, from_blocks):
    flat = points.withColumns({c: F.lit(1.0) for c in ("few", "b")}).withColumn("x.a", F.lit(2.0))
    model = m.fit_model(flat, COLUMNS, "y", options(trees=3), key="id")
    assert all(t.numNodes == 1 for t in model.pipeline.stages[-1].trees)
    broken = points.withColumn("y", F.when(F.col("id") == 5, F.lit(float("nan"))).otherwise(F.col("y")))
    with pytest.raises(Exception, match="NaN"):
        m.fit_model(broken, COLUMNS, "y", options(trees=3), key="id")


def test_a_fit_reads_its_rows_once(spark, tmp_path):
    """Every pass of the medians over the source would call the counter again for each row."""
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    df = spark.range(500, numPartitions=2).selectExpr("id", "cast(id % 17 as double) a", "cast(id % 5 as double) y")
    df = df.mapInArrow(counted, df.schema)
    m.fit_model(df, ["a"], "y", options(trees=2, max_depth=1), key="id")
    assert calls.value == 500
    ready = m.prepare_training(df, ["a"], "y", key="id").ready
    assert ready.columns == ["__features", "y", m.HASH, m.PART]
