import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import metrics as me
from tributary.operators import models as m
from tributary.operators import search
from tributary.operators.split import assign_folds
from tributary.session import Deadline, OutOfTime
from tributary.operators.profile import Relationship
from tributary.plans.features import FeatureOptions, build_feature_matrix, find_keys
from tributary.plans.training import TrainOptions, read_record, train_and_evaluate, write_run


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        a, b = rng.normal(size=2)
        label = int(a + 0.5 * b + rng.normal(scale=0.3) > 0)
        rows.append((i, float(a), None if i % 9 == 0 else float(b), label, float(3 * a - b)))
    return spark.createDataFrame(rows, "id bigint, `x.a` double, b double, label int, y double").cache()


def halves(points):
    return points.where("id % 5 <> 0"), points.where("id % 5 = 0")


@pytest.mark.parametrize(
    "options",
    [m.ModelOptions("logistic"), m.ModelOptions("forest", trees=10, balanced=True), m.ModelOptions("boosted", rounds=5)],
)
def test_classifiers_learn(points, options):
    train, test = halves(points)
    found = m.evaluate(m.fit_model(train, ["x.a", "b"], "label", options, key="id"), test)
    assert found["accuracy"] > 0.8 and found["roc_auc"] > 0.88


@pytest.mark.parametrize("kind", ["linear", "forest", "boosted"])
def test_regressors_learn(points, kind):
    train, test = halves(points)
    options = m.ModelOptions(kind, task=m.REGRESSION, trees=10, rounds=10)
    assert m.evaluate(m.fit_model(train, ["x.a", "b"], "y", options, key="id"), test)["rmse"] < 2.0


def test_logistic_penalty_is_on_the_summed_loss(spark):
    """One feature, four rows: the weight solves w = sum of (y - p) x."""
    df = spark.createDataFrame([(1.0, 1), (1.0, 1), (-1.0, 0), (-1.0, 0)], "x double, y int")
    model = m.fit_model(df, ["x"], "y", m.ModelOptions("logistic"))
    w = model.pipeline.stages[-1].coefficients[0]
    assert abs(w - 4 / (1 + np.exp(w))) < 1e-3


def test_saved_model_scores_the_same(points, tmp_path):
    train, test = halves(points)
    model = m.fit_model(train, ["x.a", "b"], "label", m.ModelOptions("logistic"))
    model.save(str(tmp_path / "model"))
    again = m.FittedModel.load(str(tmp_path / "model"))
    assert again.options == model.options
    pick = lambda x: [r["probability"] for r in x.score(test).orderBy("id").collect()]
    assert pick(model) == pick(again)
    assert [f for f, _ in model.importance()][0] == "x.a"


def test_preparation_is_learnt_on_training_rows(points):
    train, test = halves(points)
    model = m.fit_model(train, ["x.a", "b"], "label", m.ModelOptions("logistic"))
    pdf = train.toPandas()
    assert model.imputer.medians["b"] == pytest.approx(pdf["b"].median())
    filled = pdf["b"].fillna(pdf["b"].median())
    assert model.scaler.means["b"] == pytest.approx(filled.mean())
    assert model.scaler.deviations["b"] == pytest.approx(filled.std(ddof=0))
    assert model.prepare(test).where("b is null").isEmpty()


def test_out_of_fold_covers_every_row_once(points):
    out = m.out_of_fold(points, ["x.a", "b"], "label", "id", folds=3)
    assert out.count() == 600 and out.select("id").distinct().count() == 600


def test_folds_in_parallel_equal_one_after_the_other(spark, points):
    df = points.where("id < 300")
    options = m.ModelOptions("logistic", max_iter=50)
    found = {r["id"]: (r["fold"], r["prediction"], r["probability"]) for r in m.out_of_fold(df, ["x.a", "b"], "label", "id", options).collect()}
    marked = assign_folds(df, "id", 5, 42, name="fold")
    learnt = m.fold_preparations(marked, ["x.a", "b"], 5)
    for i in range(5):
        train = marked.where(F.col("fold") != i).drop("fold")
        model = m.fit_model(train, ["x.a", "b"], "label", options, key="id")
        assert learnt[i][0] == model.imputer
        for part in ("means", "deviations"):
            assert getattr(learnt[i][1], part) == pytest.approx(getattr(model.scaler, part), rel=1e-12)
        for r in model.score(marked.where(F.col("fold") == i)).collect():
            assert found[r["id"]][:2] == (i, r["prediction"]) and found[r["id"]][2] == pytest.approx(r["probability"], abs=1e-6)


def test_best_round_equals_a_loop():
    rng = np.random.default_rng(5)
    for patience in (1, 3, 50):
        for _ in range(50):
            losses = list(np.cumsum(rng.normal(size=rng.integers(1, 80))))
            waited, best = 0, 0
            for i, loss in enumerate(losses):
                better = loss < losses[best] or i == 0
                best, waited = (i, 0) if better else (best, waited + 1)
                if waited == patience:
                    break
            assert m.best_round(losses, patience) == best + 1
    assert m.best_round([], 5) == 1


def test_boosting_stops_at_the_best_round(spark):
    """Labels are noise, so held-out loss rises soon; the rounds kept are those a loop over single models finds."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(rng.normal()), int(rng.random() < 0.5)) for i in range(400)], "id long, x double, y int")
    options = m.ModelOptions("boosted", rounds=12, max_depth=3, patience=3, validation_share=0.3)
    prepared = m.prepare_training(df, ["x"], "y", key="id")
    check = prepared.where(F.col(m.HASH) < 0.3)
    learn = prepared.where(F.col(m.HASH) >= 0.3)
    whole = learn.fit(replace(options, early_stopping=False))
    losses = []
    for k in range(1, 13):
        part = learn.fit(replace(options, early_stopping=False, rounds=k))
        margins = [(r["y"], r["rawPrediction"][1]) for r in part.pipeline.transform(check.ready).collect()]
        losses.append(float(np.mean([2 * np.log1p(np.exp(-2 * (2 * y - 1) * g)) for y, g in margins])))
    stopped = prepared.fit(options)
    trees = stopped.pipeline.stages[-1].trees
    assert len(trees) == m.best_round(losses, 3) < 12
    assert [t.toDebugString.split("\n", 1)[1] for t in trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.pipeline.stages[-1].trees[: len(trees)]]
    assert stopped.options.rounds == 12


def test_search_halves_candidates_on_growing_samples(points):
    options = [m.ModelOptions("logistic", inverse_penalty=1e-9), m.ModelOptions("logistic"), m.ModelOptions("forest", trees=1, max_depth=1), m.ModelOptions("linear")]
    found = search.search_models(points, ["x.a", "b"], "label", options[:3], "log_loss", key="id", least_rows=50)
    by_rung = {}
    for t in found.trials:
        by_rung.setdefault(t.rung, []).append(t)
    assert [len(r) for r in by_rung.values()] == [3, 1] and [r[0].share for r in by_rung.values()] == pytest.approx([1 / 3, 1])
    best = min(by_rung[0], key=lambda t: (t.value, t.candidate))
    assert by_rung[1][0].candidate == best.candidate == found.winner and not found.out_of_time
    assert found.model.options == options[found.winner]
    assert found.report(points.sparkSession).where("won").count() == 2


def test_rungs():
    assert search.rung_shares(9, 10**6, 3, 1_000) == pytest.approx([1 / 9, 1 / 3, 1])
    assert search.rung_shares(9, 5_000, 3, 1_000) == pytest.approx([1 / 3, 1])
    assert search.rung_shares(9, 10, 3, 1_000) == [1.0] and search.rung_shares(1, 10**6, 3, 1_000) == [1.0]


@pytest.mark.parametrize("seconds", [0.0, 0.3])
def test_search_out_of_time_still_gives_a_model(points, seconds):
    options = [m.ModelOptions("logistic")] + [m.ModelOptions("boosted", rounds=100, early_stopping=False)] * 3
    started = time.monotonic()
    found = search.search_models(points, ["x.a", "b"], "label", options, "roc_auc", key="id", seconds=seconds)
    assert found.out_of_time and found.model.options == options[found.winner] and len(found.trials) < 4
    assert time.monotonic() - started < 60 and not m.evaluate(found.model, points) == {}


def test_deadline_cancels_running_jobs(spark):
    limit = Deadline(spark, 1.0)
    started = time.monotonic()
    with pytest.raises(OutOfTime), limit.limit():
        spark.range(8, numPartitions=8).select(F.udf(lambda i: time.sleep(60) or i, "long")("id")).collect()
    assert time.monotonic() - started < 30
    # The session goes on, and an error of one's own stays itself.
    assert spark.range(3).count() == 3
    with pytest.raises(ZeroDivisionError), Deadline(spark, 100).limit():
        1 / 0
    with Deadline(spark, None).limit():
        assert spark.range(3).count() == 3


def test_metrics_by_name(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9), (0, 1.0, 0.6), (1, 0.0, 0.2), (0, 0.0, 0.0)], "y int, prediction double, probability double")
    want = {
        "accuracy": 0.5, "f1": 0.5, "roc_auc": 0.75, "mae": 0.5, "rmse": 0.5**0.5, "r2": 1 - 0.5 / 0.25,
        "log_loss": -(np.log(0.9) + np.log(0.4) + np.log(0.2) + np.log(1 - 1e-15)) / 4,
    }
    assert {k: me.metric_value(df, "y", k) for k in me.METRICS} == pytest.approx(want)
    with pytest.raises(ValueError):
        me.metric_value(df, "y", "nope")


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (None, 0.2), (1, None)], "y int, s double")
    # Pairs: 0.9-0.9 tie, 0.9-0.1 win, 0.5-0.9 loss, 0.5-0.1 win.
    assert me.roc_auc(df, "y", "s").first()[0] == 2.5 / 4
    assert me.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None
    known = df.where("y is not null and s is not null")
    assert me.roc_auc_unrounded(known, "y", "s") == pytest.approx(2.5 / 4)


def test_gate(spark):
    found = spark.createDataFrame([(0.7,)], "accuracy double")
    assert me.metric_gate(found, "accuracy", 0.7) is found
    assert me.metric_gate(found, "accuracy", None) is found
    with pytest.raises(ValueError):
        me.metric_gate(found, "accuracy", 0.71)
    with pytest.raises(ValueError):
        me.metric_gate(found, "accuracy", 0.6, lower_is_better=True)


def test_weights_and_oversampling(spark):
    df = spark.range(100).select("id", (F.col("id") < 5).cast("int").alias("y"))
    weights = {r["y"]: r["weight"] for r in me.class_weights(df, "y").collect()}
    assert weights == {1: 10.0, 0: pytest.approx(100 / 190)}
    sizes = {r["y"]: r["count"] for r in me.oversample(df, "y", max_ratio=5).groupBy("y").count().collect()}
    assert sizes == {0: 95, 1: 20}


def test_copies_of_a_rare_row_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(me, "COPIES", 10)
    df = spark.range(1_000).select("id", (F.col("id") == 7).cast("int").alias("y"))
    out = me.oversample(df, "y", max_ratio=1)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 999, 1: 999} and out.columns == ["id", "y"]
    assert out.where("y = 1").select(F.spark_partition_id()).distinct().count() > 1


def test_matrix_to_model(spark, tmp_path):
    """Discovery, joins, sequences, pruning, split and model in one go."""
    users = spark.range(200).select(
        F.col("id").alias("uid"), (F.col("id") % 7).cast("double").alias("level"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"),
    )
    visits = spark.range(1_000).select(
        F.col("id").alias("vid"),
        (F.col("id") % 200).alias("user_ref"),
        F.timestamp_micros(F.col("id") * 1_000_000).alias("at"),
        ((F.col("id") * 7919) % 101 + F.lit(0.25)).alias("spent"),
        ((F.col("id") % 200) % 7 > 3).cast("int").alias("target"),
        F.lit("same").alias("fixed"),
    )
    tables = {"users": users, "visits": visits}
    keys = find_keys(tables)
    assert keys == {"users": ["uid"], "visits": ["vid", "at"]}
    options = FeatureOptions(
        lag_periods=[1], rolling_windows=[3], sequence_columns=["spent"], row_key="vid", pii=["kind"], prefix=True
    )
    options.prune.protect = ["vid", "target"]
    built = build_feature_matrix(tables, options)
    assert built.anchor == "visits" and built.time == "at"
    assert Relationship("users", "uid", "visits", "user_ref") in built.relationships
    assert "fixed" in built.dropped.constant and "fixed" not in built.df.columns
    assert "users__level_mean" in built.df.columns and "spent_lag_1_roll_mean_3" in built.df.columns
    result = train_and_evaluate(
        built.df, TrainOptions("target", "vid", stratum="target", model=m.ModelOptions("forest", trees=10))
    )
    assert result.metrics["accuracy"] > 0.95
    assert result.rows["train"] + result.rows["test"] == 1_000
    row = result.report(spark).first()
    assert (row["kind"], row["backend"], row["data_fingerprint"]) == ("forest", "spark-ml", result.fingerprint)
    folder = write_run(result, built.df, str(tmp_path))
    record = read_record(spark, folder)
    assert record["run_id"] == result.run_id and record["accuracy"] == result.metrics["accuracy"] and record["seconds"] > 0
    assert m.FittedModel.load(f"{folder}/model").features == result.model.features
    assert spark.read.parquet(f"{folder}/features").count() == 1_000
    first = record["written"]
    assert write_run(result, built.df, str(tmp_path)) == folder and read_record(spark, folder)["written"] == first
    assert read_record(spark, f"{tmp_path}/absent") is None
    with pytest.raises(ValueError):
        train_and_evaluate(built.df, TrainOptions("absent", "vid"))
    with pytest.raises(ValueError):
        train_and_evaluate(built.df, TrainOptions("target", "vid", model=m.ModelOptions("logistic"), minimum=1.1))


def test_time_column_of_another_table(spark):
    """The anchor's own column reads as a time too seldom; another table's column of that name does."""
    seen = F.when(F.col("id") % 2 == 0, "junk").otherwise(F.concat(F.lit("2024-01-0"), F.col("id").cast("string")))
    visits = spark.range(9).select(F.col("id").alias("vid"), (F.col("id") % 3).alias("uid"), seen.alias("at"), (F.col("id") * 2.5).alias("spent"))
    users = spark.range(3).select(F.col("id").alias("uid"), F.timestamp_micros(F.col("id") * 1_000_000).alias("at"))
    options = FeatureOptions(anchor="visits", relationships=[], row_key="vid", lag_periods=[1], sequence_columns=["spent"])
    options.prune.protect = ["vid", "spent_lag_1"]
    built = build_feature_matrix({"visits": visits, "users": users}, options)
    assert built.time == "at" and "spent_lag_1" in built.df.columns
    assert build_feature_matrix({"visits": visits}, options).time is None


def test_auc_does_not_round(spark):
    rows = [(0, 0.50001), (1, 0.50002), (0, 0.50003), (1, 0.50004)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert me.roc_auc(df, "label", "score").first()["roc_auc"] == 0.75
    assert me.roc_auc(df.where("label = 1"), "label", "score").first()["roc_auc"] is None
