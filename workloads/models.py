"""Queries that prepare features, fit models and score predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import clip, numeric_columns
from tributary.operators import metrics
from tributary.operators import models as m
from tributary.operators.profile import Relationship
from tributary.operators.search import search_models
from tributary.operators.split import split_random, train_test
from tributary.plans.features import FeatureOptions, build_feature_matrix
from tributary.plans.training import TrainOptions, read_record, train_and_evaluate, write_run
from tributary.session import shared_dir
from workloads import risk
from workloads import tables as t
from workloads.tables import load, md5_number_sql, rounded, rounded_sql

WIDTH = 64
FEATURES = [f"f{i:02d}" for i in range(WIDTH)]


def _vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as columns; the upper half of the labels is class 1, component 0 has gaps."""
    df = load(spark, sf_dir, "embeddings")
    parts = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(FEATURES)]
    parts[0] = F.when(F.col("vec_id") % 10 != 0, F.get("embedding", F.lit(0)).cast("double")).alias(FEATURES[0])
    return df.select("vec_id", *parts, (F.col("label") >= 5).cast("int").alias("target"))


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return train_test(split_random(_vectors(spark, sf_dir), "vec_id"))


def _metric_rows(spark, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted((k, float(v)) for k, v in values.items()), "metric string, value double")


def impute_median(spark, sf_dir) -> DataFrame:
    """Totals of pending orders are missing; the training rows give the median."""
    total = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", total.alias("total"))
    train, _ = train_test(split_random(orders, "o_orderkey"))
    return m.Imputer.fit(train, ["total"]).transform(orders).select("o_orderkey", rounded(F.col("total"), 4).alias("total"))


_IN_TRAIN = f"{md5_number_sql(chr(39) + '42:' + chr(39) + ' || o_orderkey')} / 4294967296.0 < 0.8"
IMPUTE_SQL = f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS total FROM orders),
med AS (SELECT quantile_cont(total, 0.5) AS v FROM o WHERE {_IN_TRAIN})
SELECT o_orderkey, {rounded_sql("coalesce(total, (SELECT v FROM med))", 4)} AS total FROM o"""


def standard_scale(spark, sf_dir) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", F.lit(3.0).alias("same"))
    scaler = m.Scaler.fit(lines, ["l_quantity", "l_extendedprice", "same"])
    out = scaler.transform(lines)
    return out.select("l_orderkey", *[rounded(F.col(c), 6).alias(c) for c in ("l_quantity", "l_extendedprice", "same")])


SCALE_SQL = f"""
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                  stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, {rounded_sql("(l_quantity - mq) / sq", 6)} AS l_quantity,
       {rounded_sql("(l_extendedprice - mp) / sp", 6)} AS l_extendedprice, 0.0::DOUBLE AS same
FROM lineitem, s"""


def class_weights(spark, sf_dir) -> DataFrame:
    out = metrics.class_weights(load(spark, sf_dir, "labels"), "quality")
    return out.select("quality", F.col("rows").alias("n"), rounded(F.col("weight"), 8).alias("weight"))


WEIGHTS_SQL = f"""
WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)
SELECT quality, n, {rounded_sql("(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)", 8)} AS weight FROM c"""


def oversample(spark, sf_dir) -> DataFrame:
    """Rows per class once the toxic ones are repeated to half of the rest."""
    out = metrics.oversample(load(spark, sf_dir, "labels"), "toxic", max_ratio=2.0)
    return out.groupBy("toxic").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


OVERSAMPLE_SQL = """
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
SELECT l.toxic, count(*) * CAST(greatest(1, ceil((SELECT max(n) FROM c) / (max(c.n) * 2.0))) AS BIGINT) AS n,
       count(DISTINCT doc_id) AS n_distinct
FROM labels l JOIN c ON c.toxic = l.toxic GROUP BY 1"""


def _predictions(spark, sf_dir) -> DataFrame:
    """A rule that guesses finished orders from total and priority."""
    orders = load(spark, sf_dir, "orders")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 0.25).otherwise(0.0)
    score = F.col("o_totalprice") / 1000000.0 + urgent
    label = (F.col("o_orderstatus") == "F").cast("int")
    return orders.select(
        label.alias("label"), score.alias("score"), (score > 0.4).cast("int").alias("prediction"), "o_totalprice"
    )


PREDICTIONS_SQL = """WITH p AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice,
         o_totalprice / 1000000.0::DOUBLE + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.25::DOUBLE ELSE 0 END AS score
  FROM orders)"""


def metric_accuracy(spark, sf_dir) -> DataFrame:
    return metrics.accuracy(_predictions(spark, sf_dir), "label", "prediction").select(rounded(F.col("accuracy"), 8).alias("accuracy"))


def metric_auc(spark, sf_dir) -> DataFrame:
    return metrics.roc_auc(_predictions(spark, sf_dir), "label", "score").select(rounded(F.col("roc_auc"), 8).alias("roc_auc"))


AUC_SQL = f"""
{PREDICTIONS_SQL},
b AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
      FROM p GROUP BY 1),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
SELECT {rounded_sql("sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))", 8)} AS roc_auc FROM w"""


def metric_rmse(spark, sf_dir) -> DataFrame:
    """Predicting every order's total by its customer's mean."""
    orders = load(spark, sf_dir, "orders")
    means = orders.groupBy(F.col("o_custkey").alias("buyer")).agg(F.avg("o_totalprice").alias("expected"))
    both = orders.join(means, F.col("o_custkey") == F.col("buyer"))
    return metrics.rmse(both, "o_totalprice", "expected").select(rounded(F.col("rmse"), 4).alias("rmse"))


RMSE_SQL = f"""
SELECT {rounded_sql("sqrt(avg((o_totalprice - expected) * (o_totalprice - expected)))", 4)} AS rmse
FROM (SELECT o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS expected FROM orders)"""


def _fit_and_score(spark, sf_dir, options: m.ModelOptions) -> DataFrame:
    train, test = _halves(spark, sf_dir)
    return _metric_rows(spark, m.evaluate(m.fit_model(train, FEATURES, "target", options, key="vec_id"), test))


def train_logistic(spark, sf_dir) -> DataFrame:
    return _fit_and_score(spark, sf_dir, m.ModelOptions("logistic"))


def train_forest(spark, sf_dir) -> DataFrame:
    return _fit_and_score(spark, sf_dir, m.ModelOptions("forest", balanced=True))


def train_boosted(spark, sf_dir) -> DataFrame:
    """Up to 100 rounds, cut at the best one on held-out training rows."""
    return _fit_and_score(spark, sf_dir, m.ModelOptions("boosted"))


def train_regression(spark, sf_dir) -> DataFrame:
    """Price of a line from all its other numbers, by a forest of regression trees."""
    lines = load(spark, sf_dir, "lineitem")
    columns = numeric_columns(lines, skip=["l_extendedprice"])
    train, test = train_test(split_random(lines.select(*columns, "l_extendedprice"), "l_orderkey"))
    return _metric_rows(spark, m.evaluate(m.fit_model(train, columns, "l_extendedprice", m.ModelOptions("forest", task=m.REGRESSION)), test))


def model_search(spark, sf_dir) -> DataFrame:
    """Trials of a search by log loss within ten minutes, on growing samples."""
    train, _ = _halves(spark, sf_dir)
    candidates = [
        m.ModelOptions("logistic"),
        m.ModelOptions("logistic", inverse_penalty=0.01),
        m.ModelOptions("logistic", inverse_penalty=0.0001),
        m.ModelOptions("forest"),
    ]
    found = search_models(train, FEATURES, "target", candidates, "log_loss", key="vec_id", seconds=600, least_rows=200)
    return found.report(spark)


#: Lines of both sides by order, and the price's line over the quantity, fitted where asked.
_LINES = f"""WITH l AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
         {md5_number_sql("'42:' || l_orderkey")} / 4294967296.0 < 0.8 AS train, {md5_number_sql("'42:' || l_orderkey")} % 5 AS fold
  FROM lineitem)"""
#: A penalty of next to nothing, so that the closed form holds.
_PLAIN = m.ModelOptions("linear", task=m.REGRESSION, inverse_penalty=1e12)


def _lines(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def train_linear(spark, sf_dir) -> DataFrame:
    """Test rows scored by a line that the training rows give; batch scoring of a model in closed form."""
    train, test = train_test(split_random(_lines(spark, sf_dir), "l_orderkey"))
    model = m.fit_model(train, ["l_quantity"], "l_extendedprice", _PLAIN, key="l_orderkey")
    return model.score(test).select("l_orderkey", "l_linenumber", rounded(F.col("prediction"), 3).alias("prediction"))


LINEAR_SQL = f"""{_LINES},
fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM l WHERE train)
SELECT l_orderkey, l_linenumber, {rounded_sql("i + s * l_quantity", 3)} AS prediction FROM l, fit WHERE NOT train"""


def saved_model(spark, sf_dir) -> DataFrame:
    """The same by the model as it comes back from its folder."""
    train, test = train_test(split_random(_lines(spark, sf_dir), "l_orderkey"))
    folder = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    m.fit_model(train, ["l_quantity"], "l_extendedprice", _PLAIN, key="l_orderkey").save(folder)
    scored = m.FittedModel.load(folder).score(test)
    return scored.select("l_orderkey", "l_linenumber", rounded(F.col("prediction"), 3).alias("prediction"))


def oof_linear(spark, sf_dir) -> DataFrame:
    """Every line scored by the line of the four folds it is not in."""
    scored = m.out_of_fold(_lines(spark, sf_dir).withColumn("quantity", F.col("l_quantity")), ["quantity"], "l_extendedprice", "l_orderkey", _PLAIN)
    return scored.select("l_orderkey", "fold", rounded(F.col("prediction"), 3).alias("prediction"))


OOF_SQL = f"""{_LINES},
fit AS (SELECT f AS fold, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i
        FROM l, range(5) AS folds(f) WHERE l.fold <> f GROUP BY f)
SELECT l_orderkey, l.fold, {rounded_sql("i + s * l_quantity", 3)} AS prediction FROM l JOIN fit ON fit.fold = l.fold"""


def metric_gate(spark, sf_dir) -> DataFrame:
    """The accuracy of the guess, which passes a bar of 0.1."""
    found = metrics.metric_gate(metrics.accuracy(_predictions(spark, sf_dir), "label", "prediction"), "accuracy", 0.1)
    return found.select(rounded(F.col("accuracy"), 8).alias("accuracy"))


def metrics_by_name(spark, sf_dir) -> DataFrame:
    """Log loss, F1, mean absolute error and explained variance of the guess."""
    guess = _predictions(spark, sf_dir).withColumn("probability", clip(F.col("score"), 0.01, 0.99))
    one_row = metrics.log_loss(guess, "label", "probability")
    for measure in (metrics.f1, metrics.mae, metrics.r2):
        one_row = one_row.crossJoin(measure(guess, "label", "prediction"))
    return one_row.select(*[rounded(F.col(c), 8).alias(c) for c in ("log_loss", "f1", "mae", "r2")])


METRICS_SQL = f"""{PREDICTIONS_SQL},
g AS (SELECT label, CASE WHEN score > 0.4::DOUBLE THEN 1 ELSE 0 END AS said, greatest(0.01::DOUBLE, least(0.99::DOUBLE, score)) AS s FROM p)
SELECT {rounded_sql("-avg(CASE WHEN label = 1 THEN ln(s) ELSE ln(1.0::DOUBLE - s) END)", 8)} AS log_loss,
       {rounded_sql("2.0 * sum(label * said) / (sum(label) + sum(said))", 8)} AS f1,
       {rounded_sql("avg(abs(label - said))", 8)} AS mae,
       {rounded_sql("1.0 - avg((label - said) * (label - said)) / var_pop(label)", 8)} AS r2 FROM g"""


def batch_score(spark, sf_dir) -> DataFrame:
    train, test = _halves(spark, sf_dir)
    model = m.fit_model(train, FEATURES, "target", m.ModelOptions("logistic"), key="vec_id")
    return model.score(test).select("vec_id", "prediction", "probability")


def oof_predictions(spark, sf_dir) -> DataFrame:
    return m.out_of_fold(_vectors(spark, sf_dir), FEATURES, "target", "vec_id", m.ModelOptions("logistic"))


def feature_importance(spark, sf_dir) -> DataFrame:
    train, _ = _halves(spark, sf_dir)
    model = m.fit_model(train, FEATURES, "target", m.ModelOptions("forest"), key="vec_id")
    return spark.createDataFrame(model.importance(), "feature string, importance double")


ACTIVITY = [
    Relationship("users", "user_id", "devices", "user_id"),
    Relationship("users", "user_id", "logins", "user_id"),
    Relationship("users", "user_id", "transactions", "user_id"),
]


def training_run(spark, sf_dir) -> DataFrame:
    """Labelled users, synthesised and pruned features, a stratified split and a model, end to end.

    The record of the run, as it is read back from the folder that has the matrix and the model.
    """
    tables = {
        "users": risk.risk_labels(spark, sf_dir).select("user_id", "account_type", "country", "income", "signup_date", "is_fraud"),
        "transactions": t.transactions(spark, sf_dir),
        "logins": t.logins(spark, sf_dir),
        "devices": t.devices(spark, sf_dir),
    }
    keys = {"users": ["user_id"], "transactions": ["transaction_id"], "logins": ["login_id"], "devices": []}
    options = FeatureOptions(anchor="users", relationships=ACTIVITY, keys=keys, row_key="user_id", deep=True)
    options.prune.protect = ["user_id", "is_fraud"]
    matrix = build_feature_matrix(tables, options)
    asked = TrainOptions(target="is_fraud", row_key="user_id", stratum="is_fraud", encode_text=True, model=m.ModelOptions("logistic", balanced=True))
    folder = write_run(train_and_evaluate(matrix.df, asked), matrix.df, f"{shared_dir(spark)}/runs")
    kept = ["run_id", "data_fingerprint", "backend", "kind", "task", "hyperparameters", "features", "train_rows", "test_rows", "accuracy"]
    record = read_record(spark, folder)
    return spark.createDataFrame([tuple(record[k] for k in kept)], kept)


QUERIES = {
    "impute_median": impute_median,
    "standard_scale": standard_scale,
    "class_weights": class_weights,
    "oversample": oversample,
    "metric_accuracy": metric_accuracy,
    "metric_auc": metric_auc,
    "metric_rmse": metric_rmse,
    "metric_gate": metric_gate,
    "metrics_by_name": metrics_by_name,
    "train_linear": train_linear,
    "saved_model": saved_model,
    "oof_linear": oof_linear,
    "train_logistic": train_logistic,
    "train_forest": train_forest,
    "train_boosted": train_boosted,
    "train_regression": train_regression,
    "model_search": model_search,
    "batch_score": batch_score,
    "oof_predictions": oof_predictions,
    "feature_importance": feature_importance,
    "training_run": training_run,
}

ORACLES = {
    "impute_median": IMPUTE_SQL,
    "standard_scale": SCALE_SQL,
    "class_weights": WEIGHTS_SQL,
    "oversample": OVERSAMPLE_SQL,
    "metric_accuracy": f"""{PREDICTIONS_SQL}
        SELECT {rounded_sql("avg(CASE WHEN (score > 0.4::DOUBLE) = (label = 1) THEN 1.0 ELSE 0.0 END)", 8)} AS accuracy FROM p""",
    "metric_auc": AUC_SQL,
    "metric_gate": f"""{PREDICTIONS_SQL}
        SELECT {rounded_sql("avg(CASE WHEN (score > 0.4::DOUBLE) = (label = 1) THEN 1.0 ELSE 0.0 END)", 8)} AS accuracy FROM p""",
    "metrics_by_name": METRICS_SQL,
    "train_linear": LINEAR_SQL,
    "saved_model": LINEAR_SQL,
    "oof_linear": OOF_SQL,
    "metric_rmse": RMSE_SQL,
}
