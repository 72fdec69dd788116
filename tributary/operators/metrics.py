"""Scores of predictions against labels."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import quoted
from tributary.operators.sequence import running_sum
from tributary.operators.skew import HOT_ROWS, lookup_join


#: Copies of one row that one task writes out; more are dealt to other tasks.
COPIES = 1_000


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``accuracy`` over rows that have both."""
    same = (quoted(label).cast("double") == quoted(prediction).cast("double")).cast("double")
    return df.agg(F.avg(same).alias("accuracy"))


def rmse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    error = quoted(label).cast("double") - quoted(prediction).cast("double")
    return df.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """``roc_auc`` by ranks with ties, of the scores as they are. Null if a class is absent.

    Distinct scores are sorted in slices across the cluster, so any number of them will do.
    """
    tallies = df.where(quoted(label).isNotNull() & quoted(score).isNotNull()).groupBy(quoted(score).alias("score")).agg(
        F.count_if(quoted(label) == 1).alias("pos"), F.count_if(quoted(label) == 0).alias("neg")
    )
    ranked = running_sum(tallies, ["score"], "neg", "upto").withColumn("below", F.col("upto") - F.col("neg"))
    wins = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg((wins / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def roc_auc_unrounded(df: DataFrame, label: str, score: str) -> float:
    """The same over all distinct scores, range-sorted across the cluster."""
    evaluator = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, numBins=0)
    return evaluator.evaluate(df.select(quoted(label).cast("double").alias(label), quoted(score).alias(score)))


def log_loss(df: DataFrame, label: str, score: str) -> DataFrame:
    """``log_loss`` of the probability of class 1, kept away from 0 and 1 by 1e-15."""
    p = F.least(F.greatest(quoted(score).cast("double"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(quoted(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    return df.where(quoted(label).isNotNull()).agg(F.avg(loss).alias("log_loss"))


def f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``f1`` of class 1; 0 if it neither occurs nor is predicted."""
    actual, said = quoted(label) == 1, quoted(prediction) == 1
    hits, both = F.count_if(actual & said), F.count_if(actual) + F.count_if(said)
    return df.agg(F.coalesce(2 * hits / F.nullif(both, F.lit(0)), F.lit(0.0)).alias("f1"))


def mae(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.abs(quoted(label).cast("double") - quoted(prediction).cast("double"))).alias("mae"))


def r2(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``r2``: share of the label's variance that the prediction explains; null if it has none."""
    y, error = quoted(label).cast("double"), quoted(label).cast("double") - quoted(prediction).cast("double")
    return df.agg((1 - F.avg(error * error) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"))


#: Metrics by name, and the column of a scored table that each judges.
METRICS = {
    "accuracy": (accuracy, "prediction"),
    "roc_auc": (roc_auc, "probability"),
    "log_loss": (log_loss, "probability"),
    "f1": (f1, "prediction"),
    "rmse": (rmse, "prediction"),
    "mae": (mae, "prediction"),
    "r2": (r2, "prediction"),
}
LOWER_IS_BETTER = {"log_loss", "rmse", "mae"}


def metric_value(scored: DataFrame, label: str, metric: str) -> float | None:
    """One metric of a scored table; null where it isn't defined."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    measure, judged = METRICS[metric]
    return measure(scored, label, judged).first()[metric]


def check_metric(value: float | None, metric: str, minimum: float | None, *, lower_is_better: bool | None = None) -> None:
    """An error if ``value`` misses the bar; which way is better follows from the metric's name unless told."""
    lower = metric in LOWER_IS_BETTER if lower_is_better is None else lower_is_better
    if minimum is None:
        return
    if value is None or not (value <= minimum if lower else value >= minimum):
        raise ValueError(f"{metric} is {value}, the bar is {minimum}")


def metric_gate(metrics: DataFrame, metric: str, minimum: float | None, *, lower_is_better: bool | None = None) -> DataFrame:
    """Pass the metrics on if ``metric`` reaches the bar, else raise."""
    if minimum is not None:
        check_metric(metrics.select(quoted(metric)).first()[0], metric, minimum, lower_is_better=lower_is_better)
    return metrics


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, rows, weight`` with weight n / (classes * rows of the class)."""
    counts = df.where(quoted(label).isNotNull()).groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(totals)).select(
        quoted(label), "rows", (F.col("n") / (F.col("k") * F.col("rows"))).alias("weight")
    )


def with_class_weight(df: DataFrame, label: str, *, name: str = "weight", hot_rows: int = HOT_ROWS) -> DataFrame:
    weights = class_weights(df, label).select(quoted(label).alias("__class"), F.col("weight").alias(name))
    return lookup_join(df, weights, label, "__class", hot_rows=hot_rows)


def oversample(df: DataFrame, label: str, *, max_ratio: float = 10.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Repeat rows of rare classes until no class is over ``max_ratio`` times smaller than the largest."""
    counts = class_weights(df, label).select(quoted(label).alias("__class"), "rows")
    largest = counts.agg(F.max("rows").alias("most"))
    times = counts.crossJoin(F.broadcast(largest)).select(
        "__class", F.ceil(F.col("most") / (F.col("rows") * F.lit(float(max_ratio)))).cast("int").alias("__times")
    )
    joined = lookup_join(df, times, label, "__class", hot_rows=hot_rows)
    wanted = F.greatest(F.coalesce("__times", F.lit(1)), F.lit(1))
    # A row gives one row per block of copies first; the blocks go to different tasks before they are written out.
    block = F.explode(F.sequence(F.lit(0), F.floor((wanted - 1) / COPIES).cast("int")))
    blocks = joined.select("*", block.alias("__block"), F.monotonically_increasing_id().alias("__row"))
    # A stated number of tasks stays, while Spark would join tasks that have little to read, though much to write.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = blocks.where(wanted > COPIES).repartition(tasks, "__row", "__block")
    dealt = blocks.where(wanted <= COPIES).unionByName(often)
    here = F.least(F.lit(COPIES), wanted - F.col("__block") * COPIES)
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1), here))).drop("__copy", "__times", "__block", "__row")
