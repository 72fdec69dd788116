"""Split, fit, score and report on a feature matrix."""

from __future__ import annotations

import hashlib
import json
import time as clock
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import numeric_columns
from tributary.operators.joins import encode_categories
from tributary.operators.metrics import check_metric, metric_value
from tributary.operators.models import CLASSIFICATION, REGRESSION, FittedModel, ModelOptions, evaluate, fit_model
from tributary.operators.search import SearchResult, search_models
from tributary.operators.split import split_auto, train_test
from tributary.session import durable
from tributary.sources.fingerprint import content_fingerprint
from tributary.sources.tables import write_features

BACKEND = "spark-ml"


@dataclass
class TrainOptions:
    target: str
    row_key: str
    task: str = CLASSIFICATION
    model: ModelOptions | None = None
    candidates: Sequence[ModelOptions] = ()
    metric: str | None = None
    seconds: float | None = None
    minimum: float | None = None
    train_size: float = 0.8
    seed: int = 42
    strategy: str = "auto"
    time: str | None = None
    stratum: str | None = None
    group: str | None = None
    encode_text: bool = False


@dataclass
class TrainResult:
    model: FittedModel
    options: TrainOptions
    metrics: dict[str, float]
    rows: dict[str, int]
    seconds: float
    fingerprint: str
    search: SearchResult | None = None

    @property
    def run_id(self) -> str:
        """Digest of the options and of the matrix: the same work has the same name."""
        asked = json.dumps(asdict(self.options), sort_keys=True, default=str)
        return hashlib.sha256(f"{asked}|{self.fingerprint}".encode()).hexdigest()[:16]

    def record(self) -> dict:
        """What was done: run, data digest, backend, settings, rows, metrics and seconds."""
        return {
            "run_id": self.run_id,
            "data_fingerprint": self.fingerprint,
            "backend": BACKEND,
            "kind": self.model.options.kind,
            "task": self.model.options.task,
            "hyperparameters": json.dumps(asdict(self.model.options), sort_keys=True),
            "features": len(self.model.features),
            "train_rows": self.rows["train"],
            "test_rows": self.rows["test"],
            "trials": len(self.search.trials) if self.search else 0,
            "seconds": float(self.seconds),
            **{k: float(v) for k, v in sorted(self.metrics.items())},
        }

    def report(self, spark: SparkSession) -> DataFrame:
        """The record as one row."""
        flat = self.record()
        return spark.createDataFrame([tuple(flat.values())], list(flat))


def train_and_evaluate(matrix: DataFrame, options: TrainOptions) -> TrainResult:
    """Fit on the training rows and score the test rows.

    A missing target is an error; a metric that misses ``minimum`` is one too.
    Codes of text columns are those of the training rows.
    """
    o = options
    if o.task not in (CLASSIFICATION, REGRESSION):
        raise ValueError(f"task {o.task} has no model")
    if o.target not in matrix.columns:
        raise ValueError(f"target {o.target} is not in the feature matrix")
    started = clock.time()
    left_out = {o.target, o.row_key}
    marked = durable(split_auto(
        matrix, o.row_key, o.train_size, o.seed, time=o.time, stratum=o.stratum, group=o.group, strategy=o.strategy
    ), "split")
    fingerprint = content_fingerprint(marked.drop("split")).first()["fingerprint"]
    if o.encode_text:
        texts = [f.name for f in matrix.schema if isinstance(f.dataType, T.StringType) and f.name not in left_out]
        if texts:
            marked = durable(encode_categories(marked, texts, learn_from=train_test(marked)[0]).drop(*texts), "coded")
    train, test = train_test(marked)
    features = numeric_columns(train, skip=left_out)
    default = ModelOptions(kind="logistic" if o.task == CLASSIFICATION else "forest", task=o.task, seed=o.seed)
    search = None
    if o.candidates:
        metric = o.metric or ("roc_auc" if o.task == CLASSIFICATION else "rmse")
        search = search_models(train, features, o.target, o.candidates, metric, key=o.row_key, seconds=o.seconds, seed=o.seed)
        model = search.model
    else:
        model = fit_model(train, features, o.target, o.model or default, key=o.row_key)
    metrics = evaluate(model, test)
    if o.metric and o.metric not in metrics:
        found = metric_value(model.score(test), o.target, o.metric)
        metrics |= {o.metric: found} if found is not None else {}
    name = o.metric or next(iter(metrics))
    check_metric(metrics.get(name), name, o.minimum)
    counts = {r["split"]: r["count"] for r in marked.groupBy("split").count().collect()}
    rows = {side: counts.get(side, 0) for side in ("train", "test")}
    return TrainResult(model, o, metrics, rows, clock.time() - started, fingerprint, search)


def write_run(result: TrainResult, matrix: DataFrame, root: str) -> str:
    """Write matrix, model, trials and record to ``root/run_id`` and return that folder.

    The record is written last and marks the run as whole; what an earlier
    attempt left without one is written over, and a whole run is left as it is.
    """
    spark, folder = matrix.sparkSession, f"{root.rstrip('/')}/{result.run_id}"
    if read_record(spark, folder) is not None:
        return folder
    write_features(matrix, f"{folder}/features")
    result.model.save(f"{folder}/model")
    if result.search:
        result.search.report(spark).write.mode("overwrite").parquet(f"{folder}/trials")
    written = spark.read.parquet(f"{folder}/features")
    record = result.report(spark).withColumn("columns", F.lit(json.dumps(written.dtypes)))
    record.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{folder}/record")
    return folder


def read_record(spark: SparkSession, folder: str) -> dict | None:
    """The record of a whole run, or None; it is one file, which is there whole or not at all."""
    try:
        row = spark.read.json(f"{folder}/record").first()
    except AnalysisException:
        return None
    return row.asDict() if row else None
