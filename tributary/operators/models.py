"""Preparing features and fitting models with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.columns import hash_fraction, quoted
from tributary.operators.forest import MOST_DEPTH, fit_forest, in_memory_bytes
from tributary.operators.metrics import accuracy, rmse, roc_auc_unrounded, with_class_weight
from tributary.operators.quantiles import exact_quantiles
from tributary.operators.split import assign_folds
from tributary.session import durable, in_parallel
from tributary.sources.tables import union_rows

CLASSIFICATION, REGRESSION = "classification", "regression"
MAX_TREE_DEPTH = 30  # the deepest tree Spark ML grows
#: Regression forests whose rows would take more memory in Spark ML's own are fitted from blocks.
FOREST_BYTES = 512 << 20


@dataclass
class Imputer:
    """Exact medians of the training rows; what replaces a null."""

    medians: dict[str, float | None]

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str]) -> Imputer:
        found = exact_quantiles(train, columns, [0.5])
        return Imputer({c: found[c][0] for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[
            F.coalesce(quoted(c).cast("double"), F.lit(self.medians[c]).cast("double"), F.lit(0.0)).alias(c)
            if c in self.medians
            else quoted(c)
            for c in df.columns
        ])


@dataclass
class Scaler:
    """Mean 0 and population deviation 1; a column without spread is only centred."""

    means: dict[str, float]
    deviations: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str]) -> Scaler:
        row = train.agg(*[
            part
            for i, c in enumerate(columns)
            for part in (F.avg(quoted(c)).alias(f"m{i}"), F.stddev_pop(quoted(c)).alias(f"s{i}"))
        ]).first()
        return Scaler(
            {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)},
            {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)},
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[
            ((quoted(c) - F.lit(self.means[c])) / F.lit(self.deviations[c])).alias(c) if c in self.means else quoted(c)
            for c in df.columns
        ])


@dataclass
class ModelOptions:
    kind: str = "logistic"  # logistic, linear, forest or boosted
    task: str = CLASSIFICATION
    seed: int = 42
    trees: int = 100
    rounds: int = 100
    max_depth: int = 5
    max_iter: int = 2_000
    inverse_penalty: float = 1.0
    balanced: bool = False
    early_stopping: bool = True
    patience: int = 50
    validation_share: float = 0.1


@dataclass
class FittedModel:
    """Preparation and model learnt from the training rows."""

    features: list[str]
    label: str
    options: ModelOptions
    imputer: Imputer
    scaler: Scaler
    pipeline: PipelineModel = field(repr=False)

    def prepare(self, df: DataFrame) -> DataFrame:
        return _with_vector(self.scaler.transform(self.imputer.transform(df)), self.features)

    def score(self, df: DataFrame) -> DataFrame:
        """The rows with ``prediction``, and ``probability`` of class 1 for a two-class model."""
        return self.score_prepared(self.prepare(df))

    def score_prepared(self, ready: DataFrame) -> DataFrame:
        """The same for rows that have their vector."""
        scored = self.pipeline.transform(ready)
        if self.options.task == CLASSIFICATION:
            scored = scored.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
        return scored.drop("__features", "rawPrediction", "weight")

    def importance(self) -> list[tuple[str, float]]:
        """Weight of each feature: tree importance, or the size of a linear coefficient."""
        model = self.pipeline.stages[-1]
        if hasattr(model, "featureImportances"):
            values = model.featureImportances.toArray()
        elif hasattr(model, "coefficientMatrix"):
            values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
        else:
            values = abs(model.coefficients.toArray())
        return sorted(zip(self.features, map(float, values)), key=lambda fv: (-fv[1], fv[0]))

    def save(self, path: str) -> None:
        """Write the model, and the preparation as one row per feature."""
        self.pipeline.write().overwrite().save(f"{path}/model")
        rows = [
            (i, c, self.imputer.medians[c], float(self.scaler.means[c]), float(self.scaler.deviations[c]))
            for i, c in enumerate(self.features)
        ]
        described = SparkSession.active().createDataFrame(
            rows, "position int, feature string, median double, mean double, deviation double"
        ).withColumns({"label": F.lit(self.label), "options": F.lit(json.dumps(asdict(self.options)))})
        described.write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(path: str) -> FittedModel:
        rows = SparkSession.active().read.parquet(f"{path}/features").orderBy("position").collect()
        names = [r["feature"] for r in rows]
        return FittedModel(
            names,
            rows[0]["label"],
            ModelOptions(**json.loads(rows[0]["options"])),
            Imputer({r["feature"]: r["median"] for r in rows}),
            Scaler({r["feature"]: r["mean"] for r in rows}, {r["feature"]: r["deviation"] for r in rows}),
            PipelineModel.load(f"{path}/model"),
        )


def _with_vector(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Feature names may hold dots and brackets, so columns are packed by expression."""
    return df.withColumn("__features", array_to_vector(F.array(*[quoted(c) for c in names])))


def _estimator(o: ModelOptions, rows: int, label: str):
    common = {"featuresCol": "__features", "labelCol": label}
    weight = {"weightCol": "weight"} if o.balanced and o.task == CLASSIFICATION else {}
    # The penalty of the summed loss, as Spark minimises the mean loss.
    penalty = 1.0 / (o.inverse_penalty * max(rows, 1))
    if o.kind == "logistic":
        return LogisticRegression(maxIter=o.max_iter, regParam=penalty, standardization=False, **weight, **common)
    if o.kind == "linear":
        return LinearRegression(maxIter=o.max_iter, regParam=penalty, standardization=False, **common)
    depth = min(o.max_depth, MAX_TREE_DEPTH)
    if o.kind == "forest":
        if o.task == CLASSIFICATION:
            return RandomForestClassifier(numTrees=o.trees, maxDepth=depth, seed=o.seed, **weight, **common)
        return RandomForestRegressor(numTrees=o.trees, maxDepth=depth, seed=o.seed, **common)
    if o.kind == "boosted":
        cls = GBTClassifier if o.task == CLASSIFICATION else GBTRegressor
        return cls(maxIter=o.rounds, maxDepth=depth, seed=o.seed, **weight, **common)
    raise ValueError(f"unknown model kind {o.kind}")


def best_round(losses: Sequence[float], patience: int) -> int:
    """The round of the least loss, as met before ``patience`` rounds in a row bring no lower one; rounds count from 1."""
    least, at = float("inf"), 1
    for i, loss in enumerate(losses, 1):
        if loss < least:
            least, at = loss, i
        elif i - at >= patience:
            break
    return at


@dataclass
class Training:
    """Rows ready to fit: vector, label and two hashes of the key, if they were asked for; written once, read by every fit."""

    features: list[str]
    label: str
    imputer: Imputer
    scaler: Scaler
    ready: DataFrame

    def where(self, condition: Column) -> Training:
        return replace(self, ready=self.ready.where(condition))

    def fit(self, o: ModelOptions) -> FittedModel:
        """A model of these rows.

        Boosting with early stopping learns from all but ``validation_share`` of
        them. The loss of every round on that share comes from one scan, which
        adds each row's trees up one by one. If ``patience`` rounds in a row are
        no better than an earlier one, the rounds up to the best are fitted
        alone: the same trees, as a round depends on those before it only.
        """
        weighted = o.balanced and o.task == CLASSIFICATION and o.kind != "linear"
        ready = with_class_weight(self.ready, self.label) if weighted else self.ready
        if o.kind == "boosted" and o.early_stopping and o.validation_share > 0:
            held_out = F.col(HASH) < F.lit(o.validation_share)
            check = ready.where(held_out)
            if not check.isEmpty():
                return self._fit_with_patience(o, ready.where(~held_out), check)
        return self._fitted(o, ready)

    def _fit_with_patience(self, o: ModelOptions, rows: DataFrame, check: DataFrame) -> FittedModel:
        model = self._fitted(o, rows)
        stages = model.pipeline.stages[-1]
        losses = stages.evaluateEachIteration(check) if o.task == CLASSIFICATION else stages.evaluateEachIteration(check, "squared")
        best = best_round(losses, o.patience)
        if best < o.rounds:
            model = replace(self._fitted(replace(o, rounds=best), rows), options=o)
        return model

    def _fitted(self, o: ModelOptions, rows: DataFrame) -> FittedModel:
        # The penalty of linear models needs the number of rows, and so does the choice of the forest's way.
        forest = o.kind == "forest" and o.task == REGRESSION and 1 <= o.max_depth <= MOST_DEPTH
        n = rows.count() if forest or o.kind in ("logistic", "linear") else 0
        estimator = _estimator(o, n, self.label)
        if forest and in_memory_bytes(n, len(self.features), o.trees) > FOREST_BYTES:
            pipeline = PipelineModel([fit_forest(rows, estimator, n)])
        else:
            pipeline = Pipeline(stages=[estimator]).fit(rows)
        return FittedModel(self.features, self.label, o, self.imputer, self.scaler, pipeline)


#: Numbers in [0, 1) by hash of a row's key: one decides which rows stop the boosting, the other is for samples of rows.
HASH, PART = "__hash", "__part"


def prepare_training(
    train: DataFrame, features: Sequence[str], label: str, *, key: str | None = None, seed: int = 42,
    imputer: Imputer | None = None, scaler: Scaler | None = None, hashed: bool = True,
) -> Training:
    """Medians, means and deviations of the training rows, and their vectors, written to the shared folder.

    Spark ML keeps what its iterations need by itself, so nothing is cached here
    and a lost executor costs a read. ``key`` decides a row's hash, else its features do;
    ``hashed=False`` leaves the hashes out, which only boosting and samples read.
    Rows that the medians are still wanted of are written before: those take many passes.
    """
    names = list(features)
    if imputer is None:
        train = durable(train.select(*[quoted(c) for c in dict.fromkeys([*names, label, *([key] if key else [])])]), "train")
    known = train.where(quoted(label).isNotNull())
    imputer = imputer or Imputer.fit(train, names)
    filled = imputer.transform(train)
    scaler = scaler or Scaler.fit(filled, names)
    pick = [quoted(key)] if key else [quoted(c) for c in names]
    hashes = {HASH: hash_fraction(seed, *pick), PART: hash_fraction(seed + 1, *pick)} if hashed else {}
    ready = _with_vector(scaler.transform(imputer.transform(known.withColumns(hashes))), names)
    ready = ready.select("__features", quoted(label).cast("double").alias(label), *hashes)
    return Training(names, label, imputer, scaler, durable(ready, "training"))


def fit_model(
    train: DataFrame, features: Sequence[str], label: str, options: ModelOptions | None = None, *, key: str | None = None
) -> FittedModel:
    """Impute medians, scale, and fit on the training rows; rows without a label only help to impute and scale."""
    o = options or ModelOptions()
    return prepare_training(train, features, label, key=key, seed=o.seed, hashed=o.kind == "boosted").fit(o)


def evaluate(model: FittedModel, test: DataFrame) -> dict[str, float]:
    """Accuracy and ROC AUC for classes, RMSE otherwise; AUC is left out if undefined."""
    scored = model.score(test)
    if model.options.task == REGRESSION:
        return {"rmse": rmse(scored, model.label, "prediction").first()["rmse"]}
    out = {"accuracy": accuracy(scored, model.label, "prediction").first()["accuracy"]}
    classes = scored.agg(F.min(quoted(model.label)), F.max(quoted(model.label))).first()
    if tuple(classes) == (0, 1):
        out["roc_auc"] = roc_auc_unrounded(scored, model.label, "probability")
    return out


def fold_preparations(marked: DataFrame, names: Sequence[str], folds: int) -> list[tuple[Imputer, Scaler]]:
    """For each fold the medians, means and deviations of all other rows of ``marked``, which has ``fold``.

    All folds' medians come from the same passes. Means and deviations come from
    one more, by fold: counts, means and sums of squares of parts add up.
    """
    columns = {(i, c): f"{i}_{n}" for i in range(folds) for n, c in enumerate(names)}
    apart = marked.select(*[F.when(F.col("fold") != i, quoted(c)).alias(a) for (i, c), a in columns.items()])
    medians = exact_quantiles(apart, list(columns.values()), [0.5])
    parts = marked.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *[
        part
        for n, c in enumerate(names)
        for part in (F.count(quoted(c)).alias(f"n{n}"), F.avg(quoted(c)).alias(f"m{n}"), F.var_pop(quoted(c)).alias(f"v{n}"))
    ]).collect()
    out = []
    for i in range(folds):
        imputer = Imputer({c: medians[columns[i, c]][0] for c in names})
        others = [p for p in parts if p["fold"] != i]
        means, deviations = {}, {}
        for n, c in enumerate(names):
            known = [(p[f"n{n}"], p[f"m{n}"], p[f"v{n}"]) for p in others if p[f"n{n}"]]
            missing = sum(p["rows"] - p[f"n{n}"] for p in others)
            pieces = known + ([(missing, imputer.medians[c] or 0.0, 0.0)] if missing else [])
            total = sum(k for k, _, _ in pieces)
            mean = sum(k * m for k, m, _ in pieces) / total if total else 0.0
            spread = sum(k * (v + (m - mean) ** 2) for k, m, v in pieces) / total if total else 0.0
            means[c], deviations[c] = mean, spread**0.5 or 1.0
        out.append((imputer, Scaler(means, deviations)))
    return out


def out_of_fold(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    options: ModelOptions | None = None,
    *,
    folds: int = 5,
    seed: int = 42,
    at_once: int | None = None,
) -> DataFrame:
    """Every row scored by the model of the folds it is not in.

    The rows are written once with their fold, and what is learnt for imputing
    and scaling comes from passes over all folds at once. The folds are fitted
    at the same time, ``at_once`` of them, each in a scheduler pool of its own.
    """
    o = options or ModelOptions()
    names = list(features)
    marked = assign_folds(df.select(*[quoted(c) for c in dict.fromkeys([key, label, *names])]), key, folds, seed, name="fold")
    marked = durable(marked, "folds")
    learnt = fold_preparations(marked, names, folds)

    def fit(i: int) -> FittedModel:
        imputer, scaler = learnt[i]
        rows = marked.where(F.col("fold") != i)
        return prepare_training(rows, names, label, key=key, seed=o.seed, imputer=imputer, scaler=scaler).fit(o)

    fitted = in_parallel(df.sparkSession, [partial(fit, i) for i in range(folds)], at_once or folds)
    parts = []
    for i, model in enumerate(fitted):
        held = model.score(marked.where(F.col("fold") == i))
        kept = [key, label, "fold", "prediction"] + (["probability"] if "probability" in held.columns else [])
        parts.append(held.select(*[quoted(c) for c in kept]))
    return union_rows(*parts)
