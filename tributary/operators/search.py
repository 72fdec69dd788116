"""Model search within a time budget, by successive halving over nested samples."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.metrics import LOWER_IS_BETTER, metric_value
from tributary.operators.models import PART, FittedModel, ModelOptions, Training, fit_model, prepare_training
from tributary.session import Deadline, OutOfTime


@dataclass
class Trial:
    """One candidate fitted on one sample; ``value`` is null if the metric isn't defined there."""

    rung: int
    candidate: int
    kind: str
    share: float
    value: float | None
    seconds: float


@dataclass
class SearchResult:
    model: FittedModel
    winner: int
    metric: str
    trials: list[Trial]
    out_of_time: bool

    def report(self, spark: SparkSession) -> DataFrame:
        """One row per trial."""
        rows = [(t.rung, t.candidate, t.kind, t.share, t.value, t.candidate == self.winner) for t in self.trials]
        return spark.createDataFrame(rows, f"rung int, candidate int, kind string, share double, `{self.metric}` double, won boolean")


def rung_shares(candidates: int, rows: int, cut: int, least_rows: int) -> list[float]:
    """Shares of the rows that the rungs use, the last all of them.

    As many rungs as it takes to cut the candidates down to one, but none whose
    sample would have under ``least_rows`` rows.
    """
    rungs = max(1, math.ceil(math.log(max(candidates, 1), cut) - 1e-9) + 1)
    shares = [float(cut) ** -(rungs - 1 - i) for i in range(rungs)]
    return [s for s in shares if s * rows >= least_rows or s == 1.0]


def _rank(value: float | None, metric: str) -> float:
    if value is None or math.isnan(value):
        return math.inf
    return value if metric in LOWER_IS_BETTER else -value


def _leader(trials: Sequence[Trial], metric: str) -> int:
    """Best candidate of the highest rung that any reached; ties go to the first."""
    top = max(t.rung for t in trials)
    return min((t for t in trials if t.rung == top), key=lambda t: (_rank(t.value, metric), t.candidate)).candidate


def search_models(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    candidates: Sequence[ModelOptions],
    metric: str,
    *,
    key: str,
    seconds: float | None = None,
    cut: int = 3,
    least_rows: int = 1_000,
    validation_share: float = 0.2,
    seed: int = 42,
) -> SearchResult:
    """Try the candidates for at most ``seconds``; the best is fitted on all training rows.

    The rows are prepared and written once. ``validation_share`` of them, by hash
    of ``key``, judge every trial; the others are learnt from. The first rung
    fits all candidates on a small sample, the best ``1 / cut`` of them go on to
    a sample ``cut`` times as large that holds the smaller one, until one rung
    learns from all rows; so most time goes to good candidates. When time is
    over the running jobs are cancelled and the leader of the highest rung wins;
    if no trial ended, the first candidate. The last fit is not limited, so that
    there always is a model. A metric that isn't defined on the rows that judge
    counts as the worst. The imputer and scaler of the trials are those of all
    training rows.
    """
    if not candidates:
        raise ValueError("no candidates")
    spark = train.sparkSession
    limit, trials, late = Deadline(spark, seconds), [], False
    try:
        with limit.limit():
            prepared = prepare_training(train, features, label, key=key, seed=seed)
            learn = 1.0 - validation_share
            judges = prepared.where(F.col(PART) >= F.lit(learn)).ready
            rows = prepared.where(F.col(PART) < F.lit(learn)).ready.count()
        alive = list(range(len(candidates)))
        for rung, share in enumerate(rung_shares(len(alive), rows, cut, least_rows)):
            sample = prepared.where(F.col(PART) < F.lit(learn * share))
            values = {}
            for i in alive:
                with limit.limit():
                    values[i] = _try(trials, rung, i, share, sample, judges, candidates[i], metric)
            alive.sort(key=lambda i: (_rank(values[i], metric), i))
            alive = alive[: math.ceil(len(alive) / cut)]
    except OutOfTime:
        late = True
    winner = _leader(trials, metric) if trials else 0
    return SearchResult(fit_model(train, features, label, candidates[winner], key=key), winner, metric, trials, late)


def _try(
    trials: list[Trial], rung: int, i: int, share: float, sample: Training, judges: DataFrame, options: ModelOptions, metric: str
) -> float | None:
    started = time.monotonic()
    value = metric_value(sample.fit(options).score_prepared(judges), sample.label, metric)
    trials.append(Trial(rung, i, options.kind, share, value, time.monotonic() - started))
    return value
