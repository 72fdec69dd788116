"""Forests of regression trees over any number of rows: binned rows in blocks, one distributed histogram pass a level.

Spark ML's own forest keeps every row in memory with one number for each tree.
Here a row is one byte a feature and its label, and how often a tree takes it
is drawn again in every pass. What is learnt is the same: every tree from all
rows, bootstrap by Poisson numbers, a third of the features at each node, the
split of the largest drop in variance between bins, whose thresholds come from
a sample as large as Spark ML's. The random numbers are others than Spark ML's,
so single trees differ, as they do there between two layouts of the rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import quoted
from tributary.session import durable, shared_dir

#: Rows of a block; a task works on one block and one tree at a time.
BLOCK = 32_768
#: Bytes of the histograms that a task holds; more trees take more passes.
HELD = 64 << 20
#: Deeper trees have too many nodes for a whole level's histograms.
MOST_DEPTH = 10
#: Per bin: rows, sum of labels, sum of their squares.
SUMS = 3
#: Chances of a Poisson number with mean 1 to be at most 0, 1, 2 ..., as 32-bit numbers.
STEPS = [np.uint32(c * 2**32) for c in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]) if c * 2**32 < 2**32 - 1]


def cut_points(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between distinct values, at equal steps of rows if there are more values."""
    distinct, counts = np.unique(values, return_counts=True)
    between = distinct[:-1] / 2 + distinct[1:] / 2
    if len(between) <= most:
        return between
    step, below, found = len(values) / (most + 1), np.cumsum(counts), []
    target = step
    for i in range(1, len(distinct)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            found.append(between[i - 1])
            target += step
    return np.array(found)


def _thresholds(ready: DataFrame, rows: int, bins: int, seed: int) -> list[np.ndarray]:
    """Thresholds of every feature from a sample of the rows."""
    wanted = max(bins * bins, 10_000)
    sample = ready.sample(fraction=min(1.0, wanted / rows), seed=seed) if rows > wanted else ready
    values = sample.select(F.posexplode(vector_to_array("__features")).alias("feature", "value"))

    def cut(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": [key[0]], "cuts": [cut_points(part["value"].to_numpy(), min(bins, rows) - 1)]})

    cuts = values.groupBy("feature").applyInPandas(cut, "feature int, cuts array<double>").orderBy("feature").collect()
    return [np.array(r["cuts"], dtype=float) for r in cuts]


def _blocks(ready: DataFrame, label: str, cuts: list[np.ndarray]) -> DataFrame:
    """Rows as blocks: the bin of each feature, feature by feature, and the labels."""
    size = BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, kept, held = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            x, y = (np.concatenate([k[i] for k in kept], axis=-1) for i in (0, 1))
            return pa.RecordBatch.from_pydict(
                {"part": [part], "block": [made], "n": [len(y)], "bins": [x.tobytes()], "labels": [y.tobytes()]}
            )

        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            if not (np.isfinite(x).all() and np.isfinite(y).all()):
                raise ValueError("features and labels of a forest must not be NaN or infinite")
            binned = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)
            for at in range(0, batch.num_rows, size):
                kept.append((binned[:, at : at + size], y[at : at + size]))
                held += len(kept[-1][1])
                if held >= size:
                    yield block()
                    made, kept, held = made + 1, [], 0
        if held:
            yield block()

    columns = ready.select(vector_to_array("__features").alias("x"), quoted(label).alias("y"))
    return columns.mapInArrow(pack, "part long, block long, n long, bins binary, labels binary")


@dataclass
class Level:
    """Nodes of one level of a tree: where rows go from each, or the features that it may use."""

    feature: np.ndarray
    bin: np.ndarray


def _histograms(grown: dict[int, list[Level]], asked: dict[int, np.ndarray], seed: int, bins: int, squares: bool):  # noqa: ANN202
    """A task's sums by node, feature asked and bin, of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((SUMS, features.size * bins)) for t, features in asked.items()}
        for batch in batches:
            for part, block, n, x, y in zip(*batch.columns, strict=True):
                whole, labels = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, n.as_py()), np.frombuffer(y.as_buffer())
                for t, features in asked.items():
                    rng = np.random.default_rng([seed, t, part.as_py(), block.as_py()])
                    _add(sums[t], whole, labels, rng, grown[t], features, bins, squares)
        yield pa.RecordBatch.from_pydict({"tree": pa.array(sums, pa.int32()), "sums": [s.tobytes() for s in sums.values()]})

    return run


def poisson(rng: np.random.Generator, n: int) -> np.ndarray:
    """``n`` Poisson numbers with mean 1: how many of the distribution's steps lie under a uniform number of 32 bits."""
    uniform, out = rng.integers(0, 2**32, n, dtype=np.uint32), np.zeros(n, np.uint8)
    for step in STEPS:
        out += uniform >= step
    return out


def _add(
    sums: np.ndarray, whole: np.ndarray, y: np.ndarray, rng: np.random.Generator, levels: list[Level], features: np.ndarray, bins: int, squares: bool
) -> None:
    """Add a block's sums for one tree; those of squares by each bin only if asked for, else by the bins of the first feature."""
    n, x = len(y), whole.ravel()
    drawn = poisson(rng, n)
    rows = np.flatnonzero(drawn.view(bool))
    node = np.zeros(len(rows), np.intp)

    def bin_of(feature: np.ndarray) -> np.ndarray:
        """Each row's bin of the feature named for its node."""
        # All places are inside; "clip" only saves the check.
        return x.take((feature * n).take(node, mode="clip") + rows, mode="clip")

    for level in levels:
        right = bin_of(level.feature) > level.bin.take(node, mode="clip")
        node = 2 * node + right
    w, y = drawn[rows].astype(float), y[rows]
    wy = w * y
    wyy = wy * y
    size, k = sums.shape[1], features.shape[1]
    first = node * (k * bins)
    for slot in range(k):
        place = bin_of(features[:, slot]) + (first + slot * bins)
        sums[0] += np.bincount(place, w, size)
        sums[1] += np.bincount(place, wy, size)
        if slot == 0 or squares:
            sums[2] += np.bincount(place, wyy, size)


def best_splits(sums: np.ndarray, features: np.ndarray) -> pd.DataFrame:
    """Per node its sums, and the split that takes most variance off it: feature, bin and gain, which is not positive without one.

    ``sums`` is by sum, node, feature asked and bin; rows up to the bin go left.
    """
    left = sums.cumsum(axis=3)
    all_rows = left[:, :, :, -1:]
    w, s, q = all_rows[:, :, 0, 0]
    right = all_rows - left
    with np.errstate(divide="ignore", invalid="ignore"):
        between = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - all_rows[1] ** 2 / all_rows[0]
        gain = np.where((left[0] > 0) & (right[0] > 0), between / all_rows[0], -np.inf)
    flat = gain.reshape(len(features), -1)
    best = flat.argmax(axis=1)
    slot, at = np.divmod(best, sums.shape[3])
    nodes = np.arange(len(features))
    lw, ls, lq = left[:, nodes, slot, at]
    return pd.DataFrame({
        "node": nodes, "rows": w, "total": s, "squares": q, "feature": features[nodes, slot], "bin": at, "gain": flat[nodes, best],
        "left_rows": lw, "left_total": ls, "left_squares": lq,
    })


_SPLITS = (
    "tree int, node int, rows double, total double, squares double, feature int, bin int, gain double, "
    "left_rows double, left_total double, left_squares double"
)


def _grow(blocks: DataFrame, trees: range, depth: int, cuts: list[np.ndarray], k: int, seed: int) -> dict[int, list[pd.DataFrame]]:
    """The levels of ``trees``, root first, a pass over the blocks for each."""
    bins = max(len(c) for c in cuts) + 1
    grown: dict[int, list[Level]] = {t: [] for t in trees}
    found: dict[int, list[pd.DataFrame]] = {t: [] for t in trees}
    for d in range(depth):
        asked = {
            t: np.argsort(np.random.default_rng([seed, t, d]).random((2**d, len(cuts))), axis=1)[:, :k] for t in trees
        }

        def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            features = asked[key[0]]
            total = sum(np.frombuffer(s) for s in part["sums"])
            return best_splits(total.reshape(SUMS, *features.shape, bins), features).assign(tree=key[0])[
                [c.split()[0] for c in _SPLITS.split(", ")]
            ]

        parts = blocks.mapInArrow(_histograms(grown, asked, seed, bins, squares=d == depth - 1), "tree int, sums binary")
        splits = parts.groupBy("tree").applyInPandas(choose, _SPLITS).toPandas()
        for t, of_tree in splits.groupby("tree"):
            level = of_tree.sort_values("node").reset_index(drop=True)
            found[t].append(level)
            grown[t].append(Level(level["feature"].to_numpy(np.intp), level["bin"].to_numpy(np.uint8)))
    return found


def _nodes(levels: list[pd.DataFrame], cuts: list[np.ndarray]) -> list[tuple]:
    """Nodes of one tree in the order in which Spark ML saves them, each before its left and right side."""
    tables, out = [x.to_dict("records") for x in levels], []

    def visit(d: int, node: int, rows: float, total: float, squares: float) -> int:
        at, mean = len(out), total / rows
        impurity = max(squares / rows - mean * mean, 0.0)
        stats = (mean, impurity, [rows, total, squares], int(rows))
        split = tables[d][node] if d < len(tables) else None
        if split is None or not split["gain"] > 0 or impurity < np.finfo(float).eps:
            out.append((at, *stats, -1.0, -1, -1, (-1, [], -1)))
            return at
        out.append(())
        side = [split["left_rows"], split["left_total"], split["left_squares"]]
        left = visit(d + 1, 2 * node, *side)
        right = visit(d + 1, 2 * node + 1, *(a - b for a, b in zip((rows, total, squares), side, strict=True)))
        cut = float(cuts[split["feature"]][split["bin"]])
        out[at] = (at, *stats, split["gain"], left, right, (int(split["feature"]), [cut], -1))
        return at

    visit(0, 0, *(tables[0][0][c] for c in ("rows", "total", "squares")))
    return out


def in_memory_bytes(rows: int, features: int, trees: int) -> int:
    """What Spark ML's own forest keeps: per row two objects, its bins and its number for each tree."""
    return rows * (100 + 4 * features + 4 * trees)


def fit_forest(ready: DataFrame, estimator: RandomForestRegressor, rows: int) -> RandomForestRegressionModel:
    """The model of ``estimator`` (numbers of trees, levels and bins, seed), as Spark ML's own, from ``rows`` rows."""
    trees, depth, seed = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed()
    label, spark = estimator.getLabelCol(), ready.sparkSession
    cuts = _thresholds(ready, rows, estimator.getMaxBins(), seed)
    blocks = durable(_blocks(ready, label, cuts), "blocks")
    k = math.ceil(len(cuts) / 3) if trees > 1 else len(cuts)
    bins = max(len(c) for c in cuts) + 1
    at_once = max(1, HELD // (2 ** (depth - 1) * k * bins * SUMS * 8))
    found: dict[int, list[pd.DataFrame]] = {}
    for first in range(0, trees, at_once):
        found |= _grow(blocks, range(first, min(first + at_once, trees)), depth, cuts, k, seed)
    # A model of two rows gives everything but the nodes.
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    estimator.fit(ready.limit(2)).save(path)
    data = f"{path}/data"
    nodes = [(t, n) for t in range(trees) for n in _nodes(found[t], cuts)]
    spark.createDataFrame(nodes, spark.read.parquet(data).schema).write.mode("overwrite").parquet(data)
    return RandomForestRegressionModel.load(path)
