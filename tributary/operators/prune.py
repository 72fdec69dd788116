"""Feature pruning: mostly missing, constant, correlated, too many."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import drop_columns, numeric_columns, quoted
from tributary.operators.aggregates import constant_flags, null_fractions, variance_ranking
from tributary.session import durable

#: Columns of a tile. Sums over a pair of tiles are six matrices of this width squared, which is what a task holds.
TILE = 512
#: Bytes of rows that are multiplied at once.
CHUNK_BYTES = 4 << 20
#: Tables of more columns than this are centred in Python, as one aggregate of so many expressions isn't compiled.
WIDE = 256
#: What is left of a zero variance after rounding is not a variance.
TINY = 1e-12
_SUMS = "tile long, slab long, sums binary"


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's one column, arrays of equal length, as a matrix; null is NaN."""
    column = batch.column(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Counts and sums over rows where both columns are present, for every column of ``x`` with every one of ``y``."""
    px, py = (~np.isnan(x)).astype("float64"), (~np.isnan(y)).astype("float64")
    fx, fy = np.nan_to_num(x, nan=0.0), np.nan_to_num(y, nan=0.0)
    return np.stack([px.T @ py, fx.T @ py, px.T @ fy, (fx * fx).T @ py, px.T @ (fy * fy), fx.T @ fy])


def _spans(width: int, tile: int) -> list[tuple[int, int]]:
    return [(i, min(i + tile, width)) for i in range(0, width, tile)]


def _means(arrays: DataFrame, width: int) -> np.ndarray:
    """Mean of each position of the arrays; about is enough, as any shift gives the same correlations."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), np.zeros(width)
        for batch in batches:
            rows = _rows_of(batch)
            finite = np.isfinite(rows)
            total += np.where(finite, rows, 0.0).sum(axis=0)
            n += finite.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total), pa.array(n)], ["i", "total", "n"])

    out = np.zeros(width)
    for r in arrays.mapInArrow(sums, "i long, total double, n double").groupBy("i").agg(F.sum("total"), F.sum("n")).collect():
        out[r[0]] = r[1] / r[2] if r[2] else 0.0
    return out


def _narrow_sums(centred: DataFrame, slots: int) -> DataFrame:
    """One tile: every task multiplies its own rows, and sends one row to one of ``slots`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = _rows_of(batch)
                found = _products(rows, rows)
                total = found if total is None else total + found
        if total is not None:
            slab = TaskContext.get().partitionId() % slots
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([slab]), pa.array([total.tobytes()], pa.binary())], ["tile", "slab", "sums"])

    return centred.mapInArrow(run, _SUMS)


def _tiled_sums(centred: DataFrame, width: int, tile: int, slabs: int) -> DataFrame:
    """Pairs of tiles: the rows' blocks of columns go to every pair that has them, and meet there chunk by chunk."""
    spans = _spans(width, tile)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, step = 0, max(1, CHUNK_BYTES // (8 * tile))
        for batch in batches:
            rows = _rows_of(batch)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                chunk = (TaskContext.get().partitionId() << 32) | made
                made += 1
                blocks = [np.ascontiguousarray(part[:, a:b]).tobytes() for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(spans)), pa.array(range(len(spans)), pa.int64()), pa.array(blocks, pa.binary())], ["chunk", "block", "cells"]
                )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, first = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([total.tobytes()], pa.binary())], ["tile", "slab", "sums"])

        for batch in batches:
            for tile_no, slab, chunk, block, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tile_no, slab) != key:
                    if key is not None:
                        yield row()
                    key, total = (tile_no, slab), 0.0
                a, b = spans[block]
                part = np.frombuffer(cells).reshape(-1, b - a)
                i, j = divmod(tile_no, len(spans))
                if i == j:
                    total = total + _products(part, part)
                elif block == i:
                    first = (chunk, part)
                elif first[0] == chunk:
                    total = total + _products(first[1], part)
                else:
                    raise RuntimeError(f"chunk {chunk} has one block of two")
        if key is not None:
            yield row()

    n = len(spans)
    blocks = centred.mapInArrow(pack, "chunk long, block long, cells binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("other")
    dealt = blocks.select("*", other).select(
        (F.least("block", "other") * n + F.greatest("block", "other")).alias("tile"),
        F.pmod(F.xxhash64("chunk"), F.lit(slabs)).alias("slab"), "chunk", "block", "cells",
    )
    return dealt.repartition("tile", "slab").sortWithinPartitions("tile", "slab", "chunk", "block").mapInArrow(multiply, _SUMS)


def _added(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Sums with equal keys added up, one row held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([total.tobytes()], pa.binary())], ["tile", "slab", "sums"])

        for batch in batches:
            for tile, slab, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (tile, slab if "slab" in keys else 0)
                if now != key:
                    if key is not None:
                        yield row()
                    key, total = now, np.zeros(len(data) // 8)
                total += np.frombuffer(data)
        if key is not None:
            yield row()

    return sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _SUMS)


def _correlations(sums: DataFrame, names: Sequence[str], tile: int) -> DataFrame:
    """``i, j, r`` of the pairs of each tile; undefined correlations are null."""
    spans = _spans(len(names), tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile_no, data in zip(batch.column("tile").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                (a, b), (c, d) = (spans[k] for k in divmod(tile_no, len(spans)))
                n, sx, sy, sxx, syy, sxy = np.frombuffer(data).reshape(6, b - a, d - c)
                with np.errstate(all="ignore"):
                    cov, var_x, var_y = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
                    r = np.clip(cov / np.sqrt(var_x * var_y), -1.0, 1.0)
                    # Infinite values leave no variance.
                    defined = np.isfinite(cov) & np.isfinite(var_x) & np.isfinite(var_y) & (n > 1) & (var_x > TINY * sxx) & (var_y > TINY * syy)
                for i in range(b - a):
                    js = np.arange(max(c, a + i + 1), d)
                    if len(js):
                        values = pa.array(r[i, js - c], mask=~defined[i, js - c])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(js), a + i)), pa.array(js), values], ["i", "j", "r"])

    return sums.mapInArrow(run, "i long, j long, r double")


def _numbered_correlations(df: DataFrame, names: Sequence[str], tile: int) -> DataFrame:
    arrays = df.select(F.array(*[quoted(c).cast("double") for c in names]).alias("x"))
    if len(names) > WIDE:
        means = _means(arrays, len(names))
    else:
        row = df.agg(*[F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
        means = np.nan_to_num(np.array([row[f"m{i}"] or 0.0 for i in range(len(names))]), posinf=0.0, neginf=0.0)
    # Centred values keep the sums of squares small.
    shift = F.array(*[F.lit(float(m)) for m in means])
    centred = arrays.select(F.zip_with("x", shift, lambda v, m: v - m).alias("x"))
    tiles = len(_spans(len(names), tile))
    parallel = df.sparkSession.sparkContext.defaultParallelism
    if tiles == 1:
        sums = _added(_narrow_sums(centred, max(1, math.isqrt(4 * parallel))), ["tile", "slab"])
    else:
        sums = _tiled_sums(centred, len(names), tile, max(1, -(-4 * parallel // (tiles * (tiles + 1)))))
    return _correlations(_added(sums, ["tile"]), names, tile)


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, *, tile: int | None = None) -> DataFrame:
    """``a, b, r`` for a before b by name: Pearson over rows where both are present.

    Undefined correlations are null. Up to ``TILE`` columns, every task adds up
    its own rows and sends one row of sums. More columns are cut into tiles: a
    pair of tiles is a key, the rows' blocks of both meet there, and a task holds
    the sums of one pair of tiles only, whatever the number of columns.
    """
    names = sorted(columns if columns is not None else numeric_columns(df))
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    name_of = F.array(*[F.lit(c) for c in names])
    found = _numbered_correlations(df, names, tile or TILE)
    return found.select(F.get(name_of, F.col("i").cast("int")).alias("a"), F.get(name_of, F.col("j").cast("int")).alias("b"), "r")


def correlated_columns(
    df: DataFrame, threshold: float = 0.95, columns: Sequence[str] | None = None, *, tile: int | None = None
) -> list[str]:
    """Columns to leave out so that no strongly correlated pair stays.

    Pairs are visited in name order. A column that was marked before its turn is
    not visited; one that is marked during its turn still meets its remaining
    partners. Of a pair at or above the threshold, the column with the larger
    mean correlation goes, on a tie the later name. The driver gets one mean per
    column, and then the strong partners of one column after the other.
    """
    names = sorted(columns if columns is not None else numeric_columns(df))
    if len(names) < 2 or threshold <= 0:
        return []
    found = durable(_numbered_correlations(df, names, tile or TILE).where("r IS NOT NULL").withColumn("r", F.abs("r")), "correlations")
    # A column correlates fully with itself, if it varies at all.
    both = found.select(F.explode(F.array("i", "j")).alias("i"), "r")
    sums = both.groupBy("i").agg(F.sum("r").alias("total"), F.count(F.lit(1)).alias("n")).collect()
    # Rounded, so that the order of summation cannot decide a tie.
    means = {r["i"]: round((r["total"] + 1.0) / (r["n"] + 1), 10) for r in sums}
    strong = found.where(F.col("r") >= threshold).groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("partners"))
    gone: set[int] = set()
    for row in strong.orderBy("i").toLocalIterator():
        i = row["i"]
        if i in gone:
            continue
        for j in row["partners"]:
            if j not in gone:
                gone.add(i if means[i] > means[j] else j)
    return [names[i] for i in sorted(gone)]


@dataclass
class PruneOptions:
    max_missing_ratio: float = 0.8
    correlation_threshold: float = 0.95
    max_features: int = 1_000
    protect: Sequence[str] = ()


@dataclass
class PruneReport:
    missing: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)
    correlated: list[str] = field(default_factory=list)
    capped: list[str] = field(default_factory=list)

    def rows(self) -> list[tuple[str, str]]:
        steps = ("missing", "constant", "correlated", "capped")
        return [(step, c) for step in steps for c in getattr(self, step)]


def missing_columns(df: DataFrame, max_missing_ratio: float = 0.8) -> list[str]:
    """Columns with a null share above the ratio (a share equal to it is kept)."""
    over = null_fractions(df).where(F.col("null_fraction") > max_missing_ratio)
    return sorted(r["column"] for r in over.collect())


def constant_columns(df: DataFrame) -> list[str]:
    return sorted(r["column"] for r in constant_flags(df).where("is_constant").collect())


def cap_columns(df: DataFrame, max_features: int, protect: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """Keep the columns of largest variance, in rank order; below the cap nothing changes."""
    if len(df.columns) <= max_features:
        return df, []
    kept_anyway = set(protect)
    ranked = [r["column"] for r in variance_ranking(df).orderBy("rank").collect()]
    room = max_features - len(kept_anyway & set(ranked))
    chosen = [c for c in ranked if c not in kept_anyway][: max(0, room)]
    keep = [c for c in ranked if c in kept_anyway or c in set(chosen)]
    return df.select(*[quoted(c) for c in keep]), sorted(set(ranked) - set(keep))


def prune(df: DataFrame, options: PruneOptions | None = None) -> tuple[DataFrame, PruneReport]:
    """Apply all four steps in order; protected columns always stay."""
    o = options or PruneOptions()
    kept = set(o.protect)
    report = PruneReport()
    report.missing = [c for c in missing_columns(df, o.max_missing_ratio) if c not in kept]
    df = drop_columns(df, report.missing)
    report.constant = [c for c in constant_columns(df) if c not in kept]
    df = drop_columns(df, report.constant)
    free = [c for c in numeric_columns(df) if c not in kept]
    report.correlated = correlated_columns(df, o.correlation_threshold, free)
    df = drop_columns(df, report.correlated)
    df, report.capped = cap_columns(df, o.max_features, kept)
    return df, report
