"""Approximate nearest neighbours by balanced posting lists.

Centroids lie in memory and are searched through a graph; the vectors lie in
posting lists, one per centroid, with boundary vectors in several lists. A query
takes the lists whose centroids are nearly as near as the nearest one.

Largest inner product becomes smallest distance by one more component:
``sqrt(m^2 - |x|^2)`` for a vector, zero for a query, m the largest norm.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.session import durable

#: Vectors that centroids are fitted on, at most; chosen by hash, so the bound holds at any size.
SAMPLE = 20_000
#: Vectors per list aimed at, and most lists: centroids of 64 components then take some 4 MB.
LIST_ROWS, MOST_LISTS = 250, 8_192
#: Lists that a vector may lie in, and how much farther than its nearest centroid (in distance).
COPIES, COPY_RATIO = 6, 1.15
#: Lists that a query may take, and how much farther than its nearest centroid.
PROBES, PROBE_RATIO = 64, 1.6
#: Neighbours of a centroid in the graph, and candidates kept while searching it.
DEGREE, BEAM = 24, 96
#: Vectors of a list that meet its queries in one task.
CELL_ROWS = 4_096


@dataclass
class Centroids:
    """Centroids and the graph of their nearest ones."""

    points: np.ndarray
    graph: np.ndarray
    starts: np.ndarray

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near ``x``, nearest first, and their distances: best-first search from the start nodes."""
        beam = max(BEAM, n)
        d = np.linalg.norm(self.points[self.starts] - x, axis=1)
        seen = set(self.starts.tolist())
        todo = list(zip(d.tolist(), self.starts.tolist(), strict=True))
        heapq.heapify(todo)
        best = heapq.nsmallest(beam, todo)
        worst = [(-a, b) for a, b in best]
        heapq.heapify(worst)
        while todo:
            at, node = heapq.heappop(todo)
            if len(worst) >= beam and at > -worst[0][0]:
                break
            new = [c for c in self.graph[node].tolist() if c not in seen]
            if not new:
                continue
            seen.update(new)
            for dist, c in zip(np.linalg.norm(self.points[new] - x, axis=1).tolist(), new, strict=True):
                if len(worst) < beam:
                    heapq.heappush(worst, (-dist, c))
                elif dist < -worst[0][0]:
                    heapq.heapreplace(worst, (-dist, c))
                else:
                    continue
                heapq.heappush(todo, (dist, c))
        found = sorted((-a, b) for a, b in worst)[:n]
        return np.array([b for _, b in found]), np.array([a for a, _ in found])


def _two_means(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves of ``x`` by two means, cut at the median so that both are equally large."""
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        side = ((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1)
        order = np.argsort(side, kind="stable")
        low, high = order[: len(x) // 2], order[len(x) // 2 :]
        a, b = x[low].mean(0), x[high].mean(0)
    return low, high


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> Centroids:
    """Balanced clusters by repeated halving of the largest one, and the graph of their means."""
    rng = np.random.default_rng(seed)
    heap, count = [(-len(sample), 0, np.arange(len(sample)))], 1
    while len(heap) < lists and -heap[0][0] > 1:
        _, _, rows = heapq.heappop(heap)
        for half in _two_means(sample[rows], rng):
            heapq.heappush(heap, (-len(half), count, rows[half]))
            count += 1
    points = np.array([sample[rows].mean(0) for _, _, rows in sorted(heap, key=lambda h: h[1])])
    graph = np.empty((len(points), min(DEGREE, max(1, len(points) - 1))), np.int64)
    norms = (points**2).sum(1)
    for i in range(0, len(points), 1024):
        d = norms[None, :] - 2 * points[i : i + 1024] @ points.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf if len(points) > 1 else 0
        graph[i : i + 1024] = np.argsort(d, axis=1, kind="stable")[:, : graph.shape[1]]
    # Long links keep far parts of the graph reachable.
    far = rng.integers(0, len(points), (len(points), 4))
    starts = rng.choice(len(points), min(16, len(points)), replace=False)
    return Centroids(points, np.hstack([graph, far]), np.sort(starts))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x`` of rows with a non-zero vector of finite components and the usual number of them; others take no part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fine = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where(F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull())
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("x") == (usual["n"] if usual else 0))


def nearest(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    sample: int = SAMPLE,
    list_rows: int = LIST_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for rows whose id is divisible by ``every``.

    Equal vectors are one point with its ``k + 1`` smallest ids, so a vector
    with a third of all rows is one entry of one list. Lists are cut into cells
    of ``cell_rows`` vectors, so a list that outgrows its share is met by its
    queries in many tasks. Scores are exact, in double precision; ties go to the
    smaller id. Rows whose vector is null, zero, not finite or of another length
    take no part; neither do null ids. Rows that repeat an id and vector count once.
    """
    spark = df.sparkSession
    rows = durable(usable(df, id_col, vector_col).distinct(), "ann-rows")
    first = Window.partitionBy("x").orderBy("id")
    ids = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    points = ids.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = durable(points.withColumn("point", F.col("ids")[0]).withColumn("__r", F.xxhash64("x")), "ann-points")
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("m")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = len(points.first()["x"]), facts["m"]
    share = min(1.0, sample / facts["n"])
    chosen = points.where(F.pmod("__r", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("x")
    fitted = np.array([r["x"] for r in chosen.limit(2 * sample).toLocalIterator()])
    lists = int(min(MOST_LISTS, max(1, facts["n"] // list_rows), max(1, len(fitted) // 4)))
    shared = spark.sparkContext.broadcast(fit_centroids(_lifted(fitted, most), lists))

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x = _vectors(batch.column("x"), dim)
            out = [_lists(index, v, COPIES, COPY_RATIO, spread=True) for v in _lifted(x, most)]
            yield _repeated(batch, out)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x = _vectors(batch.column("x"), dim)
            # Length of a query does not change its order; scaled to the largest norm its distances compare with the vectors'.
            x = x * (np.sqrt(most) / np.linalg.norm(x, axis=1))[:, None]
            out = [_lists(index, v, PROBES, PROBE_RATIO) for v in np.hstack([x, np.zeros((len(x), 1))])]
            yield _repeated(batch, out)

    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    queries = asked.groupBy("x").agg(F.min("id").alias("point"))
    shape = "list int, point long, x array<double>"
    posted = points.select("point", "x").mapInArrow(post, shape)
    cells = F.ceil(F.col("n") / cell_rows).cast("int")
    posted = durable(posted, "ann-lists")
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select("list", cells.alias("cells"))
    sizes = durable(sizes, "ann-cells")
    dealt = posted.join(F.broadcast(sizes), "list").withColumn("cell", F.pmod(F.xxhash64("point"), F.col("cells")).cast("int"))
    met = queries.select("point", "x").mapInArrow(probe, shape).join(F.broadcast(sizes), "list")
    met = met.select("list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "point", "x")

    def score(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "point": [], "score": []})
        right = right.sort_values("point", kind="stable")
        ids, x = right["point"].to_numpy(), np.stack(right["x"])
        parts = []
        for i in range(0, len(left), 256):
            part = left.iloc[i : i + 256]
            scores = np.stack(part["x"]) @ x.T
            top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            parts.append(pd.DataFrame({
                "query": np.repeat(part["point"].to_numpy(), top.shape[1]),
                "point": ids[top].ravel(),
                "score": np.take_along_axis(scores, top, 1).ravel(),
            }))
        return pd.concat(parts)

    found = met.groupBy("list", "cell").cogroup(dealt.groupBy("list", "cell")).applyInPandas(score, "query long, point long, score double")
    # A point met in several lists has the same score there, up to the last bits.
    best = found.groupBy("query", "point").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    best = best.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    members = best.join(points.select("point", "ids", F.col("x").alias("its")), "point")
    texts = queries.select(F.col("point").alias("query"), "x")
    exact = F.aggregate(F.zip_with("x", "its", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = members.join(texts, "query").select("query", F.explode("ids").alias("vec_id"), exact.alias("score"))
    lead = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    scored = scored.withColumn("r", F.row_number().over(lead)).where(F.col("r") <= k + 1)
    # Every asked row of a vector shares its list, less itself.
    names = asked.join(queries.withColumnRenamed("point", "query"), "x").select("query", F.col("id").alias("query_id"))
    own = Window.partitionBy("query_id").orderBy("r")
    answers = names.join(scored, "query").where("query_id <> vec_id").withColumn("rank", F.row_number().over(own))
    return answers.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes all norms equal."""
    rest = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def _lists(index: Centroids, x: np.ndarray, most: int, ratio: float, spread: bool = False) -> np.ndarray:
    """Lists of a vector: the nearest, and others within ``ratio`` of its distance.

    ``spread`` leaves out a list whose centroid is nearer to a chosen one than
    to the vector: it would bring the vector to the same queries again.
    """
    near, d = index.nearest(x, most * 2 if spread else most)
    near = near[d <= ratio * d[0] + 1e-12]
    if not spread:
        return near
    chosen: list[int] = []
    for c, far in zip(near.tolist(), d.tolist(), strict=False):
        if all(np.linalg.norm(index.points[c] - index.points[o]) > far for o in chosen) or not chosen:
            chosen.append(c)
        if len(chosen) == most:
            break
    return np.array(chosen)


def _repeated(batch: pa.RecordBatch, lists: list[np.ndarray]) -> pa.RecordBatch:
    """Each row once for each of its lists."""
    rows = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
    at = pa.array(np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32))
    taken = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([at, taken.column("point"), taken.column("x")], ["list", "point", "x"])
