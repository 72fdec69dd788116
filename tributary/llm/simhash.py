"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import byte_words, small_batches
from tributary.llm.graph import components
from tributary.session import durable

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Bands of the 64 bits. Two fingerprints within the radius agree on ``BANDS - RADIUS`` whole bands.
BANDS = 5
#: Fingerprints in one tree; larger buckets become several trees, each met by every chunk of the bucket.
TREE_ROWS = 2_000
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
CHUNK = 1 << 16
ALL_BITS = (1 << 64) - 1


def simhash64(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text's UTF-8 bytes; zero without words."""
    words = byte_words(data)
    if not words:
        return 0
    width = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, text_hash, fp`` of every row: the id, a hash of the text (rows of equal id and text are the same), the fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash64(x.as_py(), shingle) for x in batch.column("data")), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(prints)], ["id", "text_hash", "fp"])

    small_batches(df.sparkSession)
    narrow = df.select(
        df[id_col].cast("long").alias("id"), F.xxhash64(df[text_col]).alias("text_hash"), df[text_col].cast("binary").alias("data")
    )
    return narrow.mapInArrow(run, "id long, text_hash long, fp long")


def distance(a: int, b: int) -> int:
    """Bits in which two signed 64-bit values differ."""
    return ((a ^ b) & ALL_BITS).bit_count()


class BKTree:
    """Values under the node they reach by their distance to each node on the way."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = distance(self.values[at], value)
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values at most ``radius`` away; only edges that can lead there are followed."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = distance(self.values[at], value)
            if d <= radius:
                yield at
            todo.extend(c for e, c in self.children[at].items() if d - radius <= e <= d + radius)


def _spanning(tree: list[int], probes: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what the tree's values and the probes within the radius join; at most one per value.

    Without probes the values are probed against those before them.
    """
    bk, parent = BKTree(), {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    if probes is not None:
        for value in tree:
            bk.add(value)
    for value in tree if probes is None else probes:
        for at in bk.within(value, radius):
            a, b = root(value), root(bk.values[at])
            if a != b:
                parent[a] = b
                yield value, bk.values[at]
        if probes is None:
            bk.add(value)


def _band_keys(fp: Column, bands: int, radius: int) -> Column:
    """One struct per choice of bands that two near fingerprints must share: the choice and the bits."""
    width = [64 // bands + (i < 64 % bands) for i in range(bands)]
    start = [sum(width[:i]) for i in range(bands)]
    part = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(start, width, strict=True)]
    keys = []
    for n, chosen in enumerate(combinations(range(bands), bands - radius)):
        bits = F.lit(0).cast("long")
        for i in chosen:
            bits = F.shiftleft(bits, width[i]).bitwiseOR(part[i])
        keys.append(F.struct(F.lit(n).alias("choice"), bits.alias("bits")))
    return F.array(*keys)


def near_links(prints: DataFrame, *, radius: int = RADIUS, bands: int = BANDS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``a, b`` that connect the distinct ``prints(fp)`` exactly as all pairs within ``radius`` bits do.

    Two fingerprints that near share ``bands - radius`` bands, so they meet in a
    bucket. A bucket of several trees (shards by hash) is a triangle of cells:
    each shard's tree is met by its own values and by every later shard's. A
    cell holds about ``2 * tree_rows`` values and gives fewer links than values.
    """
    if not 0 <= radius < bands <= 16:
        raise ValueError("0 <= radius < bands <= 16 is needed")
    keyed = prints.select("fp", F.explode(_band_keys(F.col("fp"), bands, radius)).alias("k")).select("fp", "k.choice", "k.bits")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / tree_rows).cast("int")
    shared = keyed.join(sizes, ["choice", "bits"]).withColumn("shards", shards)
    shared = shared.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    cells = shared.select("fp", "choice", "bits", "own", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    cells = cells.select(
        "choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("probe"), "fp"
    )
    cell = ["choice", "bits", "i", "j"]
    dealt = cells.repartition(*cell).sortWithinPartitions(*cell, "probe", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: tuple, tree: list[int], probes: list[int]) -> Iterator[tuple[int, int]]:
            return _spanning(tree, None if key[2] == key[3] else probes, radius)

        key, tree, probes = None, [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for *new, probe, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(new) != key:
                    if key:
                        out += links(key, tree, probes)
                    key, tree, probes = tuple(new), [], []
                (probes if probe else tree).append(fp)
            yield _pairs(out)
        if key:
            yield _pairs(list(links(key, tree, probes)))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = ([p[i] for p in pairs] for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    bands: int = BANDS,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """``id, text_hash, rows, fp, root, component_id`` per distinct id and text.

    Equal fingerprints are one node, so copies cost nothing beyond their
    fingerprint. ``root`` names the component, ``component_id`` is its smallest
    id (null if all ids are null). A null text counts as empty: fingerprint
    zero, linked like any other. ``rows`` counts repeated rows. No table gives
    no rows; other columns are not read.
    """
    prints = fingerprints(df, id_col, text_col, shingle)
    prints = durable(prints.groupBy("id", "text_hash", "fp").agg(F.count(F.lit(1)).alias("rows")), "simhash")
    nodes = durable(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    linked = components(near_links(nodes.select("fp"), radius=radius, bands=bands, tree_rows=tree_rows))
    rooted = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("id", "text_hash", "rows", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``df`` without near copies: of each component one row, that of the smallest id.

    Null ids come last; of equal ids the smallest text hash is taken, and of
    repeated rows one stays. All columns are kept as they are.
    """
    copies = near_copies(df, id_col, text_col, **options)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    best = copies.groupBy("root").agg(F.min(order).alias("best")).select("best.*")
    least = F.lit(-(2**63)).cast("long")
    best = best.select(F.coalesce("id", least).alias("__id"), F.col("text_hash").alias("__text"), F.col("no_id").alias("__no_id"))
    keys = ["__id", "__text", "__no_id"]
    own = df[id_col].cast("long")
    keyed = df.withColumns({"__id": F.coalesce(own, least), "__text": F.xxhash64(df[text_col]), "__no_id": own.isNull()})
    return keyed.join(best, keys, "left_semi").dropDuplicates(keys).drop(*keys)
