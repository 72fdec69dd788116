"""Exact self-join of documents by the Jaccard similarity of their word n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import small_batches
from tributary.session import durable

#: Words of an n-gram, and least similarity in percent.
WIDTH, PERCENT = 5, 80
#: N-grams that a task packs at once, documents among them at most, and n-grams that a shard counts.
CHUNK, CHUNK_DOCS, SHARD = 1 << 20, 1 << 16, 1 << 20
#: Bytes of a text cut into words at once, and words whose hashes a task remembers.
PIECE, WORDS = 1 << 20, 1 << 17
#: Partners that each bucket chooses in its first round, and the growth from round to round.
PARTNERS, GROWTH = 8, 128
#: Most bytes of a table that is sent to all tasks, and about the bytes that a row of a bucket or a label takes there.
SENT_BYTES, ROW_BYTES, LABEL_BYTES = 16 << 20, 100, 64
#: Halvings of the suffix filter.
SUFFIX_DEPTH = 3
#: Bytes that a shard gets of a hash, besides those that name the shard.
LOW = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class _Known(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Grams:
    """Hashes of a text's distinct n-grams."""

    def __init__(self, width: int) -> None:
        if not 1 <= width <= len(_ODD):
            raise ValueError(f"n-grams have 1 to {len(_ODD)} words")
        self.width, self.known = width, _Known()

    def words(self, data: bytes) -> np.ndarray:
        """One hash per word, A to Z lower-cased; a long text is cut in pieces between words."""
        parts, start = [], 0
        while start < len(data):
            end = data.find(b" ", start + PIECE)
            end = len(data) if end < 0 else end
            found = data[start:end].lower().split()
            if len(self.known) > WORDS:
                self.known = _Known()
            parts.append(np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found)))
            start = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def __call__(self, data: bytes | None) -> np.ndarray:
        """Sorted; a text with fewer words is one n-gram, one without words has none."""
        words = self.words(data or b"")
        width = min(self.width, len(words))
        if not width:
            return words
        count = len(words) - width + 1
        mixed = np.zeros(count, np.uint64)
        for i in range(width):
            mixed += words[i : i + count] * _ODD[i]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD[0]
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def prefix_length(size: int, percent: int) -> int:
    """N-grams of the prefix: two sets that are similar share one of their rarest so many."""
    return size - -(-percent * size // 100) + 1


def _pack(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


#: Documents of a chunk in ascending order, as steps: the two bytes of all steps one after the other, which compress well.
def _pack_places(places: np.ndarray) -> bytes:
    return np.diff(places, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpack_places(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel().astype(np.int64).cumsum()


_TYPES = {"key": pa.int64(), "chunk": pa.int64(), "place": pa.int64(), "id": pa.int64(), "cls": pa.binary(), "n": pa.int64(), "places": pa.binary(), "codes": pa.binary(), "grams": pa.binary()}
_SCHEMA = "key long, chunk long, place long, id long, cls binary, n long, places binary, codes binary, grams binary"


def _batch(rows: list[tuple], types: dict[str, pa.DataType] = _TYPES) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def _packed_grams(df: DataFrame, id_col: str, text_col: str, width: int, shards: int, chunk_rows: int) -> DataFrame:
    """Per chunk of documents and shard one row of n-grams; and one row per document, under a negative key.

    Documents with equal sets within a chunk are packed once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, made = Grams(width), 0
        sets: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        docs: list[tuple] = []

        def flush() -> pa.RecordBatch:
            chunk = (TaskContext.get().partitionId() << 32) | made
            rows = [(-1 - chunk, chunk, place, doc, cls, n, None, None, None) for place, doc, cls, n in docs]
            if held:
                all_grams = np.concatenate(held)
                place = np.repeat(np.arange(len(held)), [len(h) for h in held])
                shard = (all_grams >> np.uint64(8 * LOW)).astype(np.int64) & (shards - 1)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)):
                    part = order[cuts[s] : cuts[s + 1]]
                    rows.append((int(s), chunk, None, None, None, None, _pack_places(place[part]), None, _pack(all_grams[part], LOW)))
            return _batch(rows)

        size = 0
        for batch in batches:
            for doc, data in zip(batch.column("id").to_pylist(), batch.column("data"), strict=True):
                found = grams(data.as_py())
                if not len(found):
                    docs.append((None, doc, None, 0))
                else:
                    cls = xxhash.xxh3_128_digest(found.tobytes())
                    if cls not in sets:
                        sets[cls] = len(held)
                        held.append(found)
                        size += len(found)
                    docs.append((sets[cls], doc, cls, len(found)))
                if size >= chunk_rows or len(docs) == CHUNK_DOCS:
                    yield flush()
                    sets, held, docs, size, made = {}, [], [], 0, made + 1
        yield flush()

    narrow = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("binary").alias("data"))
    return narrow.mapInArrow(run, _SCHEMA)


def _groups(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Rows of equal ``column``, which come one after the other."""
    now: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if now and row[column] != now[0][column]:
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def _count_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard the n-grams that occur more than once, per chunk, with a code that grows with the count.

    Codes are four to an octave. Rows of documents pass through.
    """
    for rows in _groups(batches, "key"):
        if rows[0]["key"] < 0:
            yield _batch([tuple(r.values()) for r in rows])
            continue
        grams = [_unpack(r["grams"], LOW) for r in rows]
        found, at, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        code = np.minimum(127, 4 * np.log2(np.maximum(count, 1)) + 1e-9).astype(np.uint8)[at]
        often, start, out = (count > 1)[at], 0, []
        for r, g in zip(rows, grams, strict=True):
            here = slice(start, start + len(g))
            start += len(g)
            keep = often[here]
            if keep.any():
                places = _unpack_places(r["places"])[keep]
                out.append((r["key"], r["chunk"], None, None, None, None, _pack_places(places), code[here][keep].tobytes(), _pack(g[keep], LOW)))
        yield _batch(out)


_SETS = {"id": pa.int64(), "cls": pa.binary(), "n": pa.int64(), "common": pa.binary()}


def _sets(percent: int):  # noqa: ANN202
    """Documents with their class and size; and classes whose prefix has an n-gram that others have too.

    ``common`` holds the n-grams that others have, rarest first. Those that no
    other document has come before all of them in the order, so they only move
    the prefix: a set with a whole prefix of them has no partner.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "chunk"):
            docs = [r for r in rows if r["key"] < 0]
            yield _batch([(r["id"], r["cls"], r["n"], None) for r in docs], _SETS)
            parts = [r for r in rows if r["key"] >= 0]
            if not parts:
                continue
            place = np.concatenate([_unpack_places(r["places"]) for r in parts])
            element = np.concatenate([
                np.frombuffer(r["codes"], np.uint8).astype(np.uint64) << np.uint64(56)
                | np.uint64((r["key"] & 0xFFFF) << 8 * LOW) | _unpack(r["grams"], LOW)
                for r in parts
            ])
            order = np.lexsort((element, place))
            place, element = place[order], element[order]
            classes = {r["place"]: (r["cls"], r["n"]) for r in docs if r["cls"]}
            out = []
            for at in np.flatnonzero(np.diff(place, prepend=-1)):
                cls, n = classes[int(place[at])]
                end = int(np.searchsorted(place, place[at], "right"))
                if n - (end - at) < prefix_length(n, percent):
                    out.append((None, cls, n, element[at:end].tobytes()))
            yield _batch(out, _SETS)

    return run


def _postings(percent: int):  # noqa: ANN202
    types = {"gram": pa.int64(), "cls": pa.binary(), "n": pa.int64(), "pos": pa.int64(), "alone": pa.int64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                common, n = np.frombuffer(r["common"], "<i8"), r["n"]
                alone = n - len(common)
                out += [(g, r["cls"], n, alone + i, alone) for i, g in enumerate(common[: prefix_length(n, percent) - alone].tolist())]
            yield _batch(out, types)

    return run


def overlap_needed(a: Column | int, b: Column | int, percent: int) -> Column | int:
    """Shared n-grams that sets of these sizes need."""
    total = percent * (a + b)
    return F.ceil(total / (100 + percent)) if isinstance(total, Column) else -(-total // (100 + percent))


def overlap_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Most n-grams that two sorted arrays can share, by halving: what is below the middle can only meet what is below it."""
    if not depth or not len(x) or not len(y):
        return min(len(x), len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    same = at < len(x) and x[at] == y[middle]
    return overlap_bound(x[:at], y[:middle], depth - 1) + int(same) + overlap_bound(x[at + same :], y[middle + 1 :], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, need: int) -> bool:
    """Whether two sorted arrays share at least ``need``: the suffix filter, then an exact count."""
    if len(x) < len(y):
        x, y = y, x
    if overlap_bound(x, y, SUFFIX_DEPTH) < need:
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[at] == y).sum()) >= need


def _verify(percent: int):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), overlap_needed(nx, ny, percent))
                for x, y, nx, ny in zip(*(batch.column(c).to_pylist() for c in ("common_a", "common_b", "n_a", "n_b")), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sized(df: DataFrame, most_bytes: int) -> DataFrame:
    """``df`` for a join: sent to all tasks if it surely has no more than ``SENT_BYTES``, else joined by shuffles."""
    return F.broadcast(df) if most_bytes <= SENT_BYTES else df


def _labels(links: DataFrame, most_bytes: int) -> DataFrame:
    """``node, part`` of all nodes of ``links(a, b)``: a node of the same component, mostly its smallest."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("part"))
    far = both.join(_sized(near, most_bytes), F.col("b") == F.col("node")).groupBy("a").agg(F.min("part").alias("part"))
    far = durable(far.select(F.col("a").alias("node"), "part"), "ngram-labels")
    jump = far.select(F.col("node").alias("part"), F.col("part").alias("next"))
    return far.join(_sized(jump, most_bytes), "part", "left").select("node", F.coalesce("next", "part").alias("part"))


def _components(links: DataFrame, most_bytes: int) -> DataFrame:
    """``node, root`` of all nodes of ``links``; nodes of one component, and only these, have the same root.

    A step labels all nodes; links between different labels are the links of the
    next step, in which labels are the nodes. Every component that is not
    done yet has at most half as many labels afterwards.
    """
    roots, edges = None, links
    while True:
        labels = durable(_labels(edges, most_bytes), "ngram-parts")
        ends = [_sized(labels.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}")), most_bytes) for c in "ab"]
        across = edges.join(ends[0], "a").join(ends[1], "b").where("part_a <> part_b")
        edges = durable(across.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct(), "ngram-across")
        if roots is None:
            roots = labels.withColumnRenamed("part", "root")
        else:
            moved = _sized(labels.select(F.col("node").alias("root"), "part"), most_bytes)
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("part", "root").alias("root"))
        if edges.isEmpty():
            return roots


def _joined(sets: DataFrame, percent: int, partners: int) -> DataFrame:
    """``node, root`` of the classes that have links, for ``sets(cls, n, common)``, one row per class.

    Classes meet in the buckets of their prefix n-grams. In a round each bucket
    names some of its members as partners; these meet all other members of
    the bucket, and pairs that pass the length and positional filters are
    verified once. A partner then leaves the bucket, as it has met all. Those
    with the least share of n-grams of their own go first: of the copies of a
    text, which may be far from each other, they are nearest to all. A bucket
    is done when the rest of it is linked already. The members of its largest
    linked part are never partners: each pair still missing has one outside of
    it. So many near copies of one text cost a few pairs each, while members
    that stay apart all meet, as an exact join has to. Labels that tell linked
    parts apart between the rounds may be finer than the components are, which
    only makes more pairs meet.
    """
    spark = sets.sparkSession
    classes = durable(sets, "ngram-classes")
    held = classes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("common")), F.lit(0)).alias("bytes")).first()
    label_bytes, set_bytes = held["rows"] * LABEL_BYTES, held["bytes"] + held["rows"] * ROW_BYTES
    left = durable(classes.mapInArrow(_postings(percent), "gram long, cls binary, n long, pos long, alone long"), "ngram-postings")
    left = left.withColumn("part", F.col("cls"))
    tested: list[DataFrame] = []
    links = spark.createDataFrame([], "a binary, b binary")
    while True:
        if tested:
            labels = _labels(links, label_bytes).withColumnRenamed("node", "cls")
            left = left.join(_sized(labels, label_bytes), "cls", "left").withColumn("part", F.coalesce("part", "cls"))
        parts = left.groupBy("gram", "part").agg(F.count(F.lit(1)).alias("size"))
        unlinked = parts.groupBy("gram").agg(F.max(F.struct("size", "part")).alias("most"), F.count(F.lit(1)).alias("parts"))
        unlinked = unlinked.where("parts > 1").select("gram", F.col("most.part").alias("most"))
        left = durable(left.join(unlinked, "gram"), "ngram-buckets")
        bucket_bytes = left.count() * ROW_BYTES
        if not bucket_bytes:
            return _components(links, label_bytes)
        in_order = F.row_number().over(Window.partitionBy("gram").orderBy(F.col("alone") / F.col("n"), "cls"))
        partner = left.where("part <> most").withColumn("rn", in_order).where(F.col("rn") <= partners)
        partner = durable(partner.select("gram", "cls", "n", "pos", "part"), "ngram-partners")
        a = partner.select("gram", *[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "pos", "part")])
        need = overlap_needed(F.col("n"), F.col("n_a"), percent)
        most = F.least(F.col("n") - F.col("pos"), F.col("n_a") - F.col("pos_a"))
        fits = (F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent) & (most >= need)
        met = left.join(_sized(a, bucket_bytes), "gram").where((F.col("part") != F.col("part_a")) & fits)
        pairs = met.select(F.least("cls", "cls_a").alias("a"), F.greatest("cls", "cls_a").alias("b")).distinct()
        for before in tested:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        tested.append(durable(pairs, "ngram-pairs"))
        one, two = (
            _sized(classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("common").alias(f"common_{c}")), set_bytes) for c in "ab"
        )
        found = tested[-1].join(two, "b").join(one, "a").mapInArrow(_verify(percent), "a binary, b binary")
        links = links.unionByName(durable(found, "ngram-links"))
        left = left.drop("part", "most").join(_sized(partner.select("gram", "cls"), bucket_bytes), ["gram", "cls"], "left_anti")
        partners *= GROWTH


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = WIDTH,
    percent: int = PERCENT,
    chunk_rows: int = CHUNK,
    shard_rows: int = SHARD,
    partners: int = PARTNERS,
) -> DataFrame:
    """``id, n, cls, component_id`` of every row: its set's size and class, and the smallest id that links reach.

    A text's set are its distinct n-grams of ``width`` words, A to Z
    lower-cased; fewer words are one n-gram. Two texts link if their sets'
    Jaccard similarity is at least ``percent``. Equal sets are one class, so
    copies are joined once. A null text or one without words has no set, a null
    class and no links: it stays its own component. Null ids are passed over for
    the smallest id, null only if all are. Repeated rows are rows of their own;
    other columns are not read; no rows give no rows.

    N-grams are ordered by their document frequency, rarest first, ties by
    hash. Frequencies come from one packed shuffle: a chunk of documents sends
    each shard its n-grams, the shard answers which of them others have and how
    often. Sets travel as hashes of 40 bits and those that name the shard; a
    frequency may be taken too high for two n-grams of one hash, which changes
    the order of all sets alike.
    """
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    size = df.agg(F.sum(F.octet_length(df[text_col]))).first()[0] or 0
    # Some six bytes a word; a power of two.
    shards = 1 << min(16, max(0, (size // 6 // shard_rows)).bit_length())
    packed = _packed_grams(df, id_col, text_col, width, shards, chunk_rows)
    counted = packed.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_count_shards, _SCHEMA)
    by_chunk = counted.repartition("chunk").sortWithinPartitions("chunk", "key")
    sets = durable(by_chunk.mapInArrow(_sets(percent), "id long, cls binary, n long, common binary"), "ngram-sets")
    docs = sets.where("common IS NULL").select("id", "cls", "n")
    classes = sets.where("common IS NOT NULL").select("cls", "n", "common").dropDuplicates(["cls"])
    roots = _joined(classes, percent, partners)
    least = docs.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = rooted.select("cls", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    out = docs.join(named.select("cls", "component_id"), "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n", "cls", own.alias("component_id"))
