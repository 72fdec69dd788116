"""Source divergence audit: which sources of a language differ, by how much, and in which terms."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import small_batches
from tributary.session import durable

#: Documents of a language that a term must occur in; what every count is raised by; the unit of shares.
LEAST_DOCS, RAISE, UNIT = 30, 5, 1_000_000_000
#: Terms listed for a source.
TOP_TERMS = 50
#: Terms or pairs that a task gathers before it hands them on, bytes of a text cut into terms at once, and of all texts per shard of terms.
HELD, PIECE, SHARD_BYTES = 1 << 19, 1 << 20, 1 << 24
#: Letters A to Z become small; small letters and all bytes of other scripts stay; the rest separates terms.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def text_terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text's UTF-8 bytes; a long text is cut in pieces between terms."""
    flat, start = data.translate(_BYTES), 0
    while start < len(flat):
        end = flat.find(b" ", start + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[start:end].split()
        start = end


_PACKED = "lang string, shard long, sources array<string>, terms binary, docs binary, place binary, source binary, occ binary"
_KEPT = "lang string, source string, term string, occ long, lang_occ long"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class _Held:
    """Terms of some documents: by language the documents of each, by language and source its occurrences."""

    NAMES = ["lang", "shard", "sources", "terms", "docs", "place", "source", "occ"]
    TYPES = [pa.string(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 5]

    def __init__(self) -> None:
        self.docs: dict[str, Counter[bytes]] = {}
        self.occ: dict[str, dict[str, Counter[bytes]]] = {}
        self.size = 0

    def add(self, lang: str, source: str, data: bytes) -> None:
        occ = self.occ.setdefault(lang, {}).setdefault(source, Counter())
        self.size -= len(occ)
        seen: set[bytes] = set()
        for terms in text_terms(data):
            occ.update(terms)
            seen.update(terms)
        self.size += len(occ)
        self.docs.setdefault(lang, Counter()).update(seen)

    def packed(self, shards: int) -> pa.RecordBatch:
        """One row per language and shard: its terms, and numbers that point at them."""
        rows = []
        for lang, docs in self.docs.items():
            terms = np.array(list(docs), object)
            if not len(terms):
                continue
            place = {t: i for i, t in enumerate(terms)}
            shard = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % shards
            by_shard = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[by_shard], np.arange(shards + 1))
            within = np.empty(len(terms), np.int64)
            within[by_shard] = np.arange(len(terms)) - cuts[shard[by_shard]]
            n_docs = np.fromiter(docs.values(), np.int64, len(terms))
            sources = list(self.occ[lang])
            at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in self.occ[lang].values()])
            occ = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in self.occ[lang].values()])
            source = np.repeat(np.arange(len(sources)), [len(c) for c in self.occ[lang].values()])
            order = np.argsort(shard[at], kind="stable")
            ends = np.searchsorted(shard[at][order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                own, uses = by_shard[cuts[s] : cuts[s + 1]], order[ends[s] : ends[s + 1]]
                numbers = (n_docs[own].astype("<u4"), within[at[uses]].astype("<u4"), source[uses].astype("<u4"), occ[uses].astype("<u4"))
                rows.append((lang, int(s), sources, b" ".join(terms[own]), *(n.tobytes() for n in numbers)))
        return _batch(rows, self.NAMES, self.TYPES)


def kept_terms(df: DataFrame, least_docs: int, shards: int) -> DataFrame:
    """``lang, source, term, occ, lang_occ`` of the terms in at least ``least_docs`` documents of ``df(lang, source, data)``'s language.

    Tasks add up over many documents and send each shard of terms one row, so
    neither a frequent term nor a large source nor the many rare words send a
    row each. A shard adds the rows of a language up and leaves out its rare terms.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for lang, source, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "data")), strict=True):
                held.add(lang, source, data)
                if held.size > HELD:
                    yield held.packed(shards)
                    held = _Held()
        yield held.packed(shards)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and (row["lang"], row["shard"]) != (rows[0]["lang"], rows[0]["shard"]):
                    yield frequent(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield frequent(rows)

    def frequent(rows: list[dict]) -> pa.RecordBatch:
        docs: dict[bytes, int] = {}
        for r in rows:
            for term, n in zip(r["terms"].split(b" "), np.frombuffer(r["docs"], "<u4").tolist(), strict=True):
                docs[term] = docs.get(term, 0) + n
        occ: Counter[tuple[str, bytes]] = Counter()
        whole: Counter[bytes] = Counter()
        for r in rows:
            terms = r["terms"].split(b" ")
            often = np.fromiter((docs[t] >= least_docs for t in terms), bool, len(terms))
            place, source, n = (np.frombuffer(r[c], t) for c, t in (("place", "<u4"), ("source", "<u4"), ("occ", "<u4")))
            keep = often[place]
            for p, s, k in zip(place[keep].tolist(), source[keep].tolist(), n[keep].tolist(), strict=True):
                occ[r["sources"][s], terms[p]] += k
                whole[terms[p]] += k
        out = [(rows[0]["lang"], s, t.decode(), n, whole[t]) for (s, t), n in occ.items()]
        return _batch(out, ["lang", "source", "term", "occ", "lang_occ"], [*[pa.string()] * 3, *[pa.int64()] * 2])

    key = ["lang", "shard"]
    return df.mapInArrow(run, _PACKED).repartition(*key).sortWithinPartitions(*key).mapInArrow(count, _KEPT)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (count + RAISE) / (total + RAISE * terms))`` without rounding."""
    top = F.lit(UNIT).cast("decimal(12,0)") * (count + F.lit(RAISE)).cast("decimal(20,0)")
    return F.call_function("div", top, (total + F.lit(RAISE) * terms).cast("decimal(20,0)")) + F.lit(1)


class _Path:
    """The open branch of a frequent-pattern tree whose rows arrive in path order.

    In that order a node is complete when the next row leaves it, so only the
    branch from the root to the last row is held. A node is ``[item, count]``;
    ``sums`` has the pair corrections of the nodes that were left.
    """

    def __init__(self, sums: Counter[tuple[str, str, str]]) -> None:
        self.nodes: list[list] = []
        self.lang, self.sums = "", sums

    def add(self, lang: str, row: list[dict], times: int) -> None:
        """Insert one row with its multiplicity; the part of its path that is there already is shared."""
        shared = 0
        if lang == self.lang:
            while shared < min(len(row), len(self.nodes)) and row[shared] == self.nodes[shared][0]:
                shared += 1
        self.leave(shared)
        self.lang = lang
        self.nodes.extend([item, 0] for item in row[shared:])
        self.nodes[-1][1] += times

    def leave(self, depth: int = 0) -> None:
        """Close the nodes below ``depth``: one correction per node and ancestor, however many rows share both."""
        while len(self.nodes) > depth:
            item, times = self.nodes.pop()
            if self.nodes:
                self.nodes[-1][1] += times
            b, pb, zb = item["source"], item["p"], item["p0"]
            for above, _ in self.nodes:
                pa_, za = above["p"], above["p0"]
                both = abs(pa_ - pb) - abs(pa_ - zb) - abs(za - pb) + abs(za - zb)
                self.sums[self.lang, above["source"], b] += times * both


def tree_corrections(rows: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for ``rows(lang, path, times)``: what pairs of sources differ by besides their single sums.

    ``path`` lists ``source, occ, p, p0`` of a term's sources in order. Rows are
    dealt by ranges of paths: each task builds the tree of its range, and a
    branch that two ranges share only gives two partial sums.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, str, str]] = Counter()
        tree = _Path(sums)
        for batch in batches:
            for row in batch.to_pylist():
                tree.add(row["lang"], row["path"], row["times"])
                if len(sums) > HELD:
                    yield out(sums)
                    sums.clear()
        tree.leave()
        yield out(sums)

    def out(sums: Counter[tuple[str, str, str]]) -> pa.RecordBatch:
        keys = list(zip(*sums, strict=True)) or [(), (), ()]
        columns = [pa.array(k, pa.string()) for k in keys] + [pa.array(list(sums.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])

    order = ["lang", "path"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "lang string, a string, b string, value long")


def audit(
    df: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    *,
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every source of every language.

    A language keeps the terms of at least ``least_docs`` of its documents. Each
    group (a source of a language) and each language gives every kept term a
    smoothed share, in whole billionths. Part ``pair`` ranks the other sources
    of the language by the sum of share differences over all kept terms; part
    ``term`` ranks the terms of which the group has more than its language, at
    most ``top_terms``. Ties go by the item's UTF-8 bytes.

    For a pair, terms that neither group has differ by the same amount each, and
    a term that one group has by an amount that only its count decides, so both
    come from histograms. What a term adds where both have it comes from a
    frequent-pattern tree of term rows: the nonzero counts of a term in source
    order are its path, equal rows are inserted once with their multiplicity,
    and each node is met with its ancestors once for all terms below it.

    Null text, language or source counts as ''. A group without terms has pairs
    and no terms; a language without kept terms has pairs of value zero; no rows
    give no rows. Repeated rows are documents of their own. Other columns are
    not read. Pairs are as many as sources squared, which is the result's size.
    """
    small_batches(df.sparkSession)
    empty = F.lit("")
    named = [F.coalesce(df[lang].cast("string"), empty).alias("lang"), F.coalesce(df[source].cast("string"), empty).alias("source")]
    narrow = df.select(*named, F.coalesce(df[text], empty).cast("binary").alias("data"))
    size = narrow.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    groups = df.select(*named).distinct()
    used = durable(kept_terms(narrow, least_docs, size // SHARD_BYTES + 1), "divergence-kept")
    # One row per language or group from here on, but for the terms themselves.
    langs = used.select("lang", "term", "lang_occ").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("lang_occ").alias("lang_total")
    )
    totals = used.groupBy("lang", "source").agg(F.sum("occ").alias("total"))
    zero = F.lit(0).cast("long")
    sizes = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = sizes.na.fill(0, ["total", "terms", "lang_total"])
    p0 = F.when(F.col("terms") > 0, _share(zero, F.col("total"), F.col("terms"))).otherwise(zero)
    sizes = durable(sizes.withColumn("p0", p0), "divergence-groups")
    shares = used.join(sizes, ["lang", "source"]).withColumn("p", _share(F.col("occ"), F.col("total"), F.col("terms")))

    q = _share(F.col("lang_occ"), F.col("lang_total"), F.col("terms"))
    terms = shares.withColumn("value", F.col("p") - q).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")

    others = sizes.select("lang", F.col("source").alias("b"), F.col("p0").alias("z"))
    pairs = sizes.withColumnRenamed("source", "a").join(others, "lang").where("a <> b")
    apart = F.abs(F.col("p0") - F.col("z"))
    base = pairs.select("lang", "a", "b", (F.col("terms") * apart).alias("value"))
    bars = shares.groupBy("lang", F.col("source").alias("a"), "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    single = bars.join(others, "lang").where("a <> b").groupBy("lang", "a", "b").agg(
        F.sum(F.col("times") * (F.abs(F.col("p") - F.col("z")) - apart)).alias("value")
    )
    path = F.sort_array(F.collect_list(F.struct("source", "occ", "p", "p0")))
    rows = shares.groupBy("lang", "term").agg(path.alias("path")).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    # These three are read in both directions, and are no larger than the result.
    once = durable(single.unionByName(tree_corrections(rows)), "divergence-pairs")
    turned = once.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    values = base.unionByName(once).unionByName(turned).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        part.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit(name))
        for name, part in (("pair", values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")), ("term", terms))
    ]
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(columns).unionByName(ranked[1].where(F.col("rank") <= top_terms).select(columns))
