"""Quality classifier: interpolated modified Kneser-Ney perplexity under a model of trusted text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import small_batches
from tributary.session import durable

#: Length of n-grams, in characters: words of the trusted text can be new, their parts are not.
ORDER = 5
#: Least documents that a language trains with where ``train_docs`` asks for a sample and languages are many.
LEAST_TRAIN = 20
#: Most n-grams and contexts of the model that tasks hold; the others are joined by a shuffle (see ``score``).
MODEL_ROWS = 1 << 22
#: Most ids of training documents that are sent to all tasks; more are joined by a shuffle of the texts.
SENT_IDS = 1 << 22
#: Tokens of a language that a task counts at once.
GRAM_TOKENS = 1 << 20
#: Share of held-out trusted documents of a language and length band above the threshold, and how many a band must have.
TAIL, LEAST_HELD = 0.005, 100
#: Length bands are powers of this number of characters: short texts vary more.
BAND_BASE = 2
SPLIT_SEED = "kneser-ney"
#: Characters scored at once, which bounds memory for very long texts.
CHUNK = 1 << 18

#: Stand for what is before and after a text.
START, END = 0x110000, 0x110001
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def _tokens(data: bytes | None, order: int) -> np.ndarray:
    """Code points of a text's UTF-8 bytes between ``order - 1`` starts and one end."""
    points = np.frombuffer((data or b"").decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    return np.concatenate([np.full(order - 1, START, np.uint32), points, [np.uint32(END)]])


def gram_keys(tokens: np.ndarray, lang: np.uint64, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n from 1 to ``order``; valid from position ``order - 1`` on.

    A key is made from the last token backwards, so the context of token i is
    the n-gram that ends at i - 1. Languages have their own keys.
    """
    spread = _mix(tokens.astype(np.uint64) ^ lang)
    keys = [spread]
    for n in range(1, order):
        before = np.zeros_like(spread)
        before[n:] = spread[:-n]
        keys.append(_mix(keys[-1] * np.uint64(3) + before + np.uint64(n)))
    return keys


def _fill(halves: Iterable[float], total: float) -> float:
    """The level up to which all of ``halves`` can be taken without more than ``total`` in sum; at least ``LEAST_TRAIN``."""
    waiting = sorted(halves)
    for i, half in enumerate(waiting):
        level = total / (len(waiting) - i)
        if half >= level:
            return max(level, LEAST_TRAIN)
        total -= half
    return max(waiting, default=LEAST_TRAIN)


def _hashed(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SPLIT_SEED), key), F.lit(1 << 30))


def _split(df: DataFrame, labels: DataFrame, id_col: str, lang_col: str, train_docs: int | None) -> DataFrame:
    """``__id, trains`` of trusted documents: quality 1 and not toxic in every label they have.

    Half of them train. If ``train_docs`` asks for a sample, each language
    trains with half of its own, or with its share of ``train_docs``, whatever
    the number of documents in other languages.
    """
    own = labels.select(labels["doc_id"].cast("long").alias("__id"), "quality", "toxic").where("__id is not null")
    trusted = own.groupBy("__id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0")
    if train_docs is None:
        return trusted.select("__id", (_hashed(F.col("__id")) < 1 << 29).alias("trains"))
    langs = df.select(df[id_col].cast("long").alias("__id"), F.xxhash64(df[lang_col].isNull(), df[lang_col]).alias("__lang"))
    trusted = trusted.select("__id").join(langs, "__id").groupBy("__id").agg(F.min("__lang").alias("__lang"))
    trusted = durable(trusted, "trusted")
    # One row per language, as in the model.
    sizes = durable(trusted.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")), "trusted-sizes")
    level = _fill([r[0] / 2 for r in sizes.select("n").toLocalIterator()], train_docs)
    share = F.least(F.lit(0.5), F.lit(float(level)) / F.col("n"))
    return trusted.join(F.broadcast(sizes), "__lang").select("__id", (_hashed(F.col("__id")) < share * (1 << 30)).alias("trains"))


def unlearnt(judged: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Languages that the model has not learnt, with the ``rows`` of ``judged`` that pass unjudged for it."""
    return judged.where("perplexity is null").groupBy(lang_col).agg(F.count(F.lit(1)).alias("rows"))


def _gram_rows(docs: DataFrame, order: int) -> DataFrame:
    """``lang, gram, c`` of every n-gram of length ``order`` of every training text (``lang``, ``data``).

    ``lang`` is the language's key; a gram has three bytes for each token.
    Shorter n-grams that end at a token are the ends of these.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str | None, list[np.ndarray]] = {}
        sizes: dict[str | None, int] = {}
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data"), strict=True):
                tokens = _tokens(data.as_py(), order)
                back = order - 1
                for start in range(0, len(tokens) - back, GRAM_TOKENS):
                    part = tokens[start : start + GRAM_TOKENS + back]
                    waiting.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= GRAM_TOKENS:
                        yield _counted(waiting.pop(lang), lang, order)
                        del sizes[lang]
                if len(waiting) > 64 or sum(sizes.values()) >= 4 * GRAM_TOKENS:
                    for x in list(waiting):
                        yield _counted(waiting.pop(x), x, order)
                    sizes.clear()
        for lang, texts in waiting.items():
            yield _counted(texts, lang, order)

    return docs.select("lang", "data").mapInArrow(run, "lang long, gram binary, c long")


def _counted(texts: list[np.ndarray], lang: str | None, order: int) -> pa.RecordBatch:
    """Each n-gram of length ``order`` of some texts of a language once, with its count."""
    tokens, own = np.concatenate(texts), _language(lang)
    # The first tokens of each part are the context of its others only.
    ends = np.concatenate([np.arange(len(t)) >= order - 1 for t in texts])
    at = np.flatnonzero(ends)
    _, first, count = np.unique(gram_keys(tokens, own, order)[-1][at], return_index=True, return_counts=True)
    points = tokens[at[first][:, None] + np.arange(1 - order, 1)]
    columns = [pa.array(np.full(len(first), own).view(np.int64)), _grams(points), pa.array(count)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "gram", "c"])


def _grams(points: np.ndarray) -> pa.Array:
    """Rows of tokens as binary values, three bytes a token."""
    rows, n = points.shape
    data = np.ascontiguousarray(points.astype("<u4")).view(np.uint8).reshape(rows, n, 4)[:, :, :3].tobytes()
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(3 * n)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _keys_of(langs: np.ndarray, grams: pa.Array, n: int) -> np.ndarray:
    """Keys of n-grams given as binary values."""
    points = np.zeros((len(grams), n, 4), np.uint8)
    points[:, :, :3] = np.frombuffer(b"".join(grams.to_pylist()), np.uint8).reshape(len(grams), n, 3)
    points = points.view("<u4")[:, :, 0].astype(np.uint64)
    key = _mix(points[:, -1] ^ langs.view(np.uint64))
    for i in range(1, n):
        key = _mix(key * np.uint64(3) + _mix(points[:, -1 - i] ^ langs.view(np.uint64)) + np.uint64(i))
    return key


def _language(lang: str | None) -> np.uint64:
    """The key of a language."""
    return np.uint64(xxhash.xxh64_intdigest("\x03" if lang is None else f"\x04{lang}"))


class Table:
    """Values by key: sorted, with the place where each run of equal leading bits starts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        # The last key ends every search.
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.values = np.append(values[order], 0.0)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the values of all (any for the others)."""
        # Keys are mixed, so a run is short.
        at = self.starts[(keys >> self.shift).astype(np.int64)]
        met = self.keys[at]
        before = np.flatnonzero(met < keys)
        while len(before):
            at[before] += 1
            met[before] = self.keys[at[before]]
            before = before[met[before] < keys[before]]
        return met == keys, self.values[at]


@dataclass
class Rest:
    """The whole model on the cluster: ``lang, gram, v`` by order, of n-grams and of contexts."""

    grams: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame] = field(default_factory=list)


@dataclass
class Model:
    """Log probabilities of seen n-grams and log weights of seen contexts, by order.

    If ``rest`` is there, the tables lack the rarer ones, and only tokens whose
    longest n-gram they have can be scored by them alone.
    """

    order: int
    grams: list[Table] = field(default_factory=list)
    contexts: list[Table] = field(default_factory=list)
    unknown: dict[int, float] = field(default_factory=dict)
    rest: Rest | None = field(default=None, repr=False)

    def logprob(self, data: bytes | None, lang: str | None) -> tuple[int, float]:
        """Tokens (characters) of a text with its end, and their natural log probability; NaN if the language was not learnt."""
        floor = self.unknown.get(int(_language(lang)))
        tokens = _tokens(data, self.order)
        n, back = len(tokens) - self.order + 1, self.order - 1
        if floor is None:
            return n, float("nan")
        return n, sum(self._part(tokens[i : i + CHUNK + back], lang, floor) for i in range(0, n, CHUNK))

    def _part(self, tokens: np.ndarray, lang: str | None, floor: float) -> float:
        """Log probability of the tokens after the first ``order - 1``: recursively, from the longest n-gram down."""
        keys = gram_keys(tokens, _language(lang), self.order)
        left, total = np.arange(self.order - 1, len(tokens)), 0.0
        for i in range(self.order - 1, -1, -1):
            found, value = self.grams[i].find(keys[i][left])
            total += float(value[found].sum())
            left = left[~found]
            if i and len(left):
                known, weight = self.contexts[i].find(keys[i - 1][left - 1])
                total += float(weight[known].sum())
        return total + floor * len(left)

    def split(self, data: bytes | None, lang: str | None) -> tuple[int, float, np.ndarray]:
        """Like ``logprob`` for the tokens whose longest n-gram the tables have; the others' longest n-grams are given as they are."""
        tokens, back = _tokens(data, self.order), self.order - 1
        n, total, rest = len(tokens) - back, 0.0, []
        if int(_language(lang)) not in self.unknown:
            return n, float("nan"), np.empty((0, self.order), np.uint32)
        for start in range(0, n, CHUNK):
            part = tokens[start : start + CHUNK + back]
            found, value = self.grams[-1].find(gram_keys(part, _language(lang), self.order)[-1][back:])
            total += float(value[found].sum())
            rest.append(part[np.flatnonzero(~found)[:, None] + np.arange(self.order)])
        return n, total, np.concatenate(rest)


def train(docs: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS) -> Model:
    """The model of ``docs(lang, data)``, counted and joined by n-gram on the cluster.

    The highest order counts occurrences, lower ones count distinct words
    before. Discounts D1, D2, D3+ come from the numbers of n-grams met once to
    four times, by order. Probabilities are interpolated from the order below
    by joins on the sharded n-grams; the shortest one from the uniform
    distribution over the language's words and one unknown word.

    If n-grams and contexts are more than ``model_rows`` in all, the model's own
    tables have the longest n-grams with the highest counts, and its ``rest`` has all.
    """
    top = _gram_rows(docs, order).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    tables = [durable(top, "kn-counts")]
    for n in range(order - 1, 0, -1):
        # Each longer n-gram is one way to come to its shorter form.
        ways = tables[0].groupBy("lang", F.substring("gram", 4, 3 * n).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        tables.insert(0, durable(ways, "kn-counts"))
    model, rest, lower, sizes = Model(order), Rest(), None, 0
    for i, table in enumerate(tables):
        met = table.agg(*[F.sum((F.col("c") == c).cast("long")).alias(f"n{c}") for c in range(1, 5)], F.count(F.lit(1)).alias("all")).first()
        d = _discounts([met[f"n{c}"] or 0 for c in range(1, 5)])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        table = table.withColumns({"context": F.substring("gram", 1, 3 * i), "shorter": F.substring("gram", 4, 3 * i)})
        sums = table.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum(off).alias("left"), F.count(F.lit(1)).alias("types"))
        sums = durable(sums, "kn-contexts")
        joined = table.join(sums, ["lang", "context"])
        own, weight = (F.col("c") - off) / F.col("total"), F.col("left") / F.col("total")
        if lower is None:
            p = own + weight / (F.col("types") + 1)
            floors = sums.select("lang", F.log(weight / (F.col("types") + 1)).alias("floor"))
            model.unknown = {int(np.int64(r[0]).view(np.uint64)): r[1] for r in floors.toLocalIterator()}
        else:
            p = own + weight * F.col("below")
            joined = joined.join(lower, ["lang", "shorter"])
        probs = durable(joined.select("lang", "gram", "c", p.alias("p")), "kn-probs")
        rest.grams.append(probs.select("lang", "gram", F.log("p").alias("v"), "c"))
        rest.contexts.append(sums.select("lang", F.col("context").alias("gram"), F.log(weight).alias("v")))
        sizes += met["all"] + (sums.count() if i else 0)
        lower = probs.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
    none = Table(np.empty(0, np.uint64), np.empty(0))
    if sizes <= model_rows:
        model.grams = [_held(t, i + 1) for i, t in enumerate(rest.grams)]
        model.contexts = [_held(t, i) if i else none for i, t in enumerate(rest.contexts)]
        return model
    levels = [F.sum((F.col("c") >= 1 << j).cast("long")).alias(f"l{j}") for j in range(48)]
    met = rest.grams[-1].agg(*levels).first()
    least = next(1 << j for j in range(48) if met[f"l{j}"] <= model_rows)
    model.grams = [none] * (order - 1) + [_held(rest.grams[-1].where(F.col("c") >= least), order)]
    model.rest = rest
    return model


def _discounts(met: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; where a count is missing, 0.5, 1 and 1.5."""
    if not all(met):
        return 0.5, 1.0, 1.5
    y = met[0] / (met[0] + 2 * met[1])
    found = [i + 1 - (i + 2) * y * met[i + 1] / met[i] for i in range(3)]
    return tuple(min(max(f, 0.05), i + 0.95) for i, f in enumerate(found))


def _held(df: DataFrame, n: int) -> Table:
    """A table of bounded size, with n-grams of length ``n``, for the tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys_of(batch.column("lang").to_numpy(), batch.column("gram"), n).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("v")], ["key", "v"])

    rows = df.select("lang", "gram", "v").mapInArrow(run, "key long, v double").toArrow()
    keys, values = (rows.column(c).to_numpy() for c in ("key", "v"))
    return Table(keys.view(np.uint64), values)


def score(
    df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", keep: Sequence[str] | None = None
) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``n_tokens, logprob, perplexity``; null where the language was not learnt.

    Where the model has a rest, tasks score the tokens whose longest n-gram
    they hold. The others' n-grams meet the whole model by joins, each distinct
    one once, and their sums go back to their rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    kept = [c for c in keep or df.columns if c not in {"n_tokens", "logprob", "perplexity"}]
    # A text that is kept is not sent twice.
    text_at = kept.index(text_col) if text_col in kept else len(kept) + 1
    rows = df.select(
        *[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)], df[lang_col].alias("__lang"),
        *[df[text_col].alias("__text")] * (text_col not in kept),
    )
    kinds = "".join(f"c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept)) + "n_tokens long, logprob double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, langs, texts = batch.columns[: len(kept)], batch.column(len(kept)), batch.column(text_at)
            found = [shared.value.logprob(_bytes(t), x.as_py()) for t, x in zip(texts, langs, strict=True)]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([None if f[1] != f[1] else f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*own, *columns], [*batch.schema.names[: len(kept)], "n_tokens", "logprob"])

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with what the tables give, and the n-grams that they lack, once per row."""
        for batch in batches:
            own, langs, texts = batch.columns[: len(kept)], batch.column(len(kept)), batch.column(text_at)
            names, ids = [*batch.schema.names[: len(kept)], "n_tokens", "logprob", "__row", "__lang", "gram", "times"], batch.column("__row").to_pylist()
            for at, (t, x) in enumerate(zip(texts, langs, strict=True)):
                n, logprob, lacking = shared.value.split(_bytes(t), x.as_py())
                grams, times = np.unique(lacking, axis=0, return_counts=True)
                extra = [pa.array([n]), pa.array([None if logprob != logprob else logprob], pa.float64()), pa.array([ids[at]]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 1) for c in own), *extra], names)
                k = len(grams)
                extra = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array([ids[at]] * k, pa.int64())]
                extra += [pa.array(np.full(k, _language(x.as_py())).view(np.int64)), _grams(grams), pa.array(times)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(k, c.type) for c in own), *extra], names)

    if model.rest is None:
        scored = rows.mapInArrow(run, kinds)
    else:
        told = rows.withColumn("__row", F.monotonically_increasing_id()).mapInArrow(tell, kinds + ", __row long, __lang long, gram binary, times long")
        told = durable(told, "kn-told")
        lacking = told.where("gram is not null").select("__row", F.col("__lang").alias("lang"), "gram", "times")
        sums = lacking.join(_answers(lacking, model), ["lang", "gram"]).groupBy("__row").agg(F.sum(F.col("times") * F.col("v")).alias("__more"))
        scored = told.where("gram is null").drop("__lang", "gram", "times").join(sums, "__row", "left")
        scored = scored.withColumn("logprob", F.col("logprob") + F.coalesce("__more", F.lit(0.0))).drop("__row", "__more")
    scored = scored.withColumnsRenamed({f"c{i}": c for i, c in enumerate(kept)})
    return scored.withColumn("perplexity", F.exp(-F.col("logprob") / F.col("n_tokens")))


def _answers(lacking: DataFrame, model: Model) -> DataFrame:
    """``lang, gram, v`` of each distinct n-gram of length ``order``: its log probability by the whole model."""
    order, rest = model.order, model.rest
    asked, answers = lacking.select("lang", "gram").distinct().withColumn("v", F.lit(0.0)), []
    for n in range(order, 0, -1):
        short = F.substring("gram", 3 * (order - n) + 1, 3 * n)
        own = rest.grams[n - 1].select("lang", F.col("gram").alias("__short"), F.col("v").alias("__p"))
        met = durable(asked.withColumn("__short", short).join(own, ["lang", "__short"], "left").drop("__short"), "kn-asked")
        answers.append(met.where("__p is not null").select("lang", "gram", (F.col("v") + F.col("__p")).alias("v")))
        asked = met.where("__p is null").drop("__p")
        if n > 1:
            context = F.substring("gram", 3 * (order - n) + 1, 3 * (n - 1))
            weights = rest.contexts[n - 1].select("lang", F.col("gram").alias("__short"), F.col("v").alias("__w"))
            asked = asked.withColumn("__short", context).join(weights, ["lang", "__short"], "left")
            asked = asked.select("lang", "gram", (F.col("v") + F.coalesce("__w", F.lit(0.0))).alias("v"))
    floors = [(int(np.uint64(k).view(np.int64)), float(v)) for k, v in model.unknown.items()]
    floors = lacking.sparkSession.createDataFrame(floors, "lang long, floor double")
    answers.append(asked.join(F.broadcast(floors), "lang").select("lang", "gram", (F.col("v") + F.col("floor")).alias("v")))
    return reduce(DataFrame.unionByName, answers)


def _bytes(text: pa.StringScalar) -> bytes | None:
    return bytes(text.as_buffer()) if text.is_valid else None


def band(n_tokens: Column) -> Column:
    """Length band of a text."""
    return F.floor(F.log(n_tokens.cast("double")) / F.log(F.lit(float(BAND_BASE)))).cast("int")


def classify(
    df: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: Sequence[str] | None = None,
    order: int = ORDER,
    train_docs: int | None = None,
    tail: float = TAIL,
    least_held: int = LEAST_HELD,
    model_rows: int = MODEL_ROWS,
) -> DataFrame:
    """``df`` (or its columns ``keep``, the id and language among them) with ``n_tokens, perplexity, high, kept``.

    Trusted documents are those labelled good and not toxic. Half of them, or a sample of
    about ``train_docs`` drawn per language if that is given, train the model; all others, which the model has not
    seen, give the thresholds: the quantile ``1 - tail`` of perplexity, by
    language and length band. A document above it, unlike its language, is
    rejected. Where a language and band has fewer than ``least_held`` such
    documents, those of the language decide, then those of all languages. A
    document without text, or in a language without training text (see
    ``unlearnt``), is kept: nothing is known against it. Without labels all are kept. Null text is
    empty, null languages are one language, rows that repeat are judged alike.
    Columns of these names are replaced. Documents are scored once, written
    with their score, and not shuffled, unless the model has more than ``model_rows`` rows (see ``score``).
    """
    small_batches(df.sparkSession)
    split = durable(_split(df, labels, id_col, lang_col, train_docs), "kn-split")
    source = df.select(df[id_col].cast("long").alias("__id"), df[lang_col].alias("lang"), df[text_col].cast("binary").alias("data"))
    ids = split.where("trains").select("__id")
    # No more than half of the ids train, so a shuffle moves at most half of the texts.
    chosen = source.where(_hashed(F.col("__id")) < 1 << 29).join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "__id")
    model = train(durable(chosen.select("lang", "data"), "kn-texts"), order, model_rows)
    gone = {"n_tokens", "logprob", "perplexity", "high", "kept"}
    columns = [c for c in (keep or df.columns) if c not in gone]
    scored = durable(score(df, model, text_col, lang_col, columns), "kn-scored").withColumn("__band", band(F.col("n_tokens")))
    held = scored.select(F.col(id_col).cast("long").alias("__id"), F.col(lang_col).alias("lang"), F.col("__band").alias("band"), "n_tokens", "perplexity")
    held = held.join(split.where("not trains").select("__id"), "__id").where("perplexity is not null and n_tokens > 1")
    quantile = F.percentile_approx("perplexity", 1 - tail, 10_000).alias("q")
    limits = held.rollup("lang", "band").agg(quantile, F.grouping_id().alias("level"), F.count(F.lit(1)).alias("held"))
    limits = durable(limits.where(f"level = 3 or held >= {int(least_held)}"), "kn-limits")
    levels = [limits.where(F.col("level") == n) for n in (0, 1, 3)]
    judged = (
        scored.join(levels[0].select(F.col("lang").alias("__l0"), F.col("band").alias("__b0"), F.col("q").alias("__q0")),
                    F.col(lang_col).eqNullSafe(F.col("__l0")) & (F.col("__band") == F.col("__b0")), "left")
        .join(levels[1].select(F.col("lang").alias("__l1"), F.col("q").alias("__q1")), F.col(lang_col).eqNullSafe(F.col("__l1")), "left")
        .join(F.broadcast(levels[2].select(F.col("q").alias("__q2"))), F.lit(True), "left")
    )
    judged = judged.withColumn("high", F.coalesce("__q0", "__q1", "__q2"))
    fine = (F.col("n_tokens") <= 1) | (F.col("perplexity") <= F.col("high"))
    return judged.withColumn("kept", F.coalesce(fine, F.lit(True))).select(
        *[F.col(f"`{c}`") for c in columns], "n_tokens", "perplexity", "high", "kept"
    )
