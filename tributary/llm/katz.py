"""Katz backoff: Good-Turing discounted bigrams learnt from a whole corpus, with exactly normalised backoff weights.

Counts grow with the corpus and stay in partitioned tables. Tasks hold only what
has a bound: the most frequent words (``VOCAB``), one weight for each of them as
a context, and the most frequent bigrams. All other tokens meet their counts by
a shuffle, as packed arrays by shard: bigrams of frequent words by their context,
bigrams with a rare word by that word. All that is met with a rare word is in its
shard, so that its own count and its sums as a context come from there; a bigram
of two rare words goes to both. So every word has its own bigrams, and ``VOCAB``
decides only which way a count takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import byte_words, small_batches
from tributary.session import durable

#: Most words with a number of their own, which tasks hold. All others meet in the shards of rare words.
VOCAB = 1 << 21
#: Most bigrams that every task holds; they carry the hot ones past the shuffle.
HOT_BIGRAMS = 1 << 19
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Training tokens per shard of bigrams; contexts above a shard's half are spread over several.
SHARD_TOKENS = 1_500_000
#: Training tokens without a number per shard of them, and the most bytes of held-out text, in which any word may be unknown.
RARE_TOKENS, HELD_BYTES = 200_000, 16 << 20
#: Bytes of text handled at once in a task.
CHUNK_BYTES = 2 << 20
#: Hash of the end token: no word is a space.
END = xxhash.xxh64_intdigest(b" ")
SHIFT = 22
#: Set in the hash of a word without a number, so that it is negative and no number.
RARE = -1 << 63
#: What a packed row has: bigrams of numbers; pairs of a word without a number, by it, and the word before it, or the word after
#: it; own counts of the words without a number that follow one.
NUMBERED, AS_WORD, AS_CONTEXT, OWN = range(4)


def discounts(met: list[int]) -> np.ndarray:
    """Katz's discount of counts 0 to ``DISCOUNTED``, then 1 for all above; ``met[r]`` is how many were met r times.

    Where too few were met for a ratio between zero and one, ``1 - 1 / 2r`` is used.
    """
    k = DISCOUNTED
    out = np.ones(k + 2)
    common = (k + 1) * met[k + 1] / met[1] if met[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * met[r + 1] / (r * met[r]) - common) / (1 - common) if met[r] and common != 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 1 / (2 * r)
    return out


@dataclass
class Words:
    """The frequent words: hashes in order, counts, discounted probabilities; what all others get and the start follow as numbers."""

    hashes: np.ndarray
    counts: np.ndarray
    probs: np.ndarray
    total: int
    distinct: int
    discount: np.ndarray
    left: float
    shards: int
    rare_shards: int

    @property
    def other(self) -> int:
        return len(self.hashes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by hash; rare and unknown ones get ``other``."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, self.other)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        """Shards of bigrams: by context, hot contexts by second word too."""
        context, word = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
        held = np.append(self.counts, [self.total, self.total])[context]
        part = word % (1 + held // (SHARD_TOKENS // 2))
        return _spread(context * 1_000_003 + part, self.shards)

    def rare_shard(self, codes: np.ndarray) -> np.ndarray:
        """Shards of words without a number; they come after all others."""
        return self.shards + _spread(codes, self.rare_shards)


def _spread(values: np.ndarray, shards: int) -> np.ndarray:
    mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers by byte plane, as many planes as the largest needs; steps from the first one if in order."""
    steps = np.diff(values)
    in_order = len(values) > 0 and (not len(steps) or int(steps.min()) >= 0)
    body = steps if in_order else values
    width = (int(body.max()).bit_length() + 7) // 8 if len(body) else 0
    head = np.array([len(values), values[0] if in_order else -1, width], "<i8").tobytes()
    return head + body.astype("<i8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, first, width = np.frombuffer(data, "<i8", 3).tolist()
    in_order = first >= 0
    bytewise = np.zeros((n - in_order, 8), np.uint8)
    if width:
        bytewise[:, :width] = np.frombuffer(data, np.uint8, offset=24).reshape(width, -1).T
    body = bytewise.view("<i8").reshape(-1)
    return np.cumsum(np.concatenate(([first], body))) if in_order else body


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes of words: what has a number as ``pack`` does it, the others' hashes after."""
    rare = codes < 0
    return pack(np.where(rare, 0, codes + 1)) + codes[rare].astype("<i8").tobytes()


def unpack_codes(data: bytes) -> np.ndarray:
    n, first, width = np.frombuffer(data, "<i8", 3).tolist()
    stop = 24 + (n - (first >= 0)) * width
    codes = unpack(data[:stop]) - 1
    codes[codes < 0] = np.frombuffer(data, "<i8", offset=stop)
    return codes


def _joined(unpacked: Callable[[bytes], np.ndarray], parts: Iterable[bytes]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *map(unpacked, parts)])


def _raw(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of these rows, and where in it another row begins."""
    order = np.lexsort(columns[::-1])
    new = np.arange(len(order)) == 0
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    return order, np.flatnonzero(new)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``CHUNK_BYTES`` of text, their tokens' hashes, and each token's row in the slice."""
    size = np.cumsum([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column("data")])
    cuts = [0, *(np.flatnonzero(np.diff(size // CHUNK_BYTES)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:], strict=False):
        part = batch.slice(start, stop - start)
        hashes, lengths = [], []
        for x in part.column("data"):
            words = byte_words(x.as_py())
            lengths.append(len(words) + 1)
            hashes.append(np.fromiter(chain(map(xxhash.xxh64_intdigest, words), (END,)), np.uint64, len(words) + 1))
            del words
        if hashes:
            tokens = np.concatenate(hashes).view(np.int64)
            hashes.clear()
            yield part, tokens, np.repeat(np.arange(len(lengths)), lengths)


def _bigrams(words: Words, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and code of every token, and where both are numbers; the start is the context of a text's first.

    A code is the number of a frequent word, and else its negative hash.
    """
    numbers = words.numbers(hashes)
    codes = np.where(numbers == words.other, hashes | RARE, numbers)
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[np.flatnonzero(np.diff(rows, prepend=-1))] = words.other + 1
    return before, codes, (before >= 0) & (codes >= 0)


def _word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` of the training tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, _ in _chunks(batch):
                word, c = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(c)], ["word", "c"])

    counted = texts.select("data").mapInArrow(run, "word long, c long")
    return durable(counted.groupBy("word").agg(F.sum("c").alias("c")), "katz-words")


def _collected(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table whose size has a bound; the driver keeps nothing else of it."""
    table = df.toArrow()
    columns = []
    while table.num_columns:
        columns.append(np.array(table.column(0)))
        table = table.remove_column(0)
    del table
    pa.default_memory_pool().release_unused()
    return columns


def _frequent(counts: DataFrame, vocab: int, held_bytes: int) -> Words:
    """The frequent words; the least count they have is a power of two that leaves at most ``vocab``."""
    levels = [F.sum((F.col("c") >= 1 << j).cast("long")).alias(f"l{j}") for j in range(48)]
    met = [F.sum((F.col("c") == r).cast("long")).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)]
    facts = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), *levels, *met).first()
    total, distinct = facts["n"] or 0, facts["v"]
    least = next(1 << j for j in range(48) if (facts[f"l{j}"] or 0) <= vocab)
    hashes, c = _collected(counts.where(F.col("c") >= least))
    order = np.argsort(hashes, kind="stable")
    d = discounts([0, *(facts[f"n{r}"] or 0 for r in range(1, DISCOUNTED + 2))])
    mass = sum(float(d[r] * r * (facts[f"n{r}"] or 0)) for r in range(1, DISCOUNTED + 1))
    mass += total - sum(r * (facts[f"n{r}"] or 0) for r in range(1, DISCOUNTED + 1))
    # What discounting leaves is the probability of one unknown word.
    left = max(1 - mass / total, 0.5 / total) if total else 1.0
    scale = (1 - left) * total / mass if total else 1.0
    probs = c[order] * d[np.minimum(c[order], DISCOUNTED + 1)] * scale / max(total, 1)
    shards = int(max(1, -(-total // SHARD_TOKENS)))
    rare_shards = int(max(1, -(-(total - int(c.sum())) // RARE_TOKENS), -(-held_bytes // HELD_BYTES)))
    return Words(hashes[order], c[order], probs, total, distinct, d * scale, left, shards, rare_shards)


def _blobs(shard: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows by shard, in the order of their keys."""
    order = np.lexsort((keys, shard))
    shards, first = np.unique(shard[order], return_index=True)
    for s, start, stop in zip(shards.tolist(), first, np.append(first, len(order))[1:], strict=True):
        at = order[start:stop]
        yield s, [keys[at], *(c[at] for c in columns)]


def _by_rare(words: Words, context: np.ndarray, word: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Shard, role and rows of pairs with a word that has no number: that one, the other one and the columns."""
    for role, key, other in ((AS_WORD, word, context), (AS_CONTEXT, context, word)):
        at = key < 0
        for s, found in _blobs(words.rare_shard(key[at]), key[at], other[at], *(c[at] for c in columns)):
            yield s, role, found


#: Columns of packed counts.
PACKED = "shard long, role int, keys binary, others binary, counts binary"
PACKED_ARROW = pa.schema({"shard": pa.int64(), "role": pa.int32(), "keys": pa.binary(), "others": pa.binary(), "counts": pa.binary()})


def _packed(rows: Iterable[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(PACKED_ARROW.names, r, strict=True)) for r in rows], PACKED_ARROW)


def _bigram_counts(texts: DataFrame, shared: object) -> DataFrame:
    """Training bigrams, packed by shard and role in the order of ``keys`` and ``others``, and how many were met 1 to 6 times.

    Bigrams of numbers have one key. Pairs with a word that has no number have its code as key and the other's among ``others``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for _, hashes, rows in _chunks(batch):
                before, codes, plain = _bigrams(words, hashes, rows)
                key, c = np.unique(before[plain] << SHIFT | codes[plain], return_counts=True)
                out = [(s, NUMBERED, pack(k), None, pack(n)) for s, (k, n) in _blobs(words.shard(key), key, c)]
                context, word = before[~plain], codes[~plain]
                order, first = _distinct(context, word)
                pairs = context[order[first]], word[order[first]], np.diff(first, append=len(order))
                out += [(s, role, k.tobytes(), pack_codes(o), pack(n)) for s, role, (k, o, n) in _by_rare(words, *pairs)]
                yield _packed(out)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for role, rows in group.groupby("role"):
            columns = [_joined(unpack if role == NUMBERED else _raw, rows["keys"])]
            columns += [_joined(unpack_codes, rows["others"])] if role != NUMBERED else []
            order, first = _distinct(*columns)
            counts = _sums(_joined(unpack, rows["counts"])[order], first)
            key, *other = (c[order[first]] for c in columns)
            # Two words without numbers are in two tables.
            once = counts[other[0] >= 0] if role == AS_WORD else counts
            met = np.bincount(np.minimum(once, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
            packed = (key.tobytes(), pack_codes(other[0])) if other else (pack(key), None)
            out.append((rows["shard"].iloc[0], role, *packed, pack(counts), *met[1 : DISCOUNTED + 2].tolist()))
        return pd.DataFrame(out, columns=[*PACKED_ARROW.names, *(f"n{r}" for r in range(1, DISCOUNTED + 2))])

    packed = texts.select("data").mapInArrow(run, PACKED)
    kinds = PACKED + "".join(f", n{r} long" for r in range(1, DISCOUNTED + 2))
    return durable(packed.groupBy("shard").applyInPandas(merge, kinds), "katz-bigrams")


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]]:
    """Role, keys, others and counts of packed rows."""
    for batch in batches:
        for r in batch.select(["role", "keys", "others", "counts"]).to_pylist():
            numbered = r["role"] == NUMBERED
            yield r["role"], (unpack if numbered else _raw)(r["keys"]), None if numbered else unpack_codes(r["others"]), unpack(r["counts"])


def _rare_probs(words: Words, counts: np.ndarray) -> np.ndarray:
    """Probabilities of words without a number by their own counts, zero if not met in training."""
    known = counts * words.discount[np.minimum(counts, DISCOUNTED + 1)] / max(words.total, 1)
    return np.where(counts > 0, known, words.left)


def _own(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in order, their counts, and for each pair the place of its word."""
    _, first = _distinct(keys)
    return keys[first], _sums(counts, first), np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))


@dataclass
class Contexts:
    """By word number: what a context's counts are divided by, and the log10 weight of backing off; and the hot bigrams."""

    seen: np.ndarray
    weight: np.ndarray
    discount: np.ndarray
    hot_keys: np.ndarray
    hot_counts: np.ndarray


def _contexts(bigrams: DataFrame, shared: object, words: Words, hot: int) -> Contexts:
    """Sums over the shards by context that has a number, and the bigrams of the highest counts."""
    met = bigrams.agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, DISCOUNTED + 2)]).first()
    d = discounts([0, *(met[f"n{r}"] or 0 for r in range(1, DISCOUNTED + 2))])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for role, keys, others, counts in _unpacked(batches):
            if role == NUMBERED:
                context, probs = keys >> SHIFT, held.probs[keys & ((1 << SHIFT) - 1)]
            else:
                at = others >= 0
                _, own, place = _own(keys, counts)
                context, counts, probs = others[at], counts[at], _rare_probs(held, own)[place[at]]
            order, first = _distinct(context)
            parts = (counts, counts * d[np.minimum(counts, DISCOUNTED + 1)], probs)
            found = [context[order[first]], *(_sums(p[order], first).astype(float) for p in parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["context", "seen", "mass", "low"])

    def levels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("counts"):
                level, size = np.unique(np.log2(unpack(n.as_py())).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(size)], ["level", "n"])

    summed = bigrams.where(F.col("role") != AS_CONTEXT).mapInArrow(sums, "context long, seen double, mass double, low double")
    # At most one row per word with a number.
    at, *found = _collected(summed.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("seen", "mass", "low")]))
    seen, weight = np.zeros(words.other + 2), np.zeros(words.other + 2)
    seen[at], weight[at] = _weights(words, *found)
    del at, found
    numbered = bigrams.where(F.col("role") == NUMBERED)
    sizes = numbered.select("counts").mapInArrow(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    least, held = 1 << 62, 0
    for r in sizes:
        held += r["n"]
        if held > hot:
            break
        least = 1 << r["level"]
    floor = max(least, 2)

    def frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column("keys"), batch.column("counts"), strict=True):
                keys, counts = unpack(k.as_py()), unpack(n.as_py())
                at = counts >= floor
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(counts[at])], ["key", "c"])

    hot_keys, hot_counts = _collected(numbered.select("keys", "counts").mapInArrow(frequent, "key long, c long"))
    order = np.argsort(hot_keys, kind="stable")
    return Contexts(seen, weight, d, hot_keys[order], hot_counts[order])


def _weights(words: Words, total: np.ndarray, mass: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What contexts' counts are divided by and their log10 weights of backing off."""
    # A context whose counts are all too high to be discounted still leaves half a count for what it was not met with.
    seen = np.maximum(total, mass + 0.5)
    # Seen words leave at least the unknown one; floats may round that to zero.
    return seen, np.log10(1 - mass / seen) - np.log10(np.maximum(1 - low, words.left))


def _own_counts(bigrams: DataFrame, shared: object) -> DataFrame:
    """For contexts without a number, packed by their shard: the own counts of the words without a number after them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for _, keys, others, counts in _unpacked(batches):
            _, own, place = _own(keys, counts)
            at = others < 0
            found = _blobs(words.rare_shard(others[at]), others[at], keys[at], own[place[at]])
            yield _packed((s, OWN, k.tobytes(), pack_codes(o), pack(n)) for s, (k, o, n) in found)

    return bigrams.where(F.col("role") == AS_WORD).mapInArrow(run, PACKED)


def _find(keys: np.ndarray, sorted_keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of keys, zero for those not there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, counts[at], 0)


def _logprob(words: Words, contexts: Contexts, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of each bigram's probability given its count: discounted if seen, else backed off to the word's own."""
    context, word = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
    # A context that was never met has weight one.
    return _backed_off(contexts, counts, contexts.seen[context], contexts.weight[context], words.probs[word])


def _backed_off(contexts: Contexts, counts: np.ndarray, seen: np.ndarray, weight: np.ndarray, probs: np.ndarray) -> np.ndarray:
    known = counts > 0
    direct = counts * contexts.discount[np.minimum(counts, DISCOUNTED + 1)] / np.maximum(seen, 1)
    return np.where(known, np.log10(np.where(known, direct, 1)), weight + np.log10(probs))


class RarePairs:
    """The pairs of one shard and role: what was met with words that have no number."""

    def __init__(self, keys: np.ndarray, others: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.others, self.counts = keys, others, counts
        self.words, self.own, self.place = _own(keys, counts)
        self.after, rank = np.unique(others, return_inverse=True)
        self.pairs = self.place * len(self.after) + rank

    def of_words(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """``values``, one for each word here, of the words asked for; zero for those not here."""
        return _find(keys, self.words, values)

    def of_pairs(self, keys: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How often each pair was met."""
        if not len(self.pairs):
            return np.zeros(len(keys), np.int64)
        word, other = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((self.words, keys), (self.after, others)))
        here = (self.words[word] == keys) & (self.after[other] == others)
        return np.where(here, _find(word * len(self.after) + other, self.pairs, self.counts), 0)

    def weights(self, words: Words, discount: np.ndarray, told: RarePairs) -> tuple[np.ndarray, np.ndarray]:
        """Divisors and backoff weights of the words here as contexts; ``told`` has the own counts of those after them that have no number."""
        numbered = self.others >= 0
        probs = np.empty(len(self.others))
        probs[numbered] = words.probs[self.others[numbered]]
        # Both are in order of the same pairs.
        probs[~numbered] = _rare_probs(words, told.counts)
        mass = self.counts * discount[np.minimum(self.counts, DISCOUNTED + 1)]
        return _weights(words, self.own, *(np.bincount(self.place, x, len(self.words)) for x in (mass, probs)))


#: Columns of the rows that scoring a chunk gives; ``id`` has the type it has in the table.
FACTS = {
    "chunk": pa.int64(), "place": pa.int64(), "id": None, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(),
    "score": pa.float64(), "shard": pa.int64(), "role": pa.int32(), "keys": pa.binary(), "others": pa.binary(), "at": pa.binary(), "times": pa.binary(),
}
#: Of what a shard answers: what it was told of rows itself, and sums by row that are packed.
ANSWERS = {**dict(list(FACTS.items())[:8]), "at": pa.binary(), "known": pa.binary(), "base": pa.binary(), "logs": pa.binary()}


def _facts(kinds: dict[str, pa.DataType], n: int, **columns: object) -> pa.RecordBatch:
    """``n`` rows with these columns; the others are null."""
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def _columns(kinds: dict[str, pa.DataType], id_kind: str) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{c} {names.get(t, id_kind)}" for c, t in kinds.items())


def held_out(key: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the key's text leaves ``fold`` modulo ``folds``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab: int = VOCAB, hot_bigrams: int = HOT_BIGRAMS
) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``df``.

    Words are lower-cased (A to Z) and compared by 64-bit hash; every text ends
    with one end token and starts from a start context. The model is learnt from
    the rows that are not held out. ``base_score`` is add-one unigrams,
    ``score`` Katz bigrams of all words, both log10; ``vocab`` and ``hot_bigrams``
    bound what tasks hold and change no score. A null text has the end token only.
    Repeated rows count and are scored each. If no row trains, all words are
    unknown and share one probability. A task that is repeated after a loss must
    meet its rows in the same order, as tasks that read files do.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(
        F.monotonically_increasing_id().alias("row"), df[id_col].alias("id"), held_out(df[id_col]).alias("held_out"), df[text_col].cast("binary").alias("data")
    )
    training = texts.where("not held_out")
    held_bytes = texts.where("held_out").agg(F.sum(F.octet_length("data"))).first()[0] or 0
    words = _frequent(_word_counts(training), vocab, held_bytes)
    shared = spark.sparkContext.broadcast(words)
    bigrams = _bigram_counts(training, shared)
    # The driver keeps neither of the two: both are in files, from where tasks get them.
    model = spark.sparkContext.broadcast(_contexts(bigrams, shared, words, hot_bigrams))
    norm = float(np.log10(words.total + words.distinct + 1))

    def facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In one pass: what tasks know by themselves, by row; bigrams that no task knows, by shard, with the place in the
        chunk that has each; pairs with a word that has no number, by that word's shard, once per place with their number of times."""
        own, contexts = shared.value, model.value
        base = np.log10(own.counts + 1.0) - norm
        for batch in batches:
            kinds = {**FACTS, "id": batch.schema.field("id").type}
            for part, hashes, rows in _chunks(batch):
                before, codes, plain = _bigrams(own, hashes, rows)
                n, chunk, numbered, places = part.num_rows, part.column("row")[0].as_py(), codes >= 0, rows[plain]
                keys = before[plain] << SHIFT | codes[plain]
                met = _find(keys, contexts.hot_keys, contexts.hot_counts)
                hot, cold = met > 0, met == 0
                sums = [np.bincount(rows, minlength=n), np.bincount(rows, numbered, n).astype(np.int64)]
                sums += [np.bincount(rows[numbered], base[codes[numbered]], n)]
                sums += [np.bincount(places[hot], _logprob(own, contexts, keys[hot], met[hot]), n)]
                sums = dict(zip(("n_tokens", "n_known", "base_score", "score"), sums, strict=True))
                # They pass through any shard.
                shard = np.repeat(_spread(np.array([chunk]), own.shards), n)
                yield _facts(kinds, n, chunk=[chunk] * n, place=np.arange(n), id=part.column("id"), held_out=part.column("held_out"), shard=shard, **sums)
                out = [(s, NUMBERED, pack(k), None, pack(at), None) for s, (k, at) in _blobs(own.shard(keys[cold]), keys[cold], places[cold])]
                others = rows[~plain], before[~plain], codes[~plain]
                order, first = _distinct(*others)
                place, context, word = (c[order[first]] for c in others)
                found = _by_rare(own, context, word, place, np.diff(first, append=len(order)))
                out += [(s, role, k.tobytes(), pack_codes(o), pack(at), pack(times)) for s, role, (k, o, at, times) in found]
                if out:
                    columns = dict(zip(("shard", "role", "keys", "others", "at", "times"), zip(*out, strict=True), strict=True))
                    yield _facts(kinds, len(out), chunk=[chunk] * len(out), **columns)

    def numbered_answers(asked: Iterable[dict], keys: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        own, contexts = shared.value, model.value
        for r in asked:
            wanted, where = unpack(r["keys"]), unpack(r["at"])
            logs = np.bincount(where, _logprob(own, contexts, wanted, _find(wanted, keys, counts)))
            used = np.unique(where)
            yield {"chunk": r["chunk"], "at": pack(used), "logs": logs[used].tobytes()}

    def rare_answers(role: int, asked: list[dict], pairs: RarePairs, told: RarePairs) -> Iterator[dict]:
        """The log10 of a bigram of two words without numbers comes from its context's shard where it was met; else the
        weight comes from there and the word's own from the word's shard."""
        own, contexts = shared.value, model.value
        keys, others = (_joined(f, [r[c] for r in asked]) for c, f in (("keys", _raw), ("others", unpack_codes)))
        times = _joined(unpack, [r["times"] for r in asked])
        met, numbered = pairs.of_pairs(keys, others), others >= 0
        if role == AS_WORD:
            count = pairs.of_words(keys, pairs.own)
            probs, context = _rare_probs(own, count), np.where(numbered, others, 0)
            logs = _backed_off(contexts, met, contexts.seen[context], contexts.weight[context], probs)
            logs = times * np.where(numbered, logs, np.where(met > 0, 0.0, np.log10(probs)))
            known, base = np.where(count > 0, times, 0), times * (np.log10(count + 1.0) - norm)
        else:
            seen, weight = (pairs.of_words(keys, x) for x in pairs.weights(own, contexts.discount, told))
            probs = np.ones(len(keys))
            probs[numbered] = own.probs[others[numbered]]
            logs = times * _backed_off(contexts, met, seen, weight, probs)
            known = base = np.zeros(len(keys))
        start = 0
        for r in asked:
            where = unpack(r["at"])
            used, at = np.unique(where, return_inverse=True)
            stop = start + len(where)
            answers = (np.bincount(at, x[start:stop], len(used)) for x in (known, base, logs))
            yield {"chunk": r["chunk"], "at": pack(used)} | {c: x.tobytes() for c, x in zip(("known", "base", "logs"), answers, strict=True)}
            start = stop

    def answer(asked: pa.Table, stored: pa.Table) -> pa.Table:
        kinds = {**ANSWERS, "id": asked.schema.field("id").type}
        is_sum = pc.is_valid(asked["n_tokens"])
        parts = [_facts(kinds, b.num_rows, **{c: b.column(c) for c in list(kinds)[:8]}) for b in asked.filter(is_sum).to_batches()]
        wanted = asked.filter(pc.invert(is_sum)).select(["chunk", "role", "keys", "others", "at", "times"]).to_pylist()
        by_role = {r: [x for x in wanted if x["role"] == r] for r in (NUMBERED, AS_WORD, AS_CONTEXT)}
        held: dict[int, list] = {r: [] for r in range(4)}
        for role, *columns in _unpacked(stored.to_batches()):
            held[role].append(columns)
        answers: list[dict] = []
        if by_role[NUMBERED]:
            keys, _, counts = held[NUMBERED][0] if held[NUMBERED] else (np.empty(0, np.int64),) * 3
            answers += numbered_answers(by_role[NUMBERED], keys, counts)
        if by_role[AS_WORD] or by_role[AS_CONTEXT]:
            tables = {r: [np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*held[r], strict=True)] or [np.empty(0, np.int64)] * 3 for r in (AS_WORD, AS_CONTEXT, OWN)}
            order, _ = _distinct(*tables[OWN][:2])
            told = RarePairs(*(c[order] for c in tables[OWN]))
            for role in (AS_WORD, AS_CONTEXT):
                if by_role[role]:
                    answers += rare_answers(role, by_role[role], RarePairs(*tables[role]), told)
        if answers:
            parts.append(_facts(kinds, len(answers), **{c: [a.get(c) for a in answers] for c in ("chunk", "at", "known", "base", "logs")}))
        return pa.Table.from_batches(parts, pa.schema(kinds))

    def total(table: pa.Table) -> pa.Table:
        """What tasks knew of the rows of one chunk and what the shards answered."""
        is_sum = pc.is_valid(table["n_tokens"])
        rows = table.filter(is_sum).sort_by("place")
        answers, n = table.filter(pc.invert(is_sum)).select(["at", "known", "base", "logs"]).to_pylist(), rows.num_rows

        def added(column: str, answer: str) -> np.ndarray:
            some = [a for a in answers if a[answer] is not None]
            where = _joined(unpack, [a["at"] for a in some])
            return rows[column].to_numpy() + np.bincount(where, np.frombuffer(b"".join(a[answer] for a in some)), n)

        sums = [added("n_known", "known").astype(np.int64), added("base_score", "base"), added("score", "logs")]
        names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.Table.from_arrays([*(rows[c] for c in names[:3]), *(pa.chunked_array([x]) for x in sums)], names)

    id_kind = df.schema[id_col].dataType.simpleString()
    told = texts.mapInArrow(facts, _columns(FACTS, id_kind))
    stored = bigrams.select("shard", "role", "keys", "others", "counts").unionByName(_own_counts(bigrams, shared))
    answers = told.groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(answer, _columns(ANSWERS, id_kind))
    scored = {c: ANSWERS[c] for c in ("id", "held_out", "n_tokens", "n_known", "base_score", "score")}
    scored = answers.groupBy("chunk").applyInArrow(total, _columns(scored, id_kind))
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
