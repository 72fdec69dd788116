"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from tributary.llm import ngram_join
from tributary.llm.ngram_join import Grams, _pack, _pack_places, _unpack, _unpack_places, near_duplicates, overlap_bound, prefix_length, similar

SF_DIR = "/root/testdata/sf0.001"


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_join(rows, percent=80):
    """Per row the size of its set and the smallest id that it reaches."""
    sets = [slow_set(t) for _, t in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=len)
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            if 100 * len(x) < percent * len(y):
                break
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                parent[root(x)] = root(y)
    least = {}
    for (doc, _), s in zip(rows, sets, strict=True):
        if s and doc is not None:
            least[root(s)] = min(doc, least.get(root(s), doc))
    return sorted((repr(doc), len(s), repr(least.get(root(s)) if s else doc)) for (doc, _), s in zip(rows, sets, strict=True))


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß\xa0x"]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(120)]
    for base in texts[:12]:
        for _ in range(rng.randint(2, 25)):
            words = base.split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    texts += [f"{passage} {' '.join(rng.choices(vocabulary, k=rng.randint(1, 40)))}" for _ in range(40)]
    # Borders of the similarity: 8 of 10 and 7 of 9 shared n-grams.
    line = [f"b{i}" for i in range(14)]
    texts += [" ".join(line), " ".join(line[:-1] + ["x"]), " ".join(line[:-2] + ["x", "y"]), " ".join(line[:12]), " ".join(line[:11])]
    texts += [None, "", " \n", "one", "ONE", "one two", "a b c d", "a b c d e", "A B C D", "z " * 500, "z " * 30]
    return texts


@pytest.mark.parametrize("sizes", [{}, {"chunk_rows": 150, "shard_rows": 64, "partners": 1}])
def test_join_equals_all_pairs(spark, monkeypatch, sizes):
    if sizes:  # beyond the size that is sent to all tasks
        monkeypatch.setattr(ngram_join, "SENT_BYTES", 0)
    rng = random.Random(8)
    texts = corpus(rng)
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, "nobody else has this text at all"), (rows[0][0], "another text of the same id")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, cls string").repartition(7)
    got = sorted((repr(r.id), r.n, repr(r.component_id)) for r in near_duplicates(df, **sizes).collect())
    assert got == slow_join(rows)


@pytest.mark.parametrize("most_bytes", [0, 1 << 40])
def test_components_of_long_chains(spark, most_bytes):
    rng = random.Random(6)
    names = rng.sample(range(1_000, 10_000), 220)
    pairs = [(names[i], names[i + 1]) for i in range(99)] + [(names[i], names[rng.randint(100, i - 1)]) for i in range(101, 200)] + [(names[200], names[201])]
    links = spark.createDataFrame([(str(a).encode(), str(b).encode()) for a, b in pairs], "a binary, b binary")
    got = {r.node: r.root for r in ngram_join._components(links, most_bytes).collect()}
    assert len(got) == 202 and len(set(got.values())) == 3
    assert all(got[str(a).encode()] == got[str(b).encode()] for a, b in pairs)


def test_nothing_and_only_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(4, None)], df.schema)).collect()] == [(4, 0, None, 4)]


def test_query_equals_all_pairs(spark):
    from tributary.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in QUERIES["op12_ngram_jaccard_join"](spark, SF_DIR).collect())
    assert got == slow_join(rows)


def test_long_texts_are_cut_between_words():
    text = " ".join(str(i % 911) for i in range(500_000)).encode()
    grams = Grams(5)
    assert len(grams(text)) == 911
    assert len(grams(b"x" * 3_000_000)) == 1


def test_packing_round_trips():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 40, 1000).astype(np.uint64)
    places = np.sort(rng.integers(0, 1 << 16, 1000))
    assert (_unpack(_pack(values, 5), 5) == values).all() and (_unpack_places(_pack_places(places)) == places).all()


def test_filters_never_lose():
    rng = np.random.default_rng(3)
    for _ in range(500):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(2))
        both = len(np.intersect1d(x, y))
        assert all(overlap_bound(x, y, d) >= both for d in range(6))
        assert similar(x, y, both) and not similar(x, y, both + 1)
    for size in range(1, 300):
        # All but the prefix is less than what two similar sets share.
        assert size - prefix_length(size, 80) + 1 == -(-80 * size // 100)
