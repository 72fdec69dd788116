"""Nearest neighbours and near copies against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tributary.llm.ann import nearest
from tributary.llm.graph import components
from tributary.llm.simhash import BKTree, keep_one, near_copies, near_links, simhash64


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "A b\x0bC d e f", "x " * 500, "é\xa0ü y\x85z w"])
def test_fingerprint_equals_slow(text):
    assert simhash64(None if text is None else text.encode()) % 2**64 == slow_print(text)


def test_long_text_is_counted_in_chunks():
    text = " ".join(str(i % 977) for i in range(150_000))
    assert simhash64(text.encode()) % 2**64 == slow_print(text)


def test_tree_finds_all_within():
    rng = random.Random(3)
    values = list({rng.getrandbits(12) for _ in range(400)})
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert {values[i] for i in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


@pytest.mark.parametrize("tree_rows", [2_000, 7])
def test_links_join_what_pairs_join(spark, tree_rows):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for c in centres for _ in range(30)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), tree_rows=tree_rows).collect()
    assert all((a ^ b).bit_count() <= 3 for a, b in ((r.a % 2**64, r.b % 2**64) for r in links))
    place = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[root(place[r.a])] = root(place[r.b])
    mine, slow = [root(i) for i in range(len(values))], groups(values)
    assert len(set(mine)) == len(set(slow)) == len(set(zip(mine, slow, strict=True)))


def test_components_of_chains_and_none(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 90, 90: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [
    (5, "the same text in many words here", 1),
    (3, "the same text in many words here", 2),
    (3, "the same text in many words here", 3),
    (None, "the same text in many words here", 4),
    (8, "something else altogether with other words", 5),
    (9, None, 6),
    (10, "", 7),
    (None, "without an id and alone in this table", 8),
]


def test_near_copies_of_nulls_ties_and_repeats(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fp int")
    found = near_copies(df).collect()
    by = {(r.id, r.text_hash): (r.component_id, r.rows) for r in found}
    assert sum(r.rows for r in found) == len(ROWS)
    got = sorted((k[0] or -1, v[0] or -1, v[1]) for k, v in by.items())
    assert got == [(-1, -1, 1), (-1, 3, 1), (3, 3, 2), (5, 3, 1), (8, 8, 1), (9, 9, 1), (10, 9, 1)]
    assert near_copies(df.limit(0)).count() == 0


def test_keep_one_keeps_all_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fp int")
    kept = keep_one(df)
    assert kept.columns == df.columns
    rows = sorted((r.doc_id or -1) for r in kept.collect())
    assert rows == [-1, 3, 8, 9]


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]
    return x


def slow_nearest(ids, x, every, k):
    scores = x.astype(float) @ x.astype(float).T
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            out[q] = sorted((-scores[i, j], ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
    return out


@pytest.mark.parametrize("cell_rows", [4_096, 5])
def test_nearest_with_a_large_group_of_copies(spark, cell_rows):
    x = vectors(300)
    ids = [int(i) for i in np.random.default_rng(2).permutation(300)]
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, list int")
    found = nearest(df, every=10, k=5, cell_rows=cell_rows, list_rows=40).collect()
    slow = slow_nearest(ids, x, 10, 5)
    mine = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(mine) == set(slow)
    hits = sum(len({v for _, v in mine[q]} & {v for _, v in slow[q]}) for q in slow)
    assert hits >= 0.9 * 5 * len(slow)
    assert all([r[1] for r in mine[q]] == [r[1] for r in sorted(mine[q])] for q in mine)


def test_nearest_leaves_out_unusable(spark):
    rows = [(0, [1.0, 0.0]), (10, [0.5, 0.5]), (20, None), (30, [0.0, 0.0]), (40, [float("nan"), 1.0]), (50, [1.0]), (60, [None, 1.0]), (None, [1.0, 1.0]), (10, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, every=10, k=3).collect())
    assert found == [(0, 1, 10, 0.5), (10, 1, 0, 0.5)]
    assert nearest(df.limit(0)).count() == 0
