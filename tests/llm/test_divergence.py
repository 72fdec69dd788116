"""Source divergence against a dictionary version."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tributary.llm import divergence
from tributary.llm.divergence import _Path, audit, text_terms


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_audit(rows, least, top):
    occ, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms(text)
        sources[lang].add(source)
        occ[lang, source].update(found)
        occ[lang,].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in sources:
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {k: sum(c[t] for t in kept) for k, c in occ.items()}

        def p(*key, kept=kept, total=total):
            return {t: 1 + 10**9 * (occ[key][t] + 5) // (total[key] + 5 * len(kept)) for t in kept}

        for s in sources[lang]:
            own, whole = p(lang, s), p(lang)
            pairs = [(o, sum(abs(own[t] - v) for t, v in p(lang, o).items())) for o in sources[lang] - {s}]
            more = [(t, own[t] - whole[t]) for t in kept if occ[lang, s][t] and own[t] > whole[t]]
            for part, items, limit in (("pair", pairs, None), ("term", more, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(items[:limit])]
    return sorted(out)


def test_terms_of_bytes():
    for text in ["", "Ab-cD eÉ\xa0x 12 Ω_y\x7fz\x80w", "[a] {b} `c`", "x" * 100]:
        assert [t.decode() for part in text_terms(text.encode()) for t in part] == terms(text)
    long = " ".join(f"w{chr(97 + i % 7)}" for i in range(900_000))
    parts = list(text_terms(long.encode()))
    assert len(parts) > 1 and [t.decode() for part in parts for t in part] == terms(long)


def test_tree_equals_all_pairs_of_rows():
    rng = random.Random(4)
    items = [{"source": s, "occ": c, "p": 10 * c + 7, "p0": ord(s)} for s in "abcde" for c in (1, 2)]
    rows = [([i for i in items if i["occ"] == rng.choice((1, 2, 3))], rng.randint(1, 9)) for _ in range(300)]
    rows = [([i for n, i in enumerate(r) if all(j["source"] != i["source"] for j in r[:n])], t) for r, t in rows]
    rows = sorted((r for r in rows if r[0]), key=lambda r: [tuple(i.values()) for i in r[0]])
    tree, slow = _Path(Counter()), Counter()
    for row, times in rows:
        tree.add("x", row, times)
        for n, b in enumerate(row):
            for a in row[:n]:
                both = abs(a["p"] - b["p"]) - abs(a["p"] - b["p0"]) - abs(a["p0"] - b["p"]) + abs(a["p0"] - b["p0"])
                slow["x", a["source"], b["source"]] += times * both
    tree.leave()
    assert {k: v for k, v in tree.sums.items() if v} == {k: v for k, v in slow.items() if v}


@pytest.mark.parametrize("sizes", [{}, {"HELD": 20, "SHARD_BYTES": 5_000}])
def test_audit_equals_slow(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(9)
    vocabulary = ["apple", "Äpfel", "b", "straße", "Zed", "q", "über", "naïve", "x1y", "don't"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "S", None])) for _ in range(400)]
    # Ties, repeated rows, groups without terms, a language without kept terms, a very long text.
    rows += [("tie one", "en", "t1"), ("tie one", "en", "t2")] * 12 + [(None, "en", "none"), ("", "de", "none"), ("rare words", "xx", "a"), ("other", "xx", "b")]
    rows += [("apple b " * 50_000, "en", "long"), ("solo", "yy", "only")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, source string, term int, value string")
    got = sorted(map(tuple, audit(df, least_docs=10, top_terms=4).collect()))
    assert got == slow_audit(rows, 10, 4)
    assert any(r[2] == "pair" and r[4] == 0 for r in got)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert audit(df).count() == 0
    assert audit(spark.createDataFrame([(None, None, None)], df.schema)).count() == 0
