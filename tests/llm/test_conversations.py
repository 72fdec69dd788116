"""Conversation repair against a recursion over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import conversations
from tributary.llm.conversations import CLOSE, damage, least_paths, repair, transfers

SF_DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]"


def slow_repair(rows):
    """``rows`` of one conversation as (turn, role, text), in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        chars = re.findall(WORD, text)
        faults.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))

    def after(state, initial):
        return {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(initial, {}).get(state)

    @cache
    def best(i, state, inserted=0):
        found = [(0, "", ())] if i == len(rows) and state in {"", "a"} else []

        def add(cost, letter, line, to):
            c, s, lines = to
            found.append((cost + c, letter + s, ((line,) if line is not None else ()) + lines))

        if inserted < 3:
            for name in ("user", "assistant"):
                if after(state, name[0]):
                    add(5, "I", f"{name}:", best(i, after(state, name[0]), inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(2, "D", None, best(i + 1, state))
            if faults[i] not in {"blank", "duplicate"}:
                late = 5 * (faults[i] == "truncated")
                if role and after(state, role[0]):
                    add(late, "K", f"{role}:{text}", best(i + 1, after(state, role[0])))
                for name in ("user", "assistant"):
                    if after(state, name[0]):
                        add(1 + late, "R", f"{name}:{text}", best(i + 1, after(state, name[0])))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, "")
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in {"su", "ua", "au"} for a, b in zip(initials, initials[1:], strict=False))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def slow_damage(rows):
    """Conversations of (conv_id, turn, role, text) rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return {c: sorted(r, key=order) for c, r in out.items()}


def some_rows(rng, conv, length):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Uther", "a"]
    texts = ["Yes.", "Yes.", "no", "", " \n", None, "Oh!", "And\x85", "é?", "wait. ..."]
    return [(conv, rng.choice([t, t, t, rng.randint(0, length), None]), rng.choice(roles[: rng.choice((2, 5, 10))]), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random()}.") for t in range(length)]


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_equals_slow(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = [r for c in range(150) for r in some_rows(rng, c, rng.randint(1, 14))]
    rows += some_rows(rng, None, 9) + some_rows(rng, -5, 150)
    rows += [(900, 3, "user", "same."), (900, 3, "user", "same.")] * 3 + [(901, None, None, None)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair(damage(df), times=F.col("times")).collect()}
    assert got == {c: slow_repair(tuple(r)) for c, r in slow_damage(rows).items()}


def test_conversations_without_rows_and_with_text_ids(spark):
    schema = "conv_id string, turn int, role string, text string, times int"
    rows = [("gone", 1, "user", "Hi.", 0), ("é", 1, "user", "Hi.", 1), ("é", 2, "assistant", "x" * 300_000 + ".", 1)]
    got = {r.conv_id: r for r in repair(spark.createDataFrame(rows, schema), times=F.col("times")).collect()}
    assert tuple(got["gone"])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got["é"].audit, got["é"].cost) == ("KK", 0)
    assert repair(spark.createDataFrame([], schema)).count() == 0


def test_every_row_alike(spark):
    df = spark.range(3_000).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    row = repair(df).first()
    # Deleting the first row too is cheaper than answering it.
    assert (row.duplicate, row.illegal, row.audit) == (2_999, 2_999, "D" * 3_000)


def test_blocks_join_to_the_whole():
    rng = random.Random(1)
    whole = "".join(rng.choice("suaxSUAXbp") for _ in range(400))
    (audit,), _ = (p[:1] for p in least_paths([whole], CLOSE[None]))
    cuts = [0, 1, 60, 61, 200, 400]
    parts = [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    exits = [CLOSE]
    for m in transfers(parts)[::-1]:
        exits.append((m + exits[-1]).min(axis=1))
    found, states = least_paths(parts, np.array(exits[:-1][::-1]))
    for entry in range(4):
        at, joined = entry, ""
        for strings, ends in zip(found, states, strict=True):
            joined, at = joined + strings[at], ends[at]
        assert joined == audit[entry]


def test_query_equals_slow(spark):
    from tributary.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, SF_DIR).collect()}
    assert got == {c: slow_repair(tuple(r)) for c, r in slow_damage(rows).items()}
