"""Repair of conversation structure by the cheapest edits of their rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tributary.llm.common import small_batches
from tributary.session import durable

DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: Bits of the number of rows in a block of a conversation, and nodes that are ranked at once.
BLOCK_BITS, NODES = 12, 1 << 16
FAR = 1 << 40

# What was read so far: nothing, a system row, up to a user row, up to an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the next user or assistant row, and that row's role.
TURN = np.array([USER, USER, ASSISTANT, USER])
ROLES = ["user", "user", "assistant", "user"]
#: Cost of ending in a state: inserted rows that close the last exchange.
CLOSE = np.array([0, 2 * INSERT, INSERT, 0])
#: A row's kind: the initial of its role (x: any other), capital if its text is truncated; b and p are blank and repeated.
KINDS, DEAD = "suaxSUAX", "bp"
_STEP = {"s": [SYSTEM, -1, -1, -1], "u": [USER, USER, -1, USER], "a": [-1, -1, ASSISTANT, -1], "x": [-1] * 4}
#: By kind (the last stands for no row) and state: costs and next states of keeping and of renaming, cost of deleting.
_NEXT = np.array([_STEP[k.lower()] for k in KINDS] + [[-1] * 4])
_LATE = np.array([TRUNCATED * k.isupper() for k in KINDS] + [0])
_KEEP = np.where(_NEXT >= 0, _LATE[:, None], FAR)
_RENAME = np.where(np.arange(9) < 8, _LATE + RENAME, FAR)
_DELETE = np.where(np.arange(9) < 8, DELETE, 0)
#: Edits in ASCII order; nothing comes before all of them.
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)


def _rows(kinds: list[str]) -> np.ndarray:
    """Kinds as numbers, one line per block, blanks and repeats left out, filled with 'no row' in front."""
    live = [k.translate({ord(c): None for c in DEAD}).encode() for k in kinds]
    out = np.full((len(kinds), max(map(len, live), default=0)), 8)
    number = np.zeros(128, int)
    number[np.frombuffer(KINDS.encode(), np.uint8)] = np.arange(8)
    for i, k in enumerate(live):
        if k:
            out[i, -len(k) :] = number[np.frombuffer(k, np.uint8)]
    return out


def _before(kind: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least costs to go before a row, with rows inserted there, from those after it; states are the second axis."""
    at = (slice(None), slice(None)) + (None,) * (after.ndim - 2)
    row = np.arange(len(kind))[:, None]
    h = np.minimum(after + _DELETE[kind][:, None][at], after[row, np.maximum(_NEXT[kind], 0)] + _KEEP[kind][at])
    h = np.minimum(h, after[:, TURN] + _RENAME[kind][:, None][at])
    out = np.minimum(h, h[:, TURN] + INSERT)
    # Before the first exchange both of its rows may be inserted.
    out[:, :2] = np.minimum(out[:, :2], out[:, USER : USER + 1] + INSERT)
    return np.minimum(out, FAR)


def transfers(kinds: list[str]) -> np.ndarray:
    """Per block the least cost from each state before it (second axis) to each state after it."""
    rows = _rows(kinds)
    costs = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(kinds), 4, 4)).copy()
    for i in reversed(range(rows.shape[1])):
        there = rows[:, i] < 8
        costs[there] = _before(rows[there, i], costs[there])
    return costs


def least_paths(kinds: list[str], exits: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Per block and state before it the ASCII-least cheapest edits, and the state after them.

    ``exits`` are the least costs to go after each block. A node is a place
    between rows with a state; arcs that keep to the least cost are optimal.
    Nodes are ranked by their least next edit, then by their least next two,
    four, eight: the rank of twice as many is that of the pair (own rank, rank
    of the node that the doubled pointer leads to). The final ranks select each
    node's arc, by its letter and then the rank of its end, and the doubled
    pointers of these arcs lay out all places of a path at once. Edits that
    spell the same lead to the same place and state, so a node has one optimal
    arc per letter, and what follows the block never decides between two.
    """
    rows = _rows(kinds)
    blocks, length = rows.shape
    costs = np.empty((blocks, length + 1, 4), int)
    costs[:, length] = exits
    for i in reversed(range(length)):
        there = rows[:, i] < 8
        costs[:, i] = costs[:, i + 1]
        costs[there, i] = _before(rows[there, i], costs[there, i + 1])
    here, after = costs[:, :-1], costs[:, 1:]
    live = (rows < 8)[..., None]
    place = np.arange(blocks * (length + 1) * 4).reshape(blocks, length + 1, 4)
    keep = np.maximum(_NEXT[rows], 0)
    turned = np.broadcast_to(TURN, here.shape)
    ends = place[:, 1:]
    arcs = [  # in the order of LETTERS: optimal or not, and where it leads
        (live & (here == after + DELETE), ends),
        (live & (here == here[:, :, TURN] + INSERT), place[:, :-1][:, :, TURN]),
        (live & (here == np.take_along_axis(after, keep, 2) + _KEEP[rows]), np.take_along_axis(ends, keep, 2)),
        (live & (here == np.take_along_axis(after, turned, 2) + _RENAME[rows][..., None]), np.take_along_axis(ends, turned, 2)),
    ]
    good = np.stack([a for a, _ in arcs])
    goal = np.stack([b for _, b in arcs])
    # Ranks by successive powers of two; ends of blocks and places without a row come first and lead to themselves or on.
    letter = np.zeros(place.shape, int)
    letter[:, :-1] = np.where(live, good.argmax(axis=0) + 1, 0)
    pointer = place.copy()
    pointer[:, :-1] = np.where(live, np.take_along_axis(goal, good.argmax(axis=0)[None], 0)[0], place[:, :-1])
    rank, ahead, span = letter.ravel(), pointer.ravel(), 1
    while span < 3 * length + 1:
        rank = np.unique(rank * (rank.size + 1) + rank[ahead], return_inverse=True)[1].ravel()
        ahead, span = ahead[ahead], 2 * span
    order = np.where(good, (np.arange(4) + 1)[:, None, None, None] * (rank.size + 1) + rank[goal], np.iinfo(int).max)
    chosen = order.argmin(axis=0)
    letter[:, :-1] = np.where(live, chosen + 1, 0)
    pointer[:, :-1] = np.where(live, np.take_along_axis(goal, chosen[None], 0)[0], place[:, :-1])
    doubled = [pointer.ravel()]
    while 1 << len(doubled) < span:
        doubled.append(doubled[-1][doubled[-1]])
    first = (rows == 8).sum(axis=1)
    path = place[np.arange(blocks), first].reshape(-1, 1)
    for jump in reversed(doubled):
        path = np.stack([path, jump[path]], axis=2).reshape(len(path), -1)
    spelt = LETTERS[letter.ravel()[path]]
    audits = [line.tobytes().rstrip(b"\0").decode() for line in spelt]
    return [audits[4 * i : 4 * i + 4] for i in range(blocks)], (doubled[0][path[:, -1]] % 4).reshape(blocks, 4)


def _alike(kinds: list[str]) -> Iterator[list[int]]:
    """Positions of blocks of about the same length, with a bounded number of nodes at once."""
    order = sorted(range(len(kinds)), key=lambda i: len(kinds[i]))
    group: list[int] = []
    for i in order:
        if group and (4 * (len(group) + 1) * (len(kinds[i]) + 1) > NODES or len(kinds[i]) > 2 * len(kinds[group[0]]) + 8):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _add_transfers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = batch.column("kinds").to_pylist()
        out = np.empty((len(kinds), 16), int)
        for group in _alike(kinds):
            out[group] = transfers([kinds[i] for i in group]).reshape(-1, 16)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "costs"])


def _add_exits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come last first within their conversation; the costs to go are carried from one to the one before."""
    conv, to_go = object(), CLOSE
    for batch in batches:
        exits = []
        for its_conv, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist(), strict=True):
            if its_conv != conv:
                conv, to_go = its_conv, CLOSE
            exits.append(to_go.tolist())
            to_go = (np.array(costs).reshape(4, 4) + to_go).min(axis=1)
        kept = [n for n in batch.schema.names if n != "costs"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(exits, pa.list_(pa.int64()))], [*kept, "exits"])


def _add_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, exits = batch.column("kinds").to_pylist(), np.array(batch.column("exits").to_pylist())
        audits: list[list[str]] = [[]] * len(kinds)
        states = np.empty((len(kinds), 4), int)
        for group in _alike(kinds):
            found, states[group] = least_paths([kinds[i] for i in group], exits[group])
            for i, f in zip(group, found, strict=True):
                audits[i] = f
        kept = [n for n in batch.schema.names if n != "exits"]
        more = [pa.array(audits, pa.list_(pa.string())), pa.array(states.tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *more], [*kept, "audits", "states"])


class _Repair:
    """One conversation as its rows go by."""

    def __init__(self, conv: object) -> None:
        self.conv, self.state, self.entry = conv, START, START
        self.audit: list[str] = []
        self.sha, self.lines = hashlib.sha256(), 0
        self.turns: list[int] = []  # first and last
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before: str | None = None
        self.run: tuple | None = None
        self.kind, self.kinds, self.letters = "", iter(()), iter(())

    def block(self, kinds: str, audits: list[str], states: list[int]) -> None:
        """The next rows' kinds, and the edits for the state that the rows before lead to."""
        self.kinds, self.letters = iter(kinds), iter(audits[self.entry])
        self.entry = states[self.entry]

    def row(self, turn: int | None, role: str, text: str, key: tuple, times: int) -> None:
        again = key == self.run
        if not again:
            self.run, self.kind = key, next(self.kinds)
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.distinct += 1
        legal = self.before is not None and self.before + role[:1] in {"su", "ua", "au"}
        self.illegal += (self.before is not None and not legal) + times - 1
        self.before = role[:1]
        gone = times
        if self.kind not in DEAD and not again:
            self.truncated += self.kind.isupper()
            self.edit(role, text)
            gone -= 1
        if gone:
            if self.kind == "b":
                self.blank += gone
            else:
                self.duplicate += gone
            self.cost += DELETE * gone
            self.audit.append("D" * gone)

    def edit(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self.insert()
                continue
            self.audit.append(letter)
            if letter == "D":
                self.cost += DELETE
                return
            self.cost += TRUNCATED * self.kind.isupper()
            if letter == "R":
                self.cost += RENAME
                role = ROLES[self.state]
                self.state = int(TURN[self.state])
            else:
                self.state = _STEP[self.kind.lower()][self.state]
            self.line(role, text)
            return

    def insert(self) -> None:
        self.audit.append("I")
        self.cost += INSERT
        self.line(ROLES[self.state], "")
        self.state = int(TURN[self.state])

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def end(self) -> tuple:
        while self.state in {SYSTEM, USER}:
            self.insert()
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost)
        return (self.conv, *counts, "".join(self.audit), self.sha.hexdigest())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(conv_type: pa.DataType):  # noqa: ANN202
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        for batch in batches:
            done = []
            for conv, turn, role, digest, text, times, kinds, audits, states in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.end())
                    now = _Repair(conv)
                if kinds is not None:
                    now.block(kinds, audits, states)
                elif times:
                    now.row(turn, role, text, (turn, role, digest), times)
            yield out(done)
        yield out([now.end()] if now else [])

    return run


def repair(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """``conv_id``, faults, ``cost, audit, repaired_sha256`` of every conversation.

    Rows go by turn, null first, then by role and by the SHA-256 of their text.
    ``times`` repeats a row in place; rows repeated zero times only make their
    conversation known, and one without other rows gets zeros, an empty audit
    and the digest of nothing. Null role or text is one space; null ids are one
    conversation. A row's first fault counts: blank, duplicate (same role and
    text earlier), truncated. Rows are kept, deleted, renamed to user or
    assistant, or inserted so that role initials read ``(s?(ua)+)?`` at the
    least cost, ties to the ASCII-least edits. An empty role can't be kept.
    Other columns are not read; no rows give no rows.

    Conversations are cut in blocks of at most 2^``BLOCK_BITS`` rows, however
    long they are. A block gives its least costs from state to state; these
    are carried back over the blocks of a conversation, then each block ranks
    its own optimal paths (``least_paths``), and the paths are joined from the
    front. Only that last pass reads the texts of a conversation in one task,
    row by row: the digest of the repaired text can't be split.
    """
    spark = df.sparkSession
    small_batches(spark)
    space = F.lit(" ")
    its = F.coalesce(df[text].cast("string"), space)
    rows = df.select(
        df[conv].alias("conv_id"), df[turn].cast("long").alias("turn"), F.coalesce(df[role].cast("string"), space).alias("role"),
        F.sha2(its, 256).alias("digest"), its.alias("text"), (F.lit(1) if times is None else times).cast("long").alias("times"),
    )
    shown = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    kind = F.when(F.right(shown, F.lit(1)).isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    kinds = rows.where("times > 0").withColumn("kind", F.when(shown == "", F.lit("b")).otherwise(kind))
    order = ["conv_id", "turn", "role", "digest"]
    # Equal rows are one run from here on; texts stay behind. The copies of a run are repeats whatever they hold.
    runs = kinds.groupBy(*order).agg(F.first("kind").alias("kind"))
    placed = runs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    placed = durable(placed, "conversation-rows")
    first = placed.where("kind <> 'b'").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    marked = placed.join(first, "pos", "left").withColumn("kind", F.when(F.col("kind").isin("b") | F.col("first"), F.col("kind")).otherwise("p"))
    line = F.sort_array(F.collect_list(F.struct("pos", "kind")))
    blocks = marked.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
        F.min(F.struct("pos", "turn", "role", "digest")).alias("head"), F.array_join(F.transform(line, lambda x: x["kind"]), "").alias("kinds")
    )
    conv_type = df.schema[conv].dataType
    key = f"conv_id {conv_type.simpleString()}, block long, turn long, role string, digest string, kinds string"
    blocks = blocks.select("conv_id", "block", "head.turn", "head.role", "head.digest", "kinds")
    blocks = blocks.mapInArrow(_add_transfers, f"{key}, costs array<long>")
    blocks = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_add_exits, f"{key}, exits array<long>")
    # Blocks of one conversation go apart again.
    blocks = blocks.repartition("conv_id", "block").mapInArrow(_add_paths, f"{key}, audits array<string>, states array<long>")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("kinds", "string"), ("audits", "array<string>"), ("states", "array<long>"))]
    both = rows.select(*order, "text", "times", *none).unionByName(
        blocks.select(*order, F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("times"), "kinds", "audits", "states")
    )
    dealt = both.repartition("conv_id").sortWithinPartitions(*order, F.col("kinds").isNull())
    schema = StructType([StructField("conv_id", conv_type), *[StructField(n, LongType()) for n in COUNTS], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    arrow_type = spark.createDataFrame([], StructType([schema[0]])).toArrow().schema.field(0).type
    return dealt.mapInArrow(_stream(arrow_type), schema)


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times``: rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20, nulls one space.

    0 drops a row (``times`` 0), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return df.select(
        "conv_id", "turn",
        F.when(fate == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("times"),
    )
