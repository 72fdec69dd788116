"""Byte-level BPE: longest matches from an Aho-Corasick automaton, corrected by backtracking."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tributary.llm.common import small_batches

#: Pieces whose ids a task remembers in each of two generations, and the longest one in characters; both bound memory only.
MEMO_PIECES, MEMO_BYTES = 200_000, 64
#: Adjacent token pairs whose compatibility a task remembers.
MEMO_PAIRS = 400_000
PAIR_SHIFT = 32

#: Ids of a piece of text, their number, their decimal form, and the bytes they decode to.
Piece = tuple[tuple[int, ...], int, bytes, bytes]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of base64 tokens and numbers."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class BytePairCoder:
    """Encodes and decodes as merging by rank does, without merging.

    The last merge inside a token, its halves, is found once per token. Two
    tokens can stand next to each other if no merge across their border comes
    before the merges that made them. The text's ids are the one sequence of
    tokens whose neighbours are all compatible; it is found by taking the
    longest token at each place and stepping back to shorter ones, never trying
    a place twice.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.made: set[int] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.made.add(rank)
                continue
            parts = self._merged(token, rank)
            if len(parts) == 2:
                self.made.add(rank)
                self.halves[rank] = pair = (ranks[parts[0]], ranks[parts[1]])
                self.merges[pair] = rank
        # Bytes are Latin-1 characters to the automaton. Tokens that no merges make only match whole pieces.
        self.by_text = {self.tokens[r].decode("latin-1"): r for r in self.made}
        self.lengths = {r: len(t) for r, t in self.tokens.items()}
        self.most = max(map(len, self.by_text), default=1)
        self.automaton = ahocorasick.Automaton()
        for text, rank in self.by_text.items():
            self.automaton.add_word(text, rank)
        # Each beginning of a token, with the longest token that it begins with.
        self.longest: dict[str, int | None] = {}
        for text in self.by_text:
            for n in range(1, len(text) + 1):
                if text[:n] not in self.longest:
                    self.longest[text[:n]] = self.by_text.get(text[:n], self.longest.get(text[: n - 1]))
        self.decimals = {r: b"%d" % r for r in self.tokens}
        self.shorter = {r: self._prefix(self.tokens[r]) for r in self.made}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, Piece] = {}
        self.older: dict[str, Piece] = {}

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """Parts of a token after all merges of ranks under ``below``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix."""
        for n in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:n])) is not None and rank in self.made:
                return rank
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` as neighbours; remembered."""
        key = left << PAIR_SHIFT | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges from the newest on; at each state a merge across the
        # border that is older than the one just undone would have come first.
        undone = None
        while True:
            across = self.merges.get((left, right))
            if across is not None and (undone is None or across < undone):
                return False
            # Of equal ranks the left merge comes first, so the right one is undone first.
            if right >= left and right in self.halves:
                # A merge of the same rank across the border would have been further left, so earlier.
                undone, right = right + 1, self.halves[right][0]
            elif left in self.halves and (left > right or right not in self.halves):
                undone, left = left, self.halves[left][1]
            elif right in self.halves:
                undone, right = right + 1, self.halves[right][0]
            else:
                return True

    def _encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        text, size, pairs, lengths, shorter = piece.decode("latin-1"), len(piece), self.pairs, self.lengths, self.shorter
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, last, token = 0, None, self._longest(text, 0)
        while at < size:
            while token is not None:
                end = at + lengths[token]
                if open_at[end]:
                    if last is None:
                        break
                    fits = pairs.get(last << PAIR_SHIFT | token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at, last = end, token
                token = self._longest(text, at) if at < size else None
                continue
            if last is None:
                raise ValueError("the ranks lack a byte of this text")
            open_at[at] = 0
            token = out.pop()
            at -= lengths[token]
            last = out[-1] if out else None
        return tuple(out)

    def _longest(self, text: str, at: int) -> int | None:
        """The longest token that the text goes on with at a place."""
        ahead = text[at : at + self.most]
        return self.longest.get(ahead[: self.automaton.longest_prefix(ahead)])

    def encode_piece(self, piece: str) -> Piece:
        """What one match of the splitting pattern becomes; short ones are remembered, those met again the longest."""
        done = self.older.get(piece)
        if done is None:
            ids = self._encode(piece.encode())
            done = (ids, len(ids), b",".join(map(self.decimals.__getitem__, ids)), self.decode(ids))
        if len(piece) <= MEMO_BYTES:
            if len(self.pieces) >= MEMO_PIECES:
                self.older = self.pieces.copy()
                self.pieces.clear()
            self.pieces[piece] = done
        return done

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_coders: dict[str, BytePairCoder] = {}


def _coder(name: str, ranks: dict[bytes, int]) -> BytePairCoder:
    """One coder per task process and vocabulary."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = BytePairCoder(ranks)
    return _coders[name]


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", *, keep_ids: bool = True) -> DataFrame:
    """``df`` with ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``token_ids``.

    Every match of ``pattern`` is encoded by itself, as merging the ranks of
    ``ranks_path`` does; then the ids are decoded. Digests are of the decimal
    ids joined by commas and of the decoded bytes. A null text is empty: no
    tokens, digests of nothing. The vocabulary (a file of fixed size) goes to the
    tasks in their closure. Columns of these names in ``df`` are replaced.
    """
    small_batches(df.sparkSession)
    ranks = read_ranks(ranks_path)
    name = hashlib.sha256(Path(ranks_path).read_bytes()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in df.columns if c not in {"n_tokens", "ids_sha256", "decoded_sha256", "token_ids"}]
    # A text that is kept is not sent twice.
    texts_at = kept.index(text_col) if text_col in kept else len(kept)
    sent = [*kept, *[text_col] * (text_col not in kept)]
    rows = df.select(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(sent)])
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    kinds += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, find = _coder(name, shared.value), regex.compile(pattern).findall
        for batch in batches:
            own, texts = batch.columns[: len(kept)], batch.column(texts_at)
            for start in range(0, batch.num_rows, 256):
                part = texts.slice(start, 256)
                done = [_row(coder, find(x.as_py() or ""), keep_ids) for x in part]
                columns = [pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))[: 3 + keep_ids])]
                names = [*batch.schema.names[: len(kept)], "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * keep_ids]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, 256) for c in own), *columns], names)

    coded = rows.mapInArrow(run, kinds)
    return coded.withColumnsRenamed({f"c{i}": c for i, c in enumerate(kept)})


def _row(coder: BytePairCoder, pieces: list[str], keep_ids: bool) -> tuple:
    """Token count, digests and ids of one text."""
    count, text, back, all_ids, known, code = 0, hashlib.sha256(), hashlib.sha256(), [], coder.pieces, coder.encode_piece
    for start in range(0, len(pieces), 8192):
        coded = [known.get(p) or code(p) for p in pieces[start : start + 8192]]
        count += sum([c[1] for c in coded])
        text.update(b"," * bool(start) + b",".join([c[2] for c in coded]))
        back.update(b"".join([c[3] for c in coded]))
        if keep_ids:
            all_ids += [i for c in coded for i in c[0]]
    return (count, text.hexdigest(), back.hexdigest(), *[all_ids] * keep_ids)
