"""Token counts of byte-level BPE by finite-state transducers.

Two deterministic machines run over a text.  The first is the split into
pieces (``pretokens``), whose chunk maps compose by a prefix scan.  The second
reads the bytes of a piece; each transition carries the change of the number
of tokens of the prefix read so far, so the sum over a piece is its count.
The second always begins a piece in its start state, so pieces are its chunks
and all pieces of a block are stepped together, byte by byte.

The second machine rests on a property of BPE: the last token of a prefix is
the one token ending there that stays next to the last token of the rest when
the two are encoded together.  So its state is a node of the automaton over
all tokens plus, for each place that a coming token could begin at, the last
token and the count there.  Such states are finite in number, but noisy text
reaches millions; so they are not named one by one: the automaton's node is
the compiled part, and the other two stand in registers by place.  Equal
pieces of a block are stepped once.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm import flat, pretokens
from attrix.llm.shared import pick, ship_code

LIMIT = 512
#: Bytes of a piece that is stepped on its own.
LONG_PIECE = 256


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible bytes stand for themselves, the others follow from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_alphabet()
        ids = spec["model"]["vocab"]
        if any(t.get(kind) for t in spec["added_tokens"] for kind in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip blanks or match whole words aren't known")
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        added = {t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items() if i not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes = {t[0]: i for i, t in self.tokens.items() if len(t) == 1}
        self.halves = {new: pair for pair, (_, new) in self.merges.items()}

    def encode(self, piece: bytes) -> list[int]:
        """Plain BPE of a short string."""
        ids = [self.bytes[b] for b in piece]
        while len(ids) > 1:
            ranked = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not ranked:
                break
            i = min(ranked)[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def _edge(self, token: int, side: int) -> list[int]:
        """The token and, from merge to merge, its parts on one side (0 left, 1 right)."""
        out = [token]
        while token in self.halves:
            token = self.halves[token][side]
            out.append(token)
        return out

    def stay(self, a: int, b: int) -> bool:
        """Whether tokens a and b are still a, b when encoded together."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        if not any((x, y) in self.merges for x in left for y in right):
            return True  # nothing can merge across
        return self.encode(self.tokens[a] + self.tokens[b]) == [a, b]


class PairTable:
    """Open-addressing set of token pairs with a flag: whether they stay two tokens side by side."""

    SLOTS = 1 << 21

    def __init__(self, decide):
        self.decide = decide
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(self.SLOTS, dtype=np.uint64)  # 0: free
        self.flags = np.zeros(self.SLOTS, dtype=bool)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (flat.mix(keys) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, flag) of each key."""
        slot = self._slot(keys)
        there = self.keys[slot]
        flag = self.flags[slot]
        known = there == keys
        seek = np.flatnonzero(~known & (there != 0))
        while len(seek):
            slot[seek] = (slot[seek] + 1) % self.SLOTS
            there = self.keys[slot[seek]]
            hit = there == keys[seek]
            known[seek[hit]], flag[seek[hit]] = True, self.flags[slot[seek[hit]]]
            seek = seek[~hit & (there != 0)]
        return known, flag

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = ((a.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | b.astype(np.uint64)
        known, flag = self._find(keys)
        if known.all():
            return flag
        new = np.unique(keys[~known])
        if (self.used + len(new)) * 2 >= self.SLOTS and self.used:
            self._empty()
        for key, at in zip(new.tolist(), self._slot(new).tolist()):
            while self.keys[at]:
                at = (at + 1) % self.SLOTS
            self.keys[at], self.flags[at] = key, self.decide((key >> 32) - 1, key & 0xFFFFFFFF)
        self.used += len(new)
        return self.look_up(a, b)


class CountMachine:
    """The counting transducer: a complete automaton over all tokens, and registers by place."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.pairs = PairTable(v.stay)
        self.size = np.zeros(max(v.tokens) + 1, dtype=np.int64)
        go: list[dict[int, int]] = [{}]
        own: dict[int, int] = {}
        for i, t in v.tokens.items():
            self.size[i] = len(t)
            at = 0
            for b in t:
                if b not in go[at]:
                    go[at][b] = len(go)
                    go.append({})
                at = go[at][b]
            if v.encode(t) == [i]:  # else no text ever gives this token
                own[at] = i
        self.length = self.size.tolist()
        self.next = np.zeros((len(go), 256), dtype=np.int32)
        fail = [0] * len(go)
        ends: list[tuple[int, ...]] = [()] * len(go)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            f = fail[at]
            if at:
                self.next[at] = self.next[f]
                ends[at] = ((own[at],) if at in own else ()) + ends[f]
            for b, to in go[at].items():
                fail[to] = int(self.next[f, b]) if at else 0
                queue.append(to)
            for b, to in go[at].items():
                self.next[at, b] = to
        self.next = self.next.reshape(-1)
        #: Tokens that end at a node, longest first, then -1.
        self.ends = np.full((max(map(len, ends)) + 1, len(go)), -1, dtype=np.int32)
        for node, tokens in enumerate(ends):
            self.ends[: len(tokens), node] = tokens

    def count_one(self, piece: bytes) -> int:
        """Tokens of one piece, byte by byte: for the few that are much longer than the rest."""
        node, last, total, known = 0, [], [], {}
        for j, b in enumerate(piece):
            node = int(self.next[node * 256 + b])
            for t in self.ends[:, node].tolist():
                before = j - self.length[t]
                if before < 0:
                    stays = True
                else:
                    pair = last[before], t
                    stays = known.get(pair)
                    if stays is None:
                        stays = known[pair] = self.v.stay(*pair)
                if stays:
                    break
            last.append(t)
            total.append(1 + (total[before] if before >= 0 else 0))
        return total[-1]

    def counts(self, body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece; all pieces but the longest advance together by a byte."""
        if len(lengths) and lengths.max() > LONG_PIECE:
            out = np.empty(len(lengths), dtype=np.int64)
            few = lengths > LONG_PIECE
            out[~few] = self.counts(body, starts[~few], lengths[~few])
            out[few] = [self.count_one(body[a : a + n].tobytes()) for a, n in zip(starts[few].tolist(), lengths[few].tolist())]
            return out
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        begin = np.cumsum(size) - size  # registers of a piece
        source = starts[order]
        width = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        last = np.zeros(int(size.sum()), dtype=np.int32)
        total = np.zeros(len(last), dtype=np.int32)
        node = np.zeros(len(size), dtype=np.int64)
        for j, k in enumerate(width.tolist()):
            node[:k] = self.next[node[:k] * 256 + body[source[:k] + j]]
            rows = np.arange(k)
            for tokens in self.ends:
                t = tokens[node[rows]]
                before = j - self.size[t]  # place of the token before; -1: none
                ok = before < 0
                inner = np.flatnonzero(~ok)
                place = begin[rows[inner]] + before[inner]
                ok[inner] = self.pairs.look_up(last[place], t[inner])
                good = rows[ok]
                at = begin[good] + j
                last[at] = t[ok]
                back = before[ok]
                total[at] = 1 + np.where(back < 0, 0, total[at - j + np.maximum(back, 0)])
                rows = rows[~ok]
                if not len(rows):
                    break
        out = np.empty(len(size), dtype=np.int64)
        out[order] = total[begin + size - 1]
        return out


@functools.cache
def machine(path: str) -> CountMachine:
    return CountMachine(Vocabulary(path))


def split_added(body: np.ndarray, off: np.ndarray, added: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut at added tokens: bytes and offsets of the parts, each part's text, added tokens by text."""
    n = len(off) - 1
    extra = np.zeros(n, dtype=np.int64)
    owner = np.arange(n)
    raw = body.tobytes()
    if not any(a in raw for a in added):
        return body, off, owner, extra
    parts, owners = [], []
    import re

    pattern = re.compile(b"|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)))
    for i in range(n):
        pieces = pattern.split(raw[off[i] : off[i + 1]])
        extra[i] = len(pieces) - 1
        parts += pieces
        owners += [i] * len(pieces)
    cuts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return np.frombuffer(b"".join(parts), dtype=np.uint8), cuts, np.array(owners), extra


def text_counts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text."""
    m = machine(path)
    body, off = flat.flat(column)
    n = len(off) - 1
    size = np.diff(off)
    body, cuts, owner, tokens = split_added(body, off, m.v.added)
    starts = pretokens.piece_starts(body, cuts, "tokenizers")
    found, same = flat.distinct(flat.pieces(body, starts))
    piece_body, piece_off = flat.flat(found)
    per = m.counts(piece_body, piece_off[:-1], np.diff(piece_off))[same]
    text = owner[np.searchsorted(cuts, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
    return size, tokens + np.bincount(text, weights=per, minlength=n).astype(np.int64)


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for the file at ``path``
    without begin, end or template tokens; an added token's string inside a
    text is one token, as is its default.  A null text counts as empty: no
    bytes, no tokens.  Ids are passed through (null, repeated); an empty table
    gives an empty result; other columns are ignored.
    """
    ship_code(docs.sparkSession)
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.byte_slices(batch):
                size, tokens = text_counts(part.column(1), path)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(base.dtypes)["doc_id"]
    counted = base.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
