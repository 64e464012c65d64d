"""Byte-level BPE encoding and decoding by ranks, with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every piece that
is itself a token, for all distinct pieces of a block at once; it names one
token, and the bytes are compared.  Tier two: the other pieces are merged with
a heap over linked bytes, and the latest of them are remembered in two
generations of ``MEMO``.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm import flat, pretokens
from attrix.llm.shared import pick, ship_code

MEMO, MEMO_BYTES = 150_000, 64  # pieces of a generation (there are two), and bytes of a piece at most
DECODE_IDS = 1 << 19
SLICE = 1 << 21
U64 = np.uint64


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by hash and displace."""

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        self.shift = np.zeros(self.buckets, dtype=np.int64)  # displacement, or -1 - slot of a lone key
        self.slots = np.zeros(n, dtype=np.int64)  # slot -> index of its key
        free = np.ones(n, dtype=bool)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(count) - count
        alone = []
        for k in np.argsort(-count, kind="stable").tolist():
            members = order[first[k] : first[k] + count[k]]
            if len(members) == 1:
                alone.append((k, int(members[0])))
            elif len(members):
                d, at = self._place(keys[members], free)
                free[at] = False
                self.shift[k], self.slots[at] = d, members
        for (k, i), at in zip(alone, np.flatnonzero(free).tolist()):
            self.shift[k], self.slots[at] = -1 - at, i
        self.keys = keys[self.slots]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (flat.mix(keys ^ U64(0x5851F42D4C957F2D)) % U64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (flat.mix(keys + shift.astype(U64) * U64(flat.BASE)) % U64(self.n)).astype(np.int64)

    def _place(self, keys: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        """Smallest displacement that puts the keys of a bucket into different free slots."""
        lo, many = 0, 16
        while True:
            at = self._slot(keys, np.arange(lo, lo + many)[:, None])
            for k in np.flatnonzero(free[at].all(axis=1)).tolist():
                if len(set(at[k].tolist())) == len(keys):
                    return lo + k, at[k]
            lo, many = lo + many, min(many * 4, 1 << 14)
            if lo > 1 << 26:
                raise ValueError("no displacement; two keys are equal")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for strangers."""
        if not self.n:
            return np.full(len(keys), -1, dtype=np.int64)
        d = self.shift[self._bucket(keys)]
        at = np.where(d < 0, -1 - d, self._slot(keys, np.maximum(d, 0)))
        return np.where(self.keys[at] == keys, self.slots[at], -1)


def gather(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of ragged rows ``which``, end to end, and the rows' sizes."""
    size = offsets[which + 1] - offsets[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(offsets[which] - (ends - size), size), size


class Codec:
    """Encoder and decoder for a file of ``base64-token rank`` lines."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in lines}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.ids = np.array([self.ranks[t] for t in tokens], dtype=np.uint32)
        off = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_off = off
        # bytes by id, for decoding
        size = np.zeros(int(self.ids.max()) + 2, dtype=np.int64)
        size[self.ids.astype(np.int64) + 1] = np.diff(off)
        self.pool, self.pool_off = pool, np.cumsum(size)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @functools.cached_property
    def hash(self) -> PerfectHash:
        return PerfectHash(flat.span_hashes(self.pool, self.token_off[:-1], self.token_off[1:]))

    def merge(self, piece: bytes) -> list[int]:
        """BPE of one piece: the lowest rank first, the leftmost of equals, by a heap over linked parts."""
        n = len(piece)
        if n < 2:
            return [self.ranks[piece]] if n else []
        ranks = self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0: merged into the one before
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != to:
                continue  # one of the two has changed since
            end[i], end[mid] = to, 0
            if to < n:
                left[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (k := left[i]) >= 0 and (r := ranks.get(piece[k:to])) is not None:
                heapq.heappush(heap, (r, k, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def find(self, body: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Index of each string among the tokens, -1 for those that aren't one."""
        found = self.hash.find(flat.span_hashes(body, off[:-1], off[1:]))
        hit = np.flatnonzero(found >= 0)
        size = off[hit + 1] - off[hit]
        token = found[hit]
        fits = self.token_off[token + 1] - self.token_off[token] == size
        found[hit[~fits]] = -1
        hit, token = hit[fits], token[fits]
        mine, size = gather(off, hit)
        differ = body[mine] != self.pool[gather(self.token_off, token)[0]]
        found[hit[np.bincount(np.repeat(np.arange(len(hit)), size), differ, len(hit)) > 0]] = -1
        return found

    def _ids(self, piece: bytes) -> bytes:
        ids = self.memo.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                ids = np.array(self.merge(piece), dtype=np.uint32).tobytes()
            if len(piece) <= MEMO_BYTES:
                self.memo[piece] = ids
        return ids

    def encode(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        starts = pretokens.piece_starts(body, off, "tiktoken")
        pieces, same = flat.distinct(flat.pieces(body, starts))
        found = self.find(*flat.flat(pieces))
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        miss = np.flatnonzero(found < 0)
        rows = [self._ids(piece) for piece in pieces.take(pa.array(miss)).to_pylist()]
        # ids of the distinct pieces end to end: whole tokens, then the others
        whole = found >= 0
        size = np.ones(len(found), dtype=np.int64)
        size[miss] = [len(r) // 4 for r in rows]
        ends = np.cumsum(size)
        values = np.empty(int(ends[-1]) if len(size) else 0, dtype=np.uint32)
        values[(ends - size)[whole]] = self.ids[found[whole]]
        bounds = np.concatenate(([0], ends))
        if len(miss):
            values[gather(bounds, miss)[0]] = np.frombuffer(b"".join(rows), dtype=np.uint32)
        place, counts = gather(bounds, same)
        text = np.searchsorted(starts, off)
        return values[place], np.concatenate(([0], np.cumsum(counts)))[text]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id rows end to end, and n + 1 offsets."""
        size = (self.pool_off[1:] - self.pool_off[:-1])[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(int(ends[-1]), dtype=np.uint8)
        for at in range(0, len(ids), DECODE_IDS):
            part = ids[at : at + DECODE_IDS].astype(np.int64)
            out[ends[at] : ends[at + len(part)]] = self.pool[gather(self.pool_off, part)[0]]
        return out, ends[off]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode(docs: DataFrame, path: str, with_bytes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (unsigned 32-bit little-endian).

    ``with_bytes`` adds ``decoded``, the bytes that the ids decode to, made in
    the same workers.  Ids are those of the tiktoken library for the ranks at
    ``path`` and the split pattern of public byte-level vocabularies, without
    special tokens.  A null or empty text has no ids.  Doc ids are passed
    through (null, repeated); an empty table gives an empty result; other
    columns are ignored.
    """
    ship_code(docs.sparkSession)
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in flat.byte_slices(batch, most=SLICE):
                ids, off = tool.encode(*flat.flat(part.column(1)))
                columns = [part.column(0), pa.array(np.diff(off), pa.int64()), binary_column(ids.astype("<u4").view(np.uint8), off * 4)]
                names = ["doc_id", "n_tokens", "ids"]
                if with_bytes:
                    columns.append(binary_column(*tool.decode(ids, off)))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    more = ", decoded binary" if with_bytes else ""
    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, n_tokens long, ids binary{more}")


def decode(ids: Column, path: str) -> Column:
    """The bytes of packed ids (null counts as none)."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        raw, off = flat.flat(column.cast(pa.large_binary()))
        return binary_column(*codec(path).decode(raw.copy().view("<u4"), off // 4))

    return run(ids)
