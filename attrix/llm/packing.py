"""Token ids packed into rows of fixed length: best-fit decreasing with a segment tree.

Documents become pieces of at most ``length`` ids: one that is longer is cut
without loss, and every piece knows its place.  Pieces are dealt to shards by
a hash of (doc_id, piece, ids, copy), so a hot source, a very long document or
a row that repeats is spread;
the number of shards follows the volume, so a shard fits a task.  In a shard,
pieces go by decreasing size into the open row with the least room that
suffices, found in a segment tree over the possible rooms.

A row is written as a packed matrix row of little-endian ids (padded), the
cumulative segment lengths, and position ids that restart with each segment.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm import flat
from attrix.llm.shared import pick, ship_code

LENGTH = 2048
PAD = 0
#: Bytes of text that a shard gets on average.
SHARD_BYTES = 8 << 20


class RoomTree:
    """Rows by free room, with a segment tree of row counts over rooms 0..length."""

    def __init__(self, length: int):
        self.leaves = 1
        while self.leaves <= length:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i //= 2

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) with the least room of at least ``need``."""
        i = need + self.leaves
        while not self.count[i]:
            while i & 1:  # a right child: go up
                i //= 2
                if not i:
                    return None
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last node of the level
                return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; pieces are taken in decreasing size, then in their order."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            rows.append([])
            found = len(rows) - 1, length
        rows[found[0]].append(i)
        if found[1] > sizes[i]:
            tree.put(found[0], found[1] - sizes[i])
    return rows


@functools.cache
def encoding(path: str):
    """The tiktoken library over a ranks file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, n, ids, copy): the ids of each text, 32-bit little-endian, cut to at most ``length``.

    ``copy`` is the row's place in the input (task and position), which tells
    equal rows apart.  Read ``docs`` from files: then a task that runs again
    has the same rows at the same places.
    """
    ship_code(docs.sparkSession)
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoding(path)
        place = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            for part in flat.byte_slices(batch):
                take, piece, size, ids, copy = [], [], [], [], []
                for i, t in enumerate(part.column(1)):
                    t = t.as_py() or ""
                    place += 1
                    all_ids = np.array(tool.encode_ordinary(t), dtype="<u4")
                    for k, lo in enumerate(range(0, len(all_ids), length)):
                        cut = all_ids[lo : lo + length]
                        take.append(i)
                        piece.append(k)
                        size.append(len(cut))
                        ids.append(cut.tobytes())
                        copy.append(place)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(ids, pa.binary()), pa.array(copy, pa.int64())],
                    ["doc_id", "piece", "n", "ids", "copy"],
                )

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, piece int, n int, ids binary, copy long")


def pack_pieces(pieces: DataFrame, shards: int, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """Packed rows of ``pieces``: shard, row_no, n_tokens, ids, cu_seqlens, position_ids, doc_ids, pieces.

    ``ids`` is a row of the matrix (``length`` unsigned 32-bit little-endian
    ids, padded with ``pad``); ``cu_seqlens`` goes from 0 to n_tokens;
    ``position_ids`` (as ids) restart at each segment and are 0 in the padding.
    """
    id_type = dict(pieces.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("n", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        size = order.column("n").to_pylist()
        ids = order.column("ids")
        out: dict[str, list] = {k: [] for k in ("row_no", "n_tokens", "ids", "cu_seqlens", "position_ids")}
        members = best_fit(size, length)
        for r, row in enumerate(members):
            n = [size[i] for i in row]
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            packed = np.full(length, pad, dtype="<u4")
            packed[: ends[-1]] = np.frombuffer(b"".join(ids[i].as_py() for i in row), dtype="<u4")
            places = np.zeros(length, dtype="<u4")
            places[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
            for k, v in zip(out, (r, int(ends[-1]), packed.tobytes(), ends.tolist(), places.tobytes())):
                out[k].append(v)
        flat = pa.array([i for row in members for i in row], pa.int64())
        bounds = pa.array(np.concatenate(([0], np.cumsum([len(m) for m in members]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, order.column(c).take(flat).combine_chunks()) for c in ("doc_id", "piece")]
        shard = table.column("shard")[0].as_py()
        return pa.table(
            [
                pa.array([shard] * len(members), pa.int32()),
                pa.array(out["row_no"], pa.int32()),
                pa.array(out["n_tokens"], pa.int32()),
                pa.array(out["ids"], pa.binary()),
                pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
                pa.array(out["position_ids"], pa.binary()),
                *lists,
            ],
            names=["shard", "row_no", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "pieces"],
        )

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.xxhash64("ids"), "copy"), F.lit(shards)).cast("int")).drop("copy")
    schema = f"shard int, row_no int, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{id_type}>, pieces array<int>"
    return dealt.groupBy("shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, pad: int = PAD, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: see ``pack_pieces`` for the columns.

    A null or empty text has no ids and so no segment.  A null id is a
    segment with a null id; rows that repeat an id are segments of their own.
    An empty table gives an empty result; other columns are ignored.
    """
    volume = pick(docs, text=text_col).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-volume // shard_bytes))
    return pack_pieces(token_pieces(docs, path, length, id_col, text_col), shards, length, pad)
