"""Permutations of rows in the order of md5 hashes, a few at a time (XPL-4).

The hash of a row's key places the row in a bucket of hashes.  The ranks of a
bucket's rows follow those of the buckets before, whose sizes a first pass has
counted, so a bucket receives its rows and the values at its ranks in one
exchange, and no row is sent a second time.  Hashes are computed in blocks by
numpy and never stored; rows are kept and sent in blocks too (Arrow streams),
since they are read again and again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrix.session import materialize, ship_code, without_shuffle_files

#: Copies of rows that are exchanged at once, permutations at least (each round reads all rows), and copies in a bucket.
COPIES, PERMUTATIONS, BUCKET = 1 << 25, 3, 1 << 18
#: What a task gathers before it deals: copies, bytes.  Rows and bytes of a kept block, and bytes of a row group of
#: blocks, which a reader holds at once.
GATHERED, GATHERED_BYTES = 1 << 19, 32 << 20
KEPT, KEPT_BYTES, ROW_GROUP = 4096, 256 << 10, 16 << 20

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_CHUNK = 16384
_WORD = (1 << 32) - 1


def _md5_60(words: np.ndarray, ending: np.ndarray, work: np.ndarray) -> np.ndarray:
    """The first 60 bits of the md5 of one block a column: ``words`` (the words that
    differ, little-endian) plus ``ending`` (16 words that all have)."""
    m = words.shape[1]
    a, b, c, d, f, t = work[:, :m]
    for x, start in zip((a, b, c, d), _STATE):
        x[:] = start
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        if g < len(words):
            np.add(f, words[g], f)
        np.add(f, np.uint32((_SINES[i] + int(ending[g])) & _WORD), f)
        np.left_shift(f, np.uint32(_TURNS[i]), t), np.right_shift(f, np.uint32(32 - _TURNS[i]), f)
        np.bitwise_or(f, t, f), np.add(f, b, f)
        a, d, c, b, f = d, c, b, f, a
    head = (a + np.uint32(_STATE[0])).byteswap().astype(np.int64) << 28
    return head | ((b + np.uint32(_STATE[1])).byteswap() >> np.uint32(4)).astype(np.int64)


class KeyTexts:
    """Key texts, to be hashed with many endings: ``hash_order(key, *ends)`` a key."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary())
        self.n, self.texts = len(texts), texts
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.n + 1]
        lengths = np.diff(starts)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        self.nulls = np.flatnonzero(np.asarray(texts.is_null()))
        lengths[self.nulls] = -1
        self.blocks, self.long = [], np.flatnonzero(lengths > 55)
        for size in np.unique(lengths[(lengths >= 0) & (lengths <= 55)]).tolist():
            at = np.flatnonzero(lengths == size)
            n_words = -(-size // 4)
            filled = np.zeros((len(at), 4 * n_words), np.uint8)
            for i in range(size):
                filled[:, i] = data[starts[at] + i]
            self.blocks.append((size, at, np.ascontiguousarray(filled.view("<u4").T)))
        self.work = np.empty((6, _CHUNK), np.uint32)

    def hashes(self, *ends: object) -> np.ndarray:
        # a key that is missing leaves no separator, as in concat_ws
        ending = "-".join(map(str, ends)).encode()
        out = np.empty(self.n, np.int64)
        out[self.nulls] = _plain(ending)
        ending = b"-" + ending
        for size, at, words in self.blocks:
            if size + len(ending) > 55:
                self._one_by_one(out, at, ending)
                continue
            block = bytearray(64)
            block[size : size + len(ending) + 1] = ending + b"\x80"
            block[56:] = (8 * (size + len(ending))).to_bytes(8, "little")
            common = np.frombuffer(bytes(block), "<u4")
            for i in range(0, len(at), _CHUNK):
                out[at[i : i + _CHUNK]] = _md5_60(words[:, i : i + _CHUNK], common, self.work)
        self._one_by_one(out, self.long, ending)
        return out

    def _one_by_one(self, out: np.ndarray, at: np.ndarray, ending: bytes) -> None:
        for i in at.tolist():
            out[i] = _plain(self.texts[i].as_py() + ending)


def _plain(text: bytes) -> int:
    return int(hashlib.md5(text).hexdigest()[:15], 16)


def permuted_scores(
    rows: DataFrame, key: str, columns: Sequence[str], feats: Sequence[str], repeats: int, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(feature, rep, what ``score`` sums up): for each feature and repeat ``score``
    gets all rows, and the one whose rank by md5(key-feature-repeat) is i (ties by
    slot) has the value of the feature that the row at slot i has.

    ``rows`` has the ``columns`` and ``_slot``, numbers from 0 without gaps.
    ``score`` groups its rows by ``_pair``.  Many rows are done in rounds, a job
    each, and the files of a round's exchange go with it, so that the disk holds
    ``COPIES`` rows or a few copies of each row, not F x R."""
    spark = rows.sparkSession
    ship_code(spark)
    pairs = [(c, r) for c in feats for r in range(repeats)]
    numbers = [F.col(c).cast("double").alias(c) if c in feats else F.col(c) for c in columns]
    copied = rows.select(F.col(key).cast("string").alias("_text"), "_slot", *numbers)
    kinds = T.StructType([T.StructField("_pair", T.IntegerType()), *[f for f in copied.schema.fields if f.name not in ("_text", "_slot")]])
    with without_shuffle_files(spark):
        kept = materialize(copied.mapInArrow(_keeping, "n long, texts binary, block binary"), "permutation-rows", **{"parquet.block.size": ROW_GROUP})
    n = kept.agg(F.sum("n").alias("n")).first()["n"] or 0
    at_once = max(1, min(len(pairs), max(PERMUTATIONS, COPIES // max(n, 1))))
    bits = max(0, math.ceil(math.log2(max(1, at_once * n / BUCKET))))

    sizes = np.zeros((len(pairs), 1 << bits), np.int64)
    found = kept.select("texts").mapInArrow(_counting(pairs, bits), "pair int, bucket int, n long").groupBy("pair", "bucket").agg(F.sum("n").alias("n"))
    for pair, bucket, count in found.collect():
        sizes[pair, bucket] = count
    # a bucket's first rank, and the rank after its last
    ends = np.cumsum(sizes, axis=1)
    starts = ends - sizes

    def scored(first: int) -> DataFrame:
        here = range(first, min(first + at_once, len(pairs)))
        ranks = starts[here.start : here.stop], ends[here.start : here.stop]
        dealt = kept.select("texts", "block").mapInArrow(_dealing(pairs, here, bits, *ranks), "bucket int, pair int, block binary")
        given = dealt.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(_giving(pairs, here, list(columns), *ranks), kinds)
        return score(given)

    if at_once >= len(pairs):
        out = scored(0)
    else:
        with without_shuffle_files(spark):
            out = spark.createDataFrame(pa.concat_tables([scored(i).toArrow() for i in range(0, len(pairs), at_once)]))
    names = F.array(*[F.lit(c) for c, _ in pairs])
    repeat = F.array(*[F.lit(r) for _, r in pairs])
    return out.select(F.get(names, F.col("_pair")).alias("feature"), F.get(repeat, F.col("_pair")).alias("rep"), *[c for c in out.columns if c != "_pair"])


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _table(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _keeping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = max(1, min(KEPT, KEPT_BYTES * batch.num_rows // max(batch.nbytes, 1)))
        parts = [pa.table(batch.slice(i, size)) for i in range(0, batch.num_rows, size)]
        counts = pa.array([p.num_rows for p in parts], pa.int64())
        texts, blocks = [_stream(p.select(["_text"])) for p in parts], [_stream(p.drop_columns(["_text"])) for p in parts]
        yield pa.RecordBatch.from_arrays([counts, pa.array(texts, pa.binary()), pa.array(blocks, pa.binary())], ["n", "texts", "block"])


def _counting(pairs: Sequence[tuple[str, int]], bits: int) -> Callable:
    """Rows in a bucket by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros((len(pairs), 1 << bits), np.int64)
        for batch in batches:
            # some blocks at a time, as many short arrays take longer
            for i in range(0, batch.num_rows, 16):
                texts = KeyTexts(pa.concat_tables(map(_table, batch.column(0).slice(i, 16))).column(0))
                for p, pair in enumerate(pairs):
                    sizes[p] += np.bincount(texts.hashes(*pair) >> (60 - bits), minlength=1 << bits)
        pair, bucket = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sizes[pair, bucket])], ["pair", "bucket", "n"])

    return run


def _dealing(pairs: Sequence[tuple[str, int]], here: range, bits: int, starts: np.ndarray, ends: np.ndarray) -> Callable:
    """Blocks of rows by pair and bucket, and (as pair -1) the values at the ranks of a bucket."""
    feats = list(dict.fromkeys(pairs[p][0] for p in here))
    lowest, highest = _bounds(starts, ends)

    def blocks(keys: pa.Table, rows: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        texts = KeyTexts(keys.column(0))
        for p in here:
            h = texts.hashes(*pairs[p])
            bucket = (h >> (60 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            stops = np.cumsum(np.bincount(bucket, minlength=1 << bits))
            # the feature's own values stay behind
            sent = rows.drop_columns([pairs[p][0]]).append_column("_h", pa.array(h)).take(pa.array(order)).combine_chunks()
            for b, (i, j) in enumerate(zip([0, *stops[:-1].tolist()], stops.tolist())):
                if i < j:
                    yield b, p, _stream(sent.slice(i, j - i))
        slot = rows.column("_slot").to_numpy()
        order = np.argsort(slot, kind="stable")
        values = rows.select(["_slot", *feats]).take(pa.array(order)).combine_chunks()
        slot = slot[order]
        for b, (i, j) in enumerate(zip(np.searchsorted(slot, lowest).tolist(), np.searchsorted(slot, highest).tolist())):
            if i < j:
                yield b, -1, _stream(values.slice(i, j - i))

    def dealt(gathered: list[tuple[pa.Table, pa.Table]]) -> pa.RecordBatch:
        bucket, pair, block = zip(*blocks(*[pa.concat_tables(x).combine_chunks() for x in zip(*gathered)]))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(pair, pa.int32()), pa.array(block, pa.binary())], ["bucket", "pair", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n_rows, n_bytes = [], 0, 0
        for batch in batches:
            for keys, rows in zip(map(_table, batch.column(0)), map(_table, batch.column(1))):
                gathered.append((keys, rows))
                n_rows, n_bytes = n_rows + rows.num_rows, n_bytes + rows.nbytes
                if n_rows * len(here) >= GATHERED or n_bytes * len(here) >= GATHERED_BYTES:
                    yield dealt(gathered)
                    gathered, n_rows, n_bytes = [], 0, 0
        if gathered:
            yield dealt(gathered)

    return run


def _bounds(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest rank in a bucket and the rank after the highest, of the pairs with rows there."""
    some = starts < ends
    return np.where(some, starts, np.iinfo(np.int64).max).min(axis=0), np.where(some, ends, 0).max(axis=0)


def _giving(pairs: Sequence[tuple[str, int]], here: range, columns: list[str], starts: np.ndarray, ends: np.ndarray) -> Callable:
    """A bucket's rows, each with the value at its rank."""
    lowest, highest = _bounds(starts, ends)

    def give(dealt: pa.Table) -> pa.Table:
        bucket = dealt.column("bucket")[0].as_py()
        parts: dict[int, list[pa.Table]] = {}
        for pair, block in zip(dealt.column("pair").to_pylist(), dealt.column("block")):
            parts.setdefault(pair, []).append(_table(block))
        values = pa.concat_tables(parts.pop(-1))
        slot = values.column("_slot").to_numpy()
        order = np.argsort(slot)
        if not np.array_equal(slot[order], np.arange(lowest[bucket], highest[bucket])):
            raise ValueError(f"bucket {bucket} has {len(slot)} values for the ranks {lowest[bucket]} to {highest[bucket]}")
        out = []
        for pair, blocks in sorted(parts.items()):
            rows = pa.concat_tables(blocks)
            first, last = starts[pair - here.start, bucket], ends[pair - here.start, bucket]
            rank = _ranks(rows.column("_h").to_numpy(), rows.column("_slot").to_numpy())
            if len(rank) != last - first:
                raise ValueError(f"bucket {bucket} has {len(rank)} rows of pair {pair}, not {last - first}")
            feature = pairs[pair][0]
            donor = values.column(feature).combine_chunks().take(pa.array(order[rank + (first - lowest[bucket])]))
            ids = pa.array(np.full(len(rank), pair, np.int32))
            out.append(pa.Table.from_arrays([ids, *[donor if c == feature else rows.column(c) for c in columns]], ["_pair", *columns]))
        return pa.concat_tables(out)

    return give


def _ranks(h: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Places from 0 by hash, rows with equal hashes by slot."""
    order = np.argsort(h)
    if len(h) > 1 and not np.all(np.diff(h[order])):
        order = np.lexsort((slot, h))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    return rank
