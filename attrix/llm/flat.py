"""Arrow text columns as flat byte arrays, and word and shingle hashes over them.

Everything here works on one Arrow batch at a time and in blocks of
``BLOCK`` bytes, so memory follows the batch, not the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 22
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the largest n up to two blocks."""
    if len(_powers.get(base, ())) >= n:
        return _powers[base][:n]
    p = np.full(n, base, dtype=U64)
    p[:1] = 1
    p = np.cumprod(p, dtype=U64)
    if n <= 2 * BLOCK:
        _powers[base] = p
    return p


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def byte_slices(batch: pa.RecordBatch, column: int = 1, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, a row at least."""
    _, off = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True that lies within one text."""
    before = np.zeros(len(member), dtype=bool)
    before[1:] = member[:-1]
    before[off[:-1][off[:-1] < len(member)]] = False
    after = np.zeros(len(member), dtype=bool)
    after[:-1] = member[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def spans(body: np.ndarray, member: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of ``member``, which begin and end there, as an array of byte strings."""
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body[member])])


def pieces(body: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces that begin at ``starts`` (the first at 0) and end where the next begins."""
    bounds = np.append(starts, len(body)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body))])


def distinct(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct byte strings and the number of each among them: equal numbers mean equal bytes."""
    coded = strings.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span (sorted, disjoint), a block of bytes at a time.

    Different spans can have one hash, and such are easy to write: compare
    the bytes after a hit.
    """
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = ends[j - 1]
        total = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum(BYTE_CODES[body[lo:hi]] * powers(BASE, hi - lo), out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * powers(BASE_INVERSE, hi - lo)[s] + (e - s).astype(U64))
        i = j
    return out


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64 bits of a cryptographic digest of each byte string."""
    digests = [hashlib.blake2b(w, digest_size=8).digest() for w in strings.to_pylist()]
    return np.frombuffer(b"".join(digests), dtype="<u8")


def word_hashes(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, split at white space) and the text it is in."""
    low = LOWER[body]
    member = ~SPACE[low]
    starts, ends = runs(member, off)
    words, number = distinct(spans(low, member, starts, ends))
    return string_hashes(words)[number], np.searchsorted(off, starts, "right") - 1


def shingle_sets(column: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and n + 1 offsets.

    A text with fewer than ``words`` words has one shingle, all its words; one
    without words has none.
    """
    body, off = flat(column)
    n = len(off) - 1
    h, doc = word_hashes(body, off)
    step = U64(0xD6E8FEB86659FD93)
    s = np.zeros(max(len(h) - words + 1, 0), dtype=U64)
    for k in range(words):
        s = s * step + h[k : k + len(s)]
    whole = doc[: len(s)] == doc[words - 1 :] if len(s) else np.zeros(0, bool)
    s, owner = mix(s[whole] + U64(words)), doc[: len(s)][whole]
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        extra = np.zeros(len(few), dtype=U64)
        for k in range(words - 1):
            has = count[few] > k
            extra[has] = extra[has] * step + h[first[few[has]] + k]
        s = np.concatenate((s, mix(extra + count[few].astype(U64))))
        owner = np.concatenate((owner, few))
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s[a:b].sort()
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(n + 1))


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
