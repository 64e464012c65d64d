import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from attrix.llm import bpe, flat, packing, pretokens, token_counts
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "abz 's'tre\n\t\r  é1²½'ll..-_ßñ漢字😀 \u0085\x1c​"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    return out + ["", "a<|endoftext|> b  <|endoftext|>", "I'll he'd we've 'tis x'S", "   ", "\n\n a", "z" * 3000]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_match_the_library(texts):
    library = tokenizers.Tokenizer.from_file(JSON)
    size, got = token_counts.text_counts(pa.array([*texts, None]), JSON)
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts] + [0]
    assert size.tolist() == [len(t.encode()) for t in texts] + [0]


def test_ids_match_the_library_and_decode(texts, tik):
    codec = bpe.codec(RANKS)
    body, off = flat.flat(pa.array(texts))
    ids, bounds = codec.encode(body, off)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [tik.encode_ordinary(t) for t in texts]
    back, back_off = codec.decode(ids, bounds)
    assert back.tobytes() == body.tobytes() and back_off.tolist() == off.tolist()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_pieces_with_one_polynomial_hash_stay_apart(tik):
    """Any polynomial hash modulo 2**64 is the same for these two."""
    t = thue_morse(1024)
    pair = [t, t.translate(str.maketrans("ab", "ba"))]
    body, off = flat.flat(pa.array(pair))
    assert len(set(flat.span_hashes(body, off[:-1], off[1:]).tolist())) == 1
    library = tokenizers.Tokenizer.from_file(JSON)
    for texts in (pair, pair[::-1]):
        assert token_counts.text_counts(pa.array(texts), JSON)[1].tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
        codec = bpe.Codec(RANKS)
        ids, bounds = codec.encode(*flat.flat(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [tik.encode_ordinary(x) for x in texts]


def test_tokens_are_found_by_their_bytes(monkeypatch):
    """A hash that names a token for each piece doesn't make it one."""
    codec = bpe.Codec(RANKS)
    strings = pa.array([b"the", b"xyzzyx", b" and", b"an"], pa.large_binary())
    monkeypatch.setattr(codec.hash, "find", lambda keys: np.full(len(keys), codec.ids.tolist().index(codec.ranks[b" and"])))
    assert (codec.find(*flat.flat(strings)) >= 0).tolist() == [False, False, True, False]


def test_added_tokens_that_strip_blanks_are_refused(tmp_path):
    import json

    spec = json.load(open(JSON, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    with open(tmp_path / "t.json", "w", encoding="utf-8") as f:
        json.dump(spec, f)
    with pytest.raises(ValueError):
        token_counts.Vocabulary(str(tmp_path / "t.json"))


def test_blocks_and_chunks_don_t_matter(texts, monkeypatch):
    body, off = flat.flat(pa.array(texts[::40]))
    want = pretokens.piece_starts(body, off, "tiktoken").tolist()
    for size in (61, 1001):
        monkeypatch.setattr(pretokens, "BLOCK", size)
        assert pretokens.piece_starts(body, off, "tiktoken").tolist() == want


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = np.random.default_rng(1).integers(1, 2**63, 5000, dtype=np.uint64)
    table = bpe.PerfectHash(keys[:4000])
    assert sorted(table.slots.tolist()) == list(range(4000))
    assert table.find(keys).tolist() == [*range(4000), *[-1] * 1000]


def test_count_operator(docs, corpus):
    library = tokenizers.Tokenizer.from_file(JSON)
    rows = [*corpus, (None, "no id"), (0, corpus[0][1])]
    got = token_counts.token_counts(docs(rows), JSON).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(docs([]), JSON).count() == 0


def test_codec_operator(docs, corpus, tik):
    rows = [*corpus, (None, "no id"), (0, corpus[0][1])]
    ids = bpe.encode(docs(rows), RANKS)
    got = ids.select("doc_id", "n_tokens", "ids", bpe.decode(F.col("ids"), RANKS).alias("decoded")).collect()
    want = [(r[0], tik.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    plain = sorted([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got], key=str)
    assert plain == sorted(want, key=str)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.encode(docs([]), RANKS).count() == 0


def test_best_fit_decreasing_takes_the_tightest_row():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 60))]
        rooms = []
        for size in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= size]
            rooms.remove(min(fits)) if fits else None
            rooms.append((min(fits) if fits else 20) - size)
        rows = packing.best_fit(sizes, 20)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(20 - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


def test_packing_is_lossless(docs, corpus, tik):
    rows = [*corpus, (None, "no id"), (0, corpus[0][1])]
    length = 128
    packed = packing.pack_documents(docs(rows), RANKS, length=length, pad=9, shard_bytes=200_000).collect()
    assert len({r.shard for r in packed}) > 1
    pieces = []
    for r in packed:
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        ends = r.cu_seqlens
        assert len(ids) == len(places) == length and ends[0] == 0 and ends[-1] == r.n_tokens <= length
        assert (ids[r.n_tokens :] == 9).all() and (places[r.n_tokens :] == 0).all()
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.append((r.doc_ids[k], r.pieces[k], ids[a:b].tolist()))
    want = []
    for r in rows:
        ids = tik.encode_ordinary(r[1] or "")
        want += [(r[0], k, ids[lo : lo + length]) for k, lo in enumerate(range(0, len(ids), length))]
    assert sorted(pieces, key=str) == sorted(want, key=str)
    assert packing.pack_documents(docs([]), RANKS).count() == 0


def test_equal_rows_spread_over_shards(docs):
    """The same row many times, without an id: no shard gets most of it."""
    rows = [(None, "the same words again " * 20)] * 400
    packed = packing.pack_documents(docs(rows), RANKS, length=256, shard_bytes=20_000).collect()
    by_shard = Counter()
    for r in packed:
        by_shard[r.shard] += len(r.doc_ids)
    assert sum(by_shard.values()) == 400 and len(by_shard) > 5 and max(by_shard.values()) < 100


def test_rows_repeat_between_runs(spark, docs, corpus):
    def digest():
        rows = packing.pack_documents(docs(corpus), RANKS, length=256).collect()
        return sorted(hashlib.sha256(r.ids).hexdigest() for r in rows)

    assert digest() == digest()
