import base64
import hashlib

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from attrix.llm.shared import pick
from test_dedup import near_brute, plain
from test_texts import labelled


def test_stages_on_a_fixture(spark, docs, tmp_path):
    rows, labels = labelled(120)
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = [r for r in rows if r[0] % 3]
    copies = [(1000 + i, t) for i, t in clean[:10]] + [(2000 + i, t + " end") for i, t in clean[:10]]
    given = [*rows, *copies, (1000, clean[0][1]), (None, "the quiet garden " * 9), (None, "the quiet garden " * 9), (3000, None)]
    pick(docs(given), **{c: c for c in corpus_pipeline.COLUMNS}).write.parquet(f"{tmp_path}/documents.parquet")
    d, tables = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        tables[name] = d = spark.read.parquet(f"{tmp_path}/{name}")

    def pairs(name):
        return sorted([(r.doc_id, r.text) for r in tables[name].collect()], key=str)

    accepted = pairs("quality")
    assert {i for i, _ in accepted} >= {r[0] for r in clean} and not {i for i, _ in accepted} & {r[0] for r in rows if r[0] % 3 == 0}
    first = {}
    for i, t in sorted(accepted, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(plain(t), i)
    assert sorted(i for i, _ in pairs("exact_dedup") if i is not None) == sorted(i for i in first.values() if i is not None)
    assert sum(i is None for i, _ in pairs("exact_dedup")) == 1
    named = [r for r in pairs("exact_dedup") if r[0] is not None]
    assert [i for i, _ in pairs("near_dedup") if i is not None] == sorted((r[0] for r in near_brute(named, 80) if r[3]), key=str)
    assert {i for i, _ in pairs("mix_sources")} <= {i for i, _ in pairs("near_dedup")}
    with open(public_tokenizers.path(corpus_pipeline.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tool = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in pairs("mix_sources"):
        ids = np.array(tool.encode_ordinary(t or ""), dtype="<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tables["encode"].collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_choose_rows_and_not_ids(spark, docs):
    """An id that repeats with other texts: each of its rows is decided on its own."""
    rows = [(0, "b"), (1, "a"), (1, "b"), (1, "b"), (None, "a"), (None, "c"), (None, "c")]
    got = corpus_pipeline.exact_stage(spark, docs(rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(0, "b"), (1, "a"), (None, "c")], key=str)
    first, second = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(0, first), (1, first + " end"), (1, second), (2, second + " end"), (None, first)]
    got = corpus_pipeline.near_stage(spark, docs(rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(0, first), (1, second), (None, first)], key=str)


def test_registered_queries():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
    assert {"op2_exact_dedup", "op3_mix_sources", "op10_minhash_near_dedup", "op11_spelling_variants", "op13_ranked_search"} <= set(entry.oracle_sql())
