import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from attrix.llm import ranking


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rank_brute(docs, items, top=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score:
                scored.append((-score, i is None, i, -score))
        for k, (_, _, i, score) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:top]):
            out.append((item, k + 1, i, -score))
    return sorted(out, key=str)


@pytest.fixture
def rank(spark, docs):
    def run(rows, items, **options):
        table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, TEXT string")
        got = ranking.rank_documents(docs(rows), table, **options).collect()
        return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=str)

    return run


def collection(rng, n):
    words = [f"w{i}" for i in range(300)] + ["Ñandú", "ÉTÉ", "漢字"]
    pick = lambda k: " ".join(words[min(int(rng.expovariate(0.02)), 302)] for _ in range(k))
    rows = [(i, pick(rng.randint(0, 80))) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # copies: ties
    rows += [(n + 50, "w1 " * 50_000), (n + 51, None), (n + 52, ""), (n + 53, "--")]
    items = [(i, pick(rng.randint(1, 40))) for i in range(40)] + [(90, rows[7][1]), (91, ""), (92, None), (93, "unseen"), (94, "w2 w2 w2 W2")]
    return rows, items


def test_ranks_match_brute_force(rank, monkeypatch):
    rows, items = collection(random.Random(1), 400)
    want = rank_brute(rows, items)
    assert rank(rows, items) == want
    monkeypatch.setattr(ranking, "BATCH_DOCS", 48)
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", 7)  # several blocks
    assert rank(rows, items) == want
    assert rank(rows, items, top=3) == rank_brute(rows, items, 3)


def test_null_and_repeated_ids_and_empty_tables(rank):
    rows = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a"), (4, "c"), (5, None)]
    items = [(None, "a"), (1, "a b"), (1, "a b")]
    assert rank(rows, items) == rank_brute(rows, items)
    assert rank([], items) == [] and rank(rows, []) == []


def test_ids_that_are_strings(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    got = ranking.rank_documents(docs, spark.createDataFrame([("q", "x")], "item_id string, text string")).collect()
    assert [(r.item_id, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [("q", "a"), ("q", "b"), ("q", None)]


def test_pruning_is_exact_and_leaves_out_pairs():
    """Topics of their own terms: bounds keep most of the scores from being computed."""
    rng = np.random.default_rng(2)
    n_terms, topics = 400, 20
    of = np.repeat(np.arange(topics), 64)
    matrix = np.zeros((len(of), n_terms), np.float32)
    for d, t in enumerate(of):
        matrix[d, rng.choice(np.arange(t * 20, t * 20 + 20), 6)] = rng.integers(1, 10**6, 6)
        matrix[d, rng.integers(0, n_terms)] = rng.integers(1, 1000)
    rows = [{int(k): int(rng.integers(1, 20_000)) for k in rng.choice(np.arange(t * 20, t * 20 + 20), 8)} for t in range(topics) for _ in range(16)]
    tree = ranking.ItemTree(rows, np.ones(n_terms))
    lists = ranking.Lists(len(rows), 5)
    ids = np.arange(len(of))
    scored = ranking.search(tree, ranking.DocumentTree(matrix), (np.zeros(len(of), bool), ids), lists)
    got = collections.defaultdict(list)
    for who, score, _, id_ in lists.rows.values():
        for i, s, d in zip(who.tolist(), score.tolist(), id_.tolist()):
            got[i].append((-s, d))
    for i, row in enumerate(rows):
        full = sum(matrix[:, t].astype(np.int64) * w for t, w in row.items())
        assert sorted(got[i]) == sorted((-s, d) for d, s in enumerate(full.tolist()) if s)[:5]
    assert scored < len(rows) * len(of) / 4


def test_weights_beyond_whole_doubles():
    rows = [{0: 10**10 + 1, 1: 3}]
    tree = ranking.ItemTree(rows, np.ones(2))
    lists = ranking.Lists(1, 1)
    ranking.search(tree, ranking.DocumentTree(np.array([[999_999, 0], [999_999, 1]], np.float32)), (np.zeros(2, bool), np.arange(2)), lists)
    assert [x.tolist() for x in lists.rows[0]] == [[0], [(10**10 + 1) * 999_999 + 3], [False], [1]]


def test_terms_of_sliced_columns():
    column = pa.array(["skip", "A1-b_c", None, "Éa\u0000b"]).slice(1)
    found, owner = ranking.terms(column)
    assert [t.decode() for t in found.to_pylist()] == ["a1", "b", "c", "Éa", "b"] and owner.tolist() == [0, 0, 0, 2, 2]
