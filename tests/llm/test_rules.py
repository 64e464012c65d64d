import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from attrix.llm import rules
from test_texts import labelled


def base_brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dups, len(covered), failed


def noisy_texts(n):
    rng = random.Random(5)
    words = ["a", "b", "the", "é", "漢", "#x", "$|", "Long-er", "\x0b", "\r", "\u0085"]
    out = []
    for _ in range(n):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.4 and len(parts) > 6:
            i = rng.randrange(len(parts) - 5)
            parts += parts[i : i + rng.randint(5, 9)]
        out.append("".join(p + rng.choice([" ", " ", "\n", "\t ", "\n\n"]) for p in parts))
    return out


def test_base_counts_match_brute_force():
    texts = [*noisy_texts(1500), "", None, "\n", "one\none\n one\none\r\none\r", "z " * 3000, "q" * 100_000]
    base, x = rules.statistics(pa.array(texts))
    got = [(*row, f) for row, f in zip(base.tolist(), rules.base_failed(base).tolist())]
    assert got == [base_brute(t) for t in texts]
    assert x.shape == (len(texts), len(rules.FEATURES)) and np.isfinite(x).all()


def test_statistics_don_t_depend_on_blocks(monkeypatch):
    texts = noisy_texts(80)
    whole = rules.statistics(pa.array(texts))
    monkeypatch.setattr(rules.flat, "BLOCK", 61)
    parts = rules.statistics(pa.array(texts))
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_statistics_don_t_depend_on_the_batch():
    texts = noisy_texts(60)
    base, x = rules.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        alone, y = rules.statistics(pa.array(["left out", t]).slice(1))
        assert (alone[0] == base[i]).all() and np.allclose(y[0], x[i])


def walk(trees, row):
    """The same sum node by node."""
    total = trees.start
    for t in range(len(trees.feature)):
        at = 0
        while trees.left[t][at] != at:
            at = (trees.left if row[trees.feature[t][at]] <= trees.cut[t][at] else trees.right)[t][at]
        total += trees.value[t][at]
    return total


def noisy_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4))
    y = (x[:, 0] + np.sin(6 * x[:, 1]) + 0.3 * rng.standard_normal(n) > 1).astype(float)
    return x, y


def test_trees_learn_and_flattened_scores_equal_a_walk():
    x, y = noisy_rows(4000)
    trees = rules.fit_trees(x[:3000], y[:3000], ())
    assert np.allclose(trees.margin(x[:50]), [walk(trees, r) for r in x[:50]])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85


def test_score_never_rises_with_a_falling_feature():
    x, y = noisy_rows(3000)
    free, bound = rules.fit_trees(x, y, ()), rules.fit_trees(x, y, (1,))
    assert len(set(bound.feature[bound.left != np.arange(bound.left.shape[1])])) > 1
    grid = np.repeat(np.random.default_rng(3).random((200, 4)), 101, axis=0)
    grid[:, 1] = np.tile(np.linspace(0, 1, 101), 200)
    steps = [np.diff(t.margin(grid).reshape(200, 101), axis=1) for t in (free, bound)]
    assert steps[0].max() > 0.1 and steps[1].max() <= 1e-9 and steps[1].min() < -0.1


def test_rules_keep_good_and_drop_bad_held_out_texts(spark, docs):
    rows, labels = labelled(300)
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 0)], "doc_id long, quality int")
    frame = docs([*rows, (None, None), (999, ""), (0, rows[0][1]), (998, "same line again\n" * 30)])
    got = rules.apply_rules(frame, rules.fit_rules(frame, table)).collect()
    assert len(got) == 304
    text = {**dict(rows), 999: "", None: None, 998: "same line again\n" * 30}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_brute(text[r.doc_id])
        assert r.kept == (not r.base_failed and r.score >= 0.5)
    label = dict(labels)
    held = [r for r in got if r.doc_id in label and not r.base_failed]
    assert len(held) > 250 and all(r.kept == bool(label[r.doc_id]) for r in held)


def test_without_labels_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = rules.fit_rules(docs([(1, "a")]), none)
    text = " ".join(f"w{i}" for i in range(20))
    assert [(r.base_failed, r.kept) for r in rules.apply_rules(docs([(1, text)]), model).collect()] == [(False, True)]
    assert rules.apply_rules(docs([]), model).count() == 0
    bad = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert not rules.apply_rules(docs([(1, text)]), rules.fit_rules(docs([(1, text)]), bad)).first().kept
