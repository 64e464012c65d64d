import collections
import random
import re
import zlib

import numpy as np
from attrix.llm import spelling


def words_brute(rows):
    count = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_brute(rows, factor=10):
    n = words_brute(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variants(docs, rows, **options):
    got = spelling.spelling_variants(docs(rows), **options).collect()
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got)


def family(rng):
    """Words, their misspellings and misspellings of those, anagrams, shared and long words."""
    alphabet = "abcdeèéñz"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 12))) for _ in range(60)]
    texts = []
    for w in words:
        texts += [w] * rng.choice([1, 2, 30, 150])
        for _ in range(5):
            i, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
            v = rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])
            texts += [v] * rng.choice([1, 2, 3, 20])
            w = v if rng.random() < 0.4 else w
    texts += ["".join(rng.sample("stretch", 7)) for _ in range(300)] + ["strètch", "STRETCH", "x" * 20_000, "x" * 20_000, "x" * 20_001, "x" * 20_001, "short"] * 2
    texts += ["longword"] * 400 + ["lonngword"] * 30 + ["lonngwordd"] * 2  # a chain of forms
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "; ", "7"]).join(texts[k : k + 40])) for i, k in enumerate(range(0, len(texts), 40))]


def test_variants_match_brute_force(docs, monkeypatch):
    rows = family(random.Random(1))
    want = variants_brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)
    assert variants(docs, rows) == want
    monkeypatch.setattr(spelling, "REGION_WORDS", 9)  # many regions, and blocks of equal vectors
    assert variants(docs, rows) == want
    assert variants(docs, rows, factor=2) == variants_brute(rows, 2)


def test_regions_from_a_sample_lose_no_pair(docs, monkeypatch):
    rows = family(random.Random(2))
    monkeypatch.setattr(spelling, "SAMPLE", 40)
    monkeypatch.setattr(spelling, "REGION_WORDS", 12)
    assert variants(docs, rows) == variants_brute(rows)


def test_null_repeated_and_empty(docs):
    rows = [(None, "Variant variant"), (None, None), (1, ""), (1, "varient varient"), (1, "varient varient"), (2, "Évariant ×variant tiny")]
    assert variants(docs, rows) == variants_brute(rows)
    assert variants(docs, []) == []


def test_vectors_of_near_words_are_found():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcé") for _ in range(7)) for _ in range(900)})
    longer = sorted({"".join(rng.choice("abcé") for _ in range(8)) for _ in range(900)})
    found = collections.Counter()
    for which, a, b in spelling.near_pairs(longer, longer[:50], words):
        left = {"points": longer, "same": longer[:50], "shorter": words}[which]
        found.update((which, left[i], longer[j]) for i, j in zip(a.tolist(), b.tolist()))
    want = {("shorter", a, b) for a in words for b in longer if one_edit(a, b)}
    want |= {("same", a, b) for a in longer[:50] for b in longer if one_edit(a, b)}
    want |= {("points", a, b) for i, a in enumerate(longer) for b in longer[i + 1 :] if one_edit(a, b)}
    assert {(w, *sorted((a, b))) if w == "points" else (w, a, b) for w, a, b in found} == want and set(found.values()) == {1}


def test_letter_counts_are_cut_off_without_losing_edits():
    a = "x" * 1500 + "y" * 1500
    rows = spelling.vectors(np.concatenate([spelling.letters([w], 3000) for w in (a, a[:-1] + "x")]))
    assert rows.max() == spelling.MAX_LETTERS and np.abs(rows[0] - rows[1]).sum() <= 2
