import hashlib
import random
import re
from collections import defaultdict

from attrix.llm import exact_dedup, near_dedup


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = [i for i in groups[plain(r[1])] if i is not None]
        keep = min(ids, default=None)
        out.append((r[0], keep, len(groups[plain(r[1])]), r[0] == keep, hashlib.sha256(plain(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


def exact(docs, rows):
    got = exact_dedup.exact_duplicates(docs(rows)).collect()
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str)


def test_exact_matches_brute_force(docs, corpus):
    assert exact(docs, corpus) == exact_brute(corpus)


def test_exact_null_ids_repeats_and_empty(docs):
    long = "p" * 5000
    rows = [(None, "a"), (None, "a"), (1, "b"), (1, "b"), (None, "b"), (2, None), (3, ""), (None, long + "1"), (None, long + "2"), (None, long + "1"), (1, "c")]
    assert exact(docs, rows) == exact_brute(rows)
    assert exact(docs, []) == []


def shingles(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def near_brute(rows, percent):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[top(i)].append(r[0])
    return sorted((r[0], len(sets[i]), min(low[top(i)]), r[0] == min(low[top(i)])) for i, r in enumerate(rows))


def near(docs, rows, percent):
    got = near_dedup.near_duplicates(docs(rows), percent=percent).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)


def test_near_matches_brute_force(docs, corpus):
    assert near(docs, corpus, 85) == near_brute(corpus, 85)


def test_near_family_of_copies_that_are_not_linked_with_their_original(docs):
    """Edits of their own: most copies aren't linked; a few share edits and are."""
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        words = list(base)
        for j in range(4):
            words[(k * 7 + j * 23) % 100] = f"own{k // 2 if k < 12 else k}x{j}"
        if k < 12 and k % 2:
            words = [f"own{k // 2}x{i}" if w.startswith("own") else w for i, w in enumerate(words)]
        rows.append((k, " ".join(words)))
    pair = list(base)
    for j in range(6):
        pair[j * 15] = f"both{j}"
    rows += [(100, " ".join(pair)), (101, " ".join([*pair[:50], "odd", *pair[51:]]))]
    assert near(docs, rows, 85) == near_brute(rows, 85)
    assert near(docs, rows, 80) == near_brute(rows, 80)


def test_near_links_of_members_whose_centre_is_linked_with_one_only(docs):
    """The only content of the table: x at 85 % of y, and c, which has one shingle more than x and so isn't linked with y."""
    rows = []
    for g in range(4):
        x = [f"g{g}w{i}" for i in range(374)]
        y = [f"g{g}new{i}" if i % 60 == 30 else w for i, w in enumerate(x)]
        rows += [(10 * g, " ".join([*x, "end"])), (10 * g + 1, " ".join(x)), (10 * g + 2, " ".join(y))]
    assert len({r[2] for r in near_brute(rows, 85)}) == 4
    assert near(docs, rows, 85) == near_brute(rows, 85)


def test_near_words_with_one_polynomial_hash_stay_apart(docs):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(6)]
    rows = [(i, " ".join([*words[:3], w, *words[3:]])) for i, w in enumerate((word, other, word))]
    assert near(docs, rows, 85) == near_brute(rows, 85) and {r[2] for r in near_brute(rows, 85)} == {0, 1}


def test_near_version_chains_alone(docs):
    """Each version is linked with its neighbours, few with the centre."""
    rows = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(204)]
        for v in range(9):
            rows.append((100 * g + v, " ".join(words)))
            for j in range(3):
                words[(5 + 7 * v + 67 * j) % 204] = f"g{g}v{v}e{j}"
    assert len({r[2] for r in near_brute(rows, 85)}) == 3
    assert near(docs, rows, 85) == near_brute(rows, 85)


def test_near_form_letters_do_not_meet_pair_by_pair(docs, monkeypatch):
    """A template with words of each letter's own: no two are linked, so each lacks the centre's own words."""
    met, real = [], near_dedup._matches

    def counted(prefixes):
        met.append(real(prefixes).count())
        return real(prefixes)

    rows = []
    for k in range(60):
        words = [f"t{i}" for i in range(150)]
        for j in range(4 + k % 3):
            words[20 * j + 10] = f"own{k}x{j}"
        rows.append((k, " ".join(words)))
    rows += [(100, rows[59][1] + " end"), (101, rows[59][1] + " the end")]
    monkeypatch.setattr(near_dedup, "_matches", counted)
    assert near(docs, rows, 85) == near_brute(rows, 85)
    assert len(met) == 1 and met[0] < 2 * 60


def test_near_members_that_share_what_their_centre_lacks(docs):
    """Random families around a core, with words shared by some and words of their own."""
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        for m in range(14):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                place = rng.randrange(120)
                words[place] = f"g{g}x{place}" if rng.random() < 0.6 else f"g{g}m{m}p{place}"
            if rng.random() < 0.5:
                words += [f"g{g}tail{i}" for i in range(rng.choice([3, 9, 20]))]
            rows.append((100 * g + m, " ".join(words)))
    for percent in (80, 85):
        assert near(docs, rows, percent) == near_brute(rows, percent)


def test_near_one_id_on_long_texts_with_copies(docs):
    """Each text of an id has its own class and its own near copies."""
    texts = [[f"t{n}w{i}" for i in range(120)] for n in range(3)]
    rows = [(1, " ".join(t)) for t in texts]
    rows += [(10 + n, " ".join([*t, "end"])) for n, t in enumerate(texts)] + [(20, " ".join(texts[2]))]
    got = near_dedup.near_duplicates(docs(rows), percent=85).collect()
    assert sorted((r.doc_id, r.class_id, r.component_id, r.kept) for r in got) == [(1, 1, 1, True)] * 3 + [(10, 10, 1, False), (11, 11, 1, False), (12, 12, 1, False), (20, 1, 1, False)]
    rows += [(0, " ".join(["new", *texts[1]]))]
    got = near_dedup.near_duplicates(docs(rows), percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (1, 1), (1, 1), (10, 1), (11, 0), (12, 1), (20, 1)]


def test_exact_one_id_on_long_texts_with_copies(docs):
    """Texts of equal length that differ in their first bytes only."""
    tail = "q" * 3000
    rows = [(1, "a" + tail), (1, "b" + tail), (2, "a" + tail), (3, "b" + tail), (4, "b" + tail)]
    assert exact(docs, rows) == exact_brute(rows)


def test_near_null_ids_repeats_and_empty(docs):
    got = near_dedup.near_duplicates(docs([(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f")]))
    rows = sorted([(r.doc_id, r.component_id, r.kept) for r in got.collect()], key=str)
    assert rows == sorted([(None, None, True), (None, None, True), (4, 4, True), (4, 4, True), (5, 4, False)], key=str)
    assert near_dedup.near_duplicates(docs([])).count() == 0
