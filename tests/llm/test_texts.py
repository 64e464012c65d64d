import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
from attrix.llm import fingerprints, licenses, mixing, pii, quality
from attrix.llm.shared import pick
from pyspark.sql import functions as F


def pii_brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_match_patterns():
    rng = random.Random(2)
    for _ in range(30_000):
        alphabet = rng.choice(["a@.-1", "0123456789 -", "+1 ().-2", "1.25", "ab@.c é٣1."])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == pii_brute(text), text


def test_own_spans():
    text = "see ftp://bob:pw1@host.org password=abc12345 Token: 'deadbeef99' iban GB82 WEST 1234 5698 7654 32 ssn 078-05-1120 password=letters_only"
    got = [(k, text[a:b]) for k, a, b in pii.find_spans(text) if k in pii.OWN_KINDS]
    assert got == [("login", "bob:pw1"), ("secret", "abc12345"), ("secret", "deadbeef99"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "078-05-1120")]


def emails_from_signs(text):
    """The email pattern from each at-sign, as it goes over a long run of letters once a start."""
    past, out = 0, []
    for at in (m.start() for m in re.finditer("@", text)):
        start = at
        while start > past and re.match(r"[A-Za-z0-9._%+-]", text[start - 1]):
            start -= 1
        if start < at and (m := re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match(text, at + 1)):
            out.append(("email", start, m.end()))
            past = m.end()
    return out


def test_pii_on_runs_of_cues_takes_linear_time():
    began = time.process_time()
    for text in ("token=" * 170_000, "password" * 120_000, "://a:" * 200_000, "+1" * 400_000, "iban " * 200_000, "a@" * 400_000):
        pii.find_spans(text)
    assert time.process_time() - began < 30
    assert [s for s in pii.find_spans("token=" * 9 + " abcd1234") if s[0] == "secret"] == [("secret", 55, 63)]


def test_pii_operator(docs, corpus):
    rows = [*corpus, (None, "x@y.zz"), (0, corpus[0][1])]
    got = pii.digest(pii.personal_data(docs(rows))).collect()
    want = []
    for r in rows:
        text = r[1] or ""
        plain = re.sub("x{9,}", lambda m: "_" * len(m[0]), text)  # not the slow pattern on a long run
        base = emails_from_signs(text) + [s for s in pii_brute(plain.replace("_", " ")) if s[0] != "email"]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((r[0], sum(s[0] == "email" for s in base), sum(s[0] == "card" for s in base), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_email, r.n_card, r.base_sha256) for r in got], key=str) == sorted(want, key=str)
    assert pii.personal_data(docs([])).count() == 0


def license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_base_phrases_match_brute_force():
    rng = random.Random(1)
    words = "gnu general public license apache cc by mit License İ k x under the 4 0 version".split()
    s = licenses.scanner()
    for _ in range(20_000):
        text = rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        n, base, _ = s.scan(text.encode())
        assert (n, sorted((w, s.labels[p]) for w, p in base)) == license_brute(text), text


def test_matching_statistics_match_brute_force():
    """Longest run known that ends at each word, and all places where it stands in a statement."""
    rng = random.Random(6)
    for _ in range(400):
        alphabet = "abcd"[: rng.randint(1, 4)]
        statements = [tuple(rng.choice(alphabet).encode() for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 5))]
        a = licenses.Automaton(statements)
        words = [rng.choice([*a.vocabulary.values(), -1]) for _ in range(rng.randint(0, 15))]
        got = list(a.statistics(words))
        assert [g[0] for g in got] == list(range(len(words)))
        for i, length, state in got:
            best, places = 0, set()
            for n, s in enumerate(a.statements):
                for end in range(len(s)):
                    k = 0
                    while k <= end and k <= i and s[end - k] == words[i - k]:
                        k += 1
                    if k > best:
                        best, places = k, set()
                    if k == best and k:
                        places.add((n, end))
            assert length == best and (not best or a.ends[state] == places), (statements, words, i)


def test_license_operator(docs):
    text = "Permission is hereby granted, free of charge, to any oddperson obtaining a copy of this software. Released under the MIT License."
    got = licenses.digest(licenses.scan_licenses(docs([(1, text), (2, "is the of"), (3, None), (None, "CC BY-SA 4.0"), (1, "")]))).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    one = by[1, 21]
    assert (one.n_base, one.first_word, one.last_word, one.base_labels, one.labels, one.score) == (1, 19, 19, "mit", "mit,mit-notice,mit-text", 1.0)
    assert (by[2, 3].n_base, by[2, 3].first_word, by[2, 3].labels, by[2, 3].score) == (0, None, "", 0.0)
    assert by[3, 0].n_words == by[1, 0].n_words == 0 and by[None, 5].base_labels == "cc-by"
    assert licenses.scan_licenses(docs([])).count() == 0


def test_license_templates_of_any_length(docs):
    """A whole text given as a template is found with edits, a half of it isn't."""
    words = [f"term{i}" if i % 3 else "the" for i in range(900)]
    text = " ".join(words)
    edited = " ".join("changed" if i % 90 == 4 else w for i, w in enumerate(words))
    rows = [(1, "Start. " + text.upper()), (2, edited), (3, " ".join(words[:400])), (4, "all rights reserved")]
    got = licenses.digest(licenses.scan_licenses(docs(rows), templates={text.title(): "whole", "All rights, reserved!": "own"})).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].labels for i in (1, 2, 3, 4)] == ["whole", "whole", "", "own"]
    assert by[1].score == 1.0 and by[2].score == 890 / 900 and by[3].score == 0.0


def test_license_chains_of_many_mentions():
    """Work grows with the mentions, not with their square."""
    text = b"released under the mit license and so on and on; " * 40_000
    began = time.process_time()
    n, base, chains = licenses.scanner().scan(text)
    took = time.process_time() - began
    assert n == 400_000 and len(base) == 40_000
    whole = [c for c in chains if c[3] == 1.0]
    assert [c[1] for c in whole] == [10 * i for i in range(40_000)]
    assert took < 20


def test_quality_scores_row_by_row(spark, docs):
    """The zstandard library on pieces of each text, and the logistic curve, one text at a time."""
    import zstandard

    rows, labels = labelled(240)
    frame = docs([*rows, (999, ""), (998, "é漢 " * 500)])
    model = quality.fit_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    tools = []
    for raw in (model.good, model.bad):
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == bytes.fromhex("37a430ec") else zstandard.DICT_TYPE_RAWCONTENT
        made = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        tools.append(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
    text = {**dict(rows), 999: "", 998: "é漢 " * 500}
    for r in quality.score_documents(frame, model).collect():
        data = text[r.doc_id].encode()
        pieces = [data[i : i + quality.PIECE_BYTES] for i in range(0, len(data), quality.PIECE_BYTES)]
        good, bad = (sum(len(t.compress(p)) for p in pieces) for t in tools)
        rate = (bad - good + model.prior * quality.PRIOR_BYTES) / (len(data) + quality.PRIOR_BYTES)
        assert abs(r.score - 1 / (1 + np.exp(-(model.slope * rate + model.shift)))) < 1e-9


def generalised(a, b):
    a, b = (collections.Counter(t.lower().split()) for t in (a, b))
    words = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words) if words else 1.0


def test_fingerprints(docs, corpus):
    rows = sorted((r[0], r[1] or "") for r in corpus)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs([*corpus, (None, "last"), (None, "last")])).collect() if r.doc_id is not None}
    errors, prints = [], collections.defaultdict(set)
    for (id_, text), (_, after) in zip(rows, [*rows[1:], (None, "last")]):
        r, half = got[id_], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - generalised(text, edited), r.near_next - generalised(text, after)]
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_fingerprints_of_rows_without_ids_divide_among_ranges(spark, docs):
    """A third of the rows has no id, some of them one text: no range gets them all, and the chain stays whole."""
    rows = [(i, f"word{i} and more") for i in range(400)] + [(None, f"lone {i % 60}") for i in range(200)]
    base = pick(docs(rows), doc_id="doc_id", text="text").selectExpr("coalesce(doc_id, 9223372036854775807) AS place", "pmod(xxhash64(text, monotonically_increasing_id()), 1073741824) AS draw")
    parts = [r["count"] for r in fingerprints._ranged(base).groupBy("part").count().collect()]
    assert sum(parts) == 600 and max(parts) < 40
    got = fingerprints.compare_with_next(docs(rows)).collect()
    assert len(got) == 600
    named = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in range(399):
        text, after = rows[i][1], rows[i + 1][1]
        half = len(text) // 2
        assert named[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_ranges_keep_the_order_of_places(spark):
    rows = [(p, d) for p in [-5, 0, 7, 7, 7, 7, 7, 7, 2**53, 2**53 + 1, 2**62, 2**62 + 1, 2**63 - 1] * 6 for d in (0, 2**28, 2**29, 2**30 - 1)]
    table = spark.createDataFrame(rows, "place long, draw long")
    got = sorted((r.place, r.draw, r.part) for r in fingerprints._ranged(table).collect())
    assert [r[2] for r in got] == sorted(r[2] for r in got) and len({r[2] for r in got if r[0] == 7}) > 1


def test_fingerprints_alone_and_empty(docs):
    (r,) = fingerprints.compare_with_next(docs([(5, "a b c d")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    (r,) = fingerprints.compare_with_next(docs([(None, None)])).collect()
    assert (r.n_chars, r.near_edited, r.near_next) == (0, 1.0, 1.0)
    assert fingerprints.compare_with_next(docs([])).count() == 0


def test_gamma_quantiles():
    x = np.array([0.001, 0.5, 2.0, 9.0])
    assert np.allclose(fingerprints.gamma_quantiles(1 - (1 + x) * np.exp(-x)), x, rtol=1e-6)


def test_mixing_meets_targets_and_repeats(docs):
    rows = [(i, "w" * 100, "hot" if i % 3 else "cold") for i in range(3000)] + [(None, "n" * 100, None), (9000, None, "void"), (9001, "", None)]
    weights = {"hot": 1.0, "cold": 3.0, None: 0.001}
    first = mixing.mix_sources(docs(rows), weights).collect()
    again = mixing.mix_sources(docs(rows), weights).collect()
    key = sorted((str(r.doc_id), r.mix_copy, r.mix_key) for r in first)
    assert key == sorted((str(r.doc_id), r.mix_copy, r.mix_key) for r in again)
    n = collections.Counter(r.source for r in first)
    assert abs(n["cold"] / (n["hot"] + n["cold"]) - 0.75) < 0.03 and abs(sum(n.values()) - 3001) < 200
    copies = collections.Counter(r.doc_id for r in first if r.source == "cold")
    counts = np.array([copies.get(i, 0) for i in range(0, 3000, 3)])
    assert abs(counts.var() / counts.mean() - 1) < 0.15  # Poisson: variance = mean
    assert mixing.mix_sources(docs([])).count() == 0


def test_mixing_rows_without_ids_draw_each_on_its_own(spark, docs):
    rows = [(None, f"text {i % 150}", "hot") for i in range(600)] + [(i, "c" * 8, "cold") for i in range(300)]
    mixed = mixing.mix_sources(docs(rows), {"hot": 2.0, "cold": 1.0})
    got = mixed.withColumn("part", F.spark_partition_id()).collect()
    hot = [r for r in got if r.source == "hot"]
    copies = collections.Counter(r.mix_copy for r in hot)
    rate = hot[0].mix_rate
    assert abs(len(hot) - 600 * rate) < 4 * (600 * rate) ** 0.5
    assert abs(copies[1] / 600 - (1 - np.exp(-rate))) < 0.1  # not all rows draw the same
    assert max(collections.Counter(r.part for r in hot).values()) < len(hot) / 3


def test_mixing_columns_that_differ_in_case_only(spark):
    table = spark.createDataFrame([(1, "b" * 9, "s", 2, "c"), (2, "b" * 9, "t", 3, "d")], "doc_id long, text string, source string, DOC_ID int, SOURCE string")
    mixed = mixing.mix_sources(table, {"s": 1.0, "t": 1.0}, size=50)
    assert mixed.columns == [*table.columns, "mix_rate", "mix_copy", "mix_key"]
    got = mixed.collect()
    assert {(r[0], r[2], r[3], r[4]) for r in got} == {(1, "s", 2, "c"), (2, "t", 3, "d")} and 50 < len(got) < 160


def test_mixing_large_means(docs):
    rows = [(i, "w" * 10, "big") for i in range(400)] + [(1000, "w" * 10, "tiny")]
    got = collections.Counter(r.source for r in mixing.mix_sources(docs(rows), {"big": 1.0, "tiny": 1.0}).collect())
    assert abs(got["tiny"] - 200) < 60 and abs(got["big"] - 200) < 60


def test_poisson_inverse(spark):
    rows = spark.createDataFrame([(0.1353, 2.0), (0.1354, 2.0), (0.40601, 2.0), (0.999999, 0.0), (0.5, 32.0)], "u double, m double")
    assert [r[0] for r in rows.select(mixing.poisson_inverse(F.col("u"), F.col("m"))).collect()] == [0, 1, 2, 0, 32]


def labelled(n):
    rng = random.Random(4)
    good = ["the", "garden", "was", "quiet", "and", "old", "trees", "stood", "by", "river", "green", "hill"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(60)]
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality_separates_held_out_texts(spark, docs):
    rows, labels = labelled(240)
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 0)], "doc_id long, quality int")
    frame = docs([*rows, (None, None), (999, ""), (0, rows[0][1])])
    model = quality.fit_quality(frame, table)
    got = quality.score_documents(frame, model).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = {r.doc_id: r for r in got if r.held_out}
    assert set(held) == {i for i in [*range(240), 999] if zlib.crc32(str(i).encode()) % 4 == 2}
    label = dict(labels)
    assert all(r.predicted == label[i] for i, r in held.items() if i in label)


def test_quality_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs([(1, "a")]), empty)
    assert [r.score for r in quality.score_documents(docs([(1, "a")]), model).collect()] == [1.0]
    assert quality.score_documents(docs([]), model).count() == 0
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert quality.fit_quality(docs([(i, "a b") for i in range(20)]), ones).constant == 1.0
