"""Licence scans with a generalised suffix automaton.

The automaton is built over the words of all base phrases and statements.  A
text's words are streamed through it, which gives at each word the longest
run that ends there and stands in some statement (matching statistics).  Runs
that can't be extended to the right are the matches.  Matches of one
statement in its own order, close to one another, are chained; a chain that
covers enough of the statement gives its label.

A base phrase stands wherever the state's strings end with it: each state
holds the phrases on its chain of suffix links.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm import flat
from attrix.llm.shared import pick, ship_code

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Statements of public licences and the labels of the method's own.
STATEMENTS = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "released under the mit license": "mit-notice",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-text",
    "you may not use this file except in compliance with the license": "apache-text",
}
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a match, of a gap within a chain, and the covered share that gives a label.
MIN_MATCH, MAX_GAP, COVERED = 2, 3, 0.8


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, statements: list[tuple[bytes, ...]]):
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.statements = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for s in statements]
        for words in self.statements:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # where each state's strings end, in (statement, place of the last word)
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.go]
        for n, words in enumerate(self.statements):
            at = 0
            for i, w in enumerate(words):
                at = up = self.go[at][w]
                while up > 0:
                    self.ends[up].add((n, i))
                    up = self.link[up]

    def _copy(self, state: int, size: int) -> int:
        self.go.append(dict(self.go[state]))
        self.link.append(self.link[state])
        self.size.append(size)
        return len(self.go) - 1

    def _redirect(self, p: int, w: int, q: int) -> int:
        """A state for exactly the strings of p extended by w."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._copy(q, self.size[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.go[last]:  # known from an earlier statement
            return self._redirect(last, w, self.go[last][w])
        self.go.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        new, p = len(self.go) - 1, last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._redirect(p, w, self.go[p][w])
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) of the longest run known that ends at each word; -1 is a stranger."""
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.go[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.go[state]:
                state, length = self.go[state][w], length + 1
            else:
                state = length = 0
            yield i, length, state


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        texts = [tuple(WORD.findall(t.encode().lower())) for t in [*BASE, *(t for t, _ in templates)]]
        self.labels = [*BASE.values(), *(label for _, label in templates)]
        self.automaton = a = Automaton(texts)
        self.sizes = [len(t) for t in texts]
        #: By state, the base phrases (size, number) that its strings may end with.
        self.base: list[list[tuple[int, int]]] = [[] for _ in a.go]
        for n in range(len(BASE)):
            at = 0
            for w in a.statements[n]:
                at = a.go[at][w]
            self.base[at].append((self.sizes[n], n))
        for state in sorted(range(1, len(a.go)), key=a.size.__getitem__):
            self.base[state] = self.base[state] + self.base[a.link[state]]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Words, base places (first word, phrase) and chains (statement, first word, end word, covered share)."""
        words = WORD.findall(text.lower())
        known = self.automaton.vocabulary
        # runs of known words: the automaton is in its start state anywhere else
        base, matches, run, begin = [], [], [], 0
        for i, w in enumerate([known.get(w, -1) for w in words] + [-1]):
            if w >= 0:
                if not run:
                    begin = i
                run.append(w)
            elif run:
                if len(run) >= MIN_MATCH:
                    self._run(run, begin, base, matches)
                run = []
        return len(words), base, self._chains(matches)

    def _run(self, run: list[int], begin: int, base: list, matches: list) -> None:
        before = (0, 0, 0)
        for at in [*self.automaton.statistics(run), (len(run), 0, 0)]:
            i, length, state = at
            base += [(begin + i - size + 1, n) for size, n in self.base[state] if size <= length]
            if length <= before[1] and before[1] >= MIN_MATCH:  # the run before ended there
                j, size, of = before
                matches += [(n, begin + j - size + 1, end - size + 1, size) for n, end in self.automaton.ends[of] if n >= len(BASE)]
            before = at

    def _chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Matches (statement, word, place in it, words) to chains of one statement."""
        chains, open_, of = [], [], -1
        for n, at, place, size in sorted(matches):
            # matches come by place: a chain that ended too far back can't go on
            open_ = [k for k in open_ if k[2] + MAX_GAP >= at] if n == of else []
            of = n
            for k in sorted(open_, key=lambda k: -k[4]):
                # the most covered chain that this match goes on
                if k[2] <= at <= k[2] + MAX_GAP and k[3] <= place <= k[3] + MAX_GAP:
                    k[2], k[3], k[4] = at + size, place + size, k[4] + size
                    break
            else:
                open_.append([n, at, at + size, place + size, size])
                chains.append(open_[-1])
        out = [(n, first, end, covered / self.sizes[n]) for n, first, end, _, covered in chains if covered >= MIN_MATCH]
        return sorted(out)


@functools.cache
def scanner(templates: tuple[tuple[str, str], ...] = tuple(STATEMENTS.items())) -> Scanner:
    return Scanner(templates)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = STATEMENTS) -> DataFrame:
    """One row per input row: doc_id, n_words, base and spans.

    ``base`` has (word, label) for each place of a base phrase, ``spans`` has
    (start, end, label, covered) for each chain over half of a statement, in
    words from 0, ends exclusive.  ``templates`` has the statements, or whole
    licence texts, and their labels; it goes to every worker.  Null and empty texts have no words.  Ids are passed
    through (null, repeated); an empty table gives an empty result; other
    columns are ignored.
    """
    ship_code(docs.sparkSession)
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    listed = tuple(templates.items())
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(listed)
        for part in (p for batch in batches for p in flat.byte_slices(batch)):
            found = [s.scan((t.as_py() or "").encode()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"word": w, "label": s.labels[n]} for w, n in sorted(f[1])] for f in found], pa.list_(place)),
                    pa.array([[{"start": a, "end": b, "label": s.labels[n], "covered": c} for n, a, b, c in f[2] if c > 0.5] for f in found], pa.list_(span)),
                ],
                ["doc_id", "n_words", "base", "spans"],
            )

    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(run, f"doc_id {kind}, n_words long, base array<struct<word: long, label: string>>, spans array<struct<start: long, end: long, label: string, covered: double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, first and last base word, labels, and the score: 1 with a base phrase, else the best covered share."""

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base_labels = F.transform("base", lambda b: b["label"])
    own = F.transform(F.filter("spans", lambda s: s["covered"] >= COVERED), lambda s: s["label"])
    covered = F.array_max(F.transform("spans", lambda s: s["covered"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["word"])).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce(covered, F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
