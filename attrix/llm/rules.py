"""Quality rules: gradient-boosted trees over document statistics.

A task counts characters, words, lines and repeated word windows of its texts
with numpy, a few megabytes at a time.  Two fixed rules reject a document
outright (``base_failed``); for the others a model decides.  The model is a
sum of small trees fitted to labelled documents by Newton boosting on
histograms.  Its score never rises with the features of ``FALLING`` (symbols,
repeated lines, repeated words): a split that would break this is not taken,
and the values below a split on such a feature are kept apart by their middle.

Fitted trees are flattened into node arrays (feature, cut, left, right,
value); a leaf leads to itself, so a block of documents goes down all trees at
once in as many steps as they are deep.  The fit reads the statistics of a
bounded sample (``SAMPLE_ROWS`` labelled rows); everything else reads all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm import flat
from attrix.llm.quality import HELD_OUT, fold
from attrix.llm.shared import materialize, pick, ship_code

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, PULL, MIN_WEIGHT = 60, 4, 64, 0.2, 1.0, 5.0
THRESHOLD = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "marks", "foreign",
    "distinct_words", "words_a_line", "longest_word", "short_words", "ended_words",
)
#: The score never rises with these.
FALLING = ("symbols", "dup_lines", "repeat_words")

_BLANK, _UPPER, _LOWER, _DIGIT, _SYMBOL, _MARK, _LEAD, _INNER, _OTHER = range(9)
_KIND = np.full(256, _OTHER, dtype=np.int64)
_KIND[0x21:0x7F] = _MARK
_KIND[flat.SPACE] = _BLANK
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A] = _UPPER, _LOWER, _DIGIT
_KIND[list(SYMBOLS)] = _SYMBOL
_KIND[0x80:0xC0], _KIND[0xC0:] = _INNER, _LEAD
KINDS = 9


# ---------------------------------------------------------------- statistics
def repeated_words(word: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words found at least twice in it."""
    m = len(word) - WINDOW + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    window = word[:m]
    for k in range(1, WINDOW):  # numbers of pairs, so that equality stays exact
        window = pd.factorize(window * (word.max() + 1) + word[k : k + m])[0].astype(np.int64)
    whole = doc[:m] == doc[WINDOW - 1 :]
    window, at = window[whole], np.flatnonzero(whole)
    if not len(window):
        return np.zeros(n, np.int64)
    group = pd.factorize(doc[at] * (window.max() + 1) + window)[0]
    again = at[np.bincount(group)[group] > 1]
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)


def duplicate_lines(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and those of them that equal an earlier line of it."""
    n = len(off) - 1
    inside = body != 10
    starts, ends = flat.runs(inside, off)  # an empty line has no word, so it isn't needed
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    blanks = np.zeros(len(body) + 1, dtype=np.int32)
    np.cumsum(flat.SPACE[body], out=blanks[1:])
    worded = blanks[ends] - blanks[starts] < ends - starts
    doc = np.searchsorted(off, starts, "right") - 1
    line = flat.distinct(flat.spans(body, inside, starts, ends))[1]
    doc, line = doc[worded], line[worded]
    lines = np.bincount(doc, minlength=n)
    if not len(line):
        return lines, lines
    different = pd.unique(doc * (line.max() + 1) + line) // (line.max() + 1)
    return lines, lines - np.bincount(different, minlength=n)


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (texts x BASE) and the features (texts x FEATURES) of a column of texts."""
    body, off = flat.flat(column)
    n = len(off) - 1
    kinds = np.zeros(n * KINDS, dtype=np.int64)
    for a in range(0, len(body), flat.BLOCK):  # a very long text is read in blocks
        b = min(a + flat.BLOCK, len(body))
        owner = np.repeat(np.arange(n), np.diff(np.clip(off, a, b)))
        kinds += np.bincount(owner * KINDS + _KIND[body[a:b]], minlength=n * KINDS)
    kinds = kinds.reshape(n, KINDS)
    chars = kinds.sum(axis=1) - kinds[:, _BLANK] - kinds[:, _INNER]
    solid = ~flat.SPACE[body]
    starts, ends = flat.runs(solid, off)
    doc = np.searchsorted(off, starts, "right") - 1
    words = np.bincount(doc, minlength=n)
    word = flat.distinct(flat.spans(body, solid, starts, ends))[1]
    inner = np.zeros(len(body) + 1, dtype=np.int32)  # a string has less than 2**31 bytes
    np.cumsum((body & 0xC0) == 0x80, out=inner[1:])
    length = ends - starts - (inner[ends] - inner[starts])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    base_number = word.max(initial=0) + 1
    distinct = np.bincount(pd.unique(doc * base_number + word) // base_number, minlength=n)
    lines, dup_lines = duplicate_lines(body, off)
    repeats = repeated_words(word, doc, n)
    last = _KIND[body[ends - 1]]
    ended = np.bincount(doc[(last == _MARK) | (last == _SYMBOL)], minlength=n)
    short = np.bincount(doc[length <= 3], minlength=n)
    base = np.stack([words, chars, kinds[:, _SYMBOL], dup_lines, repeats], axis=1).astype(np.int64)
    w, c, ln = (np.maximum(x, 1).astype(float) for x in (words, chars, lines))
    features = [
        words, chars / w, kinds[:, _SYMBOL] / w, dup_lines / ln, repeats / w, kinds[:, _UPPER] / c, kinds[:, _DIGIT] / c,
        kinds[:, _MARK] / c, kinds[:, _LEAD] / c, distinct / w, words / ln, longest, short / w, ended / w,
    ]
    return base, np.stack(features, axis=1).astype(float)


def base_failed(base: np.ndarray) -> np.ndarray:
    words, repeats = base[:, 0], base[:, 4]
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


# ---------------------------------------------------------------- model
@dataclass(frozen=True)
class Trees:
    """Flattened trees: row t of each array has the nodes of tree t, the root first."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if not len(self.feature):
            return total
        row, tree = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(DEPTH):
            under = x[row, self.feature[tree, at]] <= self.cut[tree, at]
            at = np.where(under, self.left[tree, at], self.right[tree, at])
        return total + self.value[tree, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...], trees: int = TREES) -> Trees:
    """Boosted trees for the probability of y = 1; the margin never rises with the ``falling`` features."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    size = (1 << (DEPTH + 1)) - 1
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    margin = np.full(len(y), start)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(bins, cuts, y - p, np.maximum(p * (1 - p), 1e-12), falling, size)
        made.append(tree)
        margin += Trees(*(np.array([a]) for a in tree)).margin(x)
    arrays = [np.array([t[k] for t in made]) for k in range(5)] if made else [np.zeros((0, size))] * 5
    return Trees(*arrays, start=start)


def _grow(bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, bend: np.ndarray, falling: tuple[int, ...], size: int):
    """One tree, a level at a time, from histograms of slope and bend by (node, feature, bin)."""
    feature, cut = np.zeros(size, np.int64), np.zeros(size)
    left, right, value = np.arange(size), np.arange(size), np.zeros(size)
    low, high = np.full(size, -np.inf), np.full(size, np.inf)
    at = np.zeros(len(slope), np.int64)

    def weight(g, h, node):
        return np.clip(g / (h + PULL), low[node], high[node])

    value[0] = RATE * weight(slope.sum(), bend.sum(), 0)
    for level in range(DEPTH):
        first, width = (1 << level) - 1, 1 << level
        inside = (at >= first) & (at < first + width)
        best = {}
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            cell = (at[inside] - first) * BINS + bins[inside, f]
            g, h = (np.bincount(cell, v[inside], minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (slope, bend))
            for k in range(width):
                node = first + k
                gl, hl = g[k, : len(c)], h[k, : len(c)]
                gr, hr = g[k, -1] - gl, h[k, -1] - hl
                wl, wr, w = weight(gl, hl, node), weight(gr, hr, node), weight(g[k, -1], h[k, -1], node)
                # second-order gain of the (bounded) weights
                gain = (gl * wl - (hl + PULL) * wl**2 / 2) + (gr * wr - (hr + PULL) * wr**2 / 2) - (g[k, -1] * w - (h[k, -1] + PULL) * w**2 / 2)
                allowed = (hl >= MIN_WEIGHT) & (hr >= MIN_WEIGHT)
                if f in falling:
                    allowed &= wl >= wr
                gain = np.where(allowed, gain, 0.0)
                j = int(gain.argmax())
                if gain[j] > best.get(node, (1e-9,))[0]:
                    best[node] = (float(gain[j]), f, j, float(wl[j]), float(wr[j]))
        for node, (_, f, j, wl, wr) in best.items():
            a, b = 2 * node + 1, 2 * node + 2
            feature[node], cut[node], left[node], right[node] = f, cuts[f][j], a, b
            value[a], value[b] = RATE * wl, RATE * wr
            low[a] = low[b] = low[node]
            high[a] = high[b] = high[node]
            if f in falling:
                low[a] = high[b] = (wl + wr) / 2
            mine = at == node
            at[mine] = np.where(bins[mine, f] <= j, a, b)
    return feature, cut, left, right, value


# ---------------------------------------------------------------- Spark
def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on at most SAMPLE_ROWS labelled rows outside the held-out fold, chosen by hash.

    Of rows that repeat an id in ``labels`` the largest label counts; null ids
    and labels are left out.  Without both labels no tree is grown and the
    score is the share of label 1, or 1 without any label.
    """
    ship_code(docs.sparkSession)
    known = pick(labels, id=id_col, label=label_col).dropna().groupBy("id").agg(F.max("label").alias("label"))
    known = known.filter(fold(F.col("id")) != HELD_OUT).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    known = materialize(known, "rules-sample")  # a bounded list of ids, so the texts stay where they are
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    rows = rows.select("label", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.byte_slices(batch):
                _, x = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([pc.cast(part.column(0), pa.int64()), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["label", "place", "x"])

    got = rows.mapInArrow(run, "label long, place long, x array<double>").orderBy("place", "label").limit(SAMPLE_ROWS).collect()
    y = np.array([r["label"] for r in got], dtype=float)
    if not len(y) or y.min() == y.max():
        empty = fit_trees(np.zeros((0, len(FEATURES))), y, (), trees=0)
        return Trees(empty.feature, empty.cut, empty.left, empty.right, empty.value, 30.0 if not len(y) or y[0] else -30.0)
    return fit_trees(np.array([r["x"] for r in got]), y, tuple(FEATURES.index(f) for f in FALLING))


def apply_rules(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, the BASE counts, base_failed, score, kept.

    A null or empty text has no words, so it fails.  Ids are passed through
    (null, repeated), and equal texts get equal rows; an empty table gives an
    empty result; other columns are ignored.
    """
    ship_code(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.byte_slices(batch):
                base, x = statistics(part.column(1))
                failed, score = base_failed(base), model.score(x)
                columns = [part.column(0), *[pa.array(base[:, k]) for k in range(len(BASE))], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "score", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{b} long' for b in BASE)}, base_failed boolean, score double, kept boolean")
