"""Spelling variants: words that differ by one edit, found by k-d trees over letter counts.

One inserted letter changes a word's vector of letter counts by +1 in one
place, one replaced letter by +1 and -1: an L1 distance of at most two.  So
the near words of a word lie in a small box around its vector, and a pair of
lengths (L, L) or (L, L + 1) is searched at a time.

Words are counted in Spark (a partial count before the only shuffle of
occurrences).  The vocabulary is then cut into regions by shallow k-d trees,
one a length, whose cuts come from a bounded sample (``SAMPLE``): the sample
places the cuts only, every word gets its region by them.  A word goes to its
own region as a point and, as a visitor, to each further region whose box its
own box meets.  The task of a region builds a k-d tree over its points, prunes
nodes by their boxes and checks the order of the letters of what is left.  A
region whose points can't be cut, as all have the same counts, is dealt out in
blocks that its words visit one by one.

Near pairs leave a task as partial aggregates (count and best) of each word,
never as lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrix.llm.shared import materialize, pick, ship_code

MIN_CHARS = 7
MIN_COUNT = 2
#: A form occurs at least so many times as often as its variant.
FORM_FACTOR = 10
#: One in so many runs, by its checksum, loses a letter.
NOISE = 31
#: So many words place the cuts of the regions; the regions of longer words are blocks by hash.
SAMPLE, SAMPLE_CHARS = 1 << 16, 64
REGION_WORDS = 1 << 13
MAX_REGIONS = 1 << 12
LEAF = 128
BLOCK = 1 << 14
#: Letters a to z, and six cells that the others share.
DIMS = 32
#: Counts are cut off here: one edit still changes them by one at most.
MAX_LETTERS = 1000

_CELL = np.array([b - 97 if 97 <= b < 123 else 26 + b % 6 for b in range(256)])


# ---------------------------------------------------------------- words
def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: distinct words of MIN_CHARS letters and MIN_COUNT occurrences at least.

    A run shorter than MIN_CHARS can't become a word, so the pattern passes
    over it.  A null text has no words; a null id counts as empty in the checksum.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{MIN_CHARS},}}"), F.lit(0))
    runs = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select(lower_ascii(F.col("run")).alias("run"), F.crc32(F.encode(F.concat("id", F.lit(":"), lower_ascii(F.col("run"))), "UTF-8")).alias("h"))
    place = F.pmod("h", F.length("run").cast("long")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.select(F.when(F.pmod("h", F.lit(NOISE)) == 0, less).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- vectors and boxes
def letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each (all are below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), length)


def vectors(rows: np.ndarray) -> np.ndarray:
    """Letter counts of each row of code points."""
    n, length = rows.shape
    out = np.empty((n, DIMS), dtype=np.float32)
    step = max(1, (1 << 22) // max(length, 1))
    for i in range(0, n, step):
        part = _CELL[rows[i : i + step]] + (np.arange(min(step, n - i)) * DIMS)[:, None]
        counts = np.bincount(part.ravel(), minlength=min(step, n - i) * DIMS)
        out[i : i + step] = np.minimum(counts, MAX_LETTERS).reshape(-1, DIMS)
    return out


def meets(points_low: np.ndarray, points_high: np.ndarray, q: np.ndarray, down: int) -> np.ndarray:
    """Whether a word that is one letter up and ``down`` letters down from q can lie in the box."""
    above = np.maximum(points_low - q, 0).sum(axis=1)
    below = np.maximum(q - points_high, 0).sum(axis=1)
    return (above <= 1) & (below <= down)


class KdTree:
    """Points in the order of a k-d tree; each node has a slice of them and its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, np.ndarray, np.ndarray, int, int]] = []
        self.cuts: list[tuple[int, float]] = []
        if len(points):
            self._grow(points, 0, len(points), leaf)

    def _grow(self, points: np.ndarray, a: int, b: int, leaf: int) -> int:
        mine = points[self.order[a:b]]
        low, high = mine.min(axis=0), mine.max(axis=0)
        node = len(self.nodes)
        self.nodes.append((a, b, low, high, -1, -1))
        self.cuts.append((-1, 0.0))
        if b - a <= leaf or (low == high).all():
            return node
        dim = int(np.argmax(mine.var(axis=0)))
        values = mine[:, dim]
        cut = float(np.median(values))
        if cut >= high[dim]:  # the median is the largest value
            cut = float(values[values < high[dim]].max())
        left = values <= cut
        self.order[a:b] = np.concatenate((self.order[a:b][left], self.order[a:b][~left]))
        m = a + int(left.sum())
        children = self._grow(points, a, m, leaf), self._grow(points, m, b, leaf)
        self.nodes[node] = (a, b, low, high, *children)
        self.cuts[node] = (dim, cut)
        return node


def close_vectors(tree: KdTree, points: np.ndarray, queries: np.ndarray, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, point) whose vectors differ by one letter up and at most ``down`` letters down.

    The points are one letter longer than the queries if ``down`` is 0 and of
    the same length if it is 1.  So the squared distance is 1, or at most 2.
    """
    if not len(points) or not len(queries):
        return
    sorted_points = points[tree.order]
    p_norm, q_norm = (sorted_points**2).sum(axis=1), (queries**2).sum(axis=1)
    stack = [(0, np.arange(len(queries)))]
    while stack:
        node, active = stack.pop()
        a, b, low, high, left, right = tree.nodes[node]
        active = active[meets(low, high, queries[active], down)]
        if not len(active):
            continue
        if left >= 0:
            stack += [(left, active), (right, active)]
            continue
        for i in range(0, len(active), BLOCK):
            some = active[i : i + BLOCK]
            for j in range(a, b, LEAF):  # points with equal vectors can be more than a leaf
                k = min(j + LEAF, b)
                far = q_norm[some, None] + p_norm[None, j:k] - 2 * (queries[some] @ sorted_points[j:k].T)
                q, p = np.nonzero(far <= (2 if down else 1))
                if len(q):
                    yield some[q], tree.order[j + p]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether each long row is the short one with one letter more."""
    n, length = short.shape
    same = np.ones((n, length + 1), dtype=bool)
    same[:, :length] = short == long[:, :-1]
    same[:, length] = False
    head = np.argmin(same, axis=1)
    same[:, 0] = False
    same[:, 1:] = short == long[:, 1:]
    tail = np.argmin(same[:, ::-1], axis=1)
    return head + tail >= length


# ---------------------------------------------------------------- regions
class Regions:
    """For each length, the leaves of a k-d tree over a sample; each has one number, or one a block.

    Regions tile the space: a word is in the leaf that the cuts lead to, even
    if it lies outside the box of the sample's words there.  So the boxes are
    those of the cuts, not of the sample.
    """

    def __init__(self, sample: list[str], sizes: dict[int, int]):
        self.by_length: dict[int, tuple[KdTree, dict[int, int], np.ndarray, np.ndarray, np.ndarray]] = {}
        self.first: dict[int, int] = {}
        by: dict[int, list[str]] = {}
        for w in sample:
            by.setdefault(len(w), []).append(w)
        total = sum(sizes.values())
        target = max(REGION_WORDS, -(-total // MAX_REGIONS))
        number = 0
        for length in sorted(sizes):
            words = by.get(length, [])
            points = vectors(letters(words, length)) if words else np.zeros((0, DIMS), np.float32)
            share = sizes[length] / max(len(words), 1)
            tree = KdTree(points, max(1, int(target / share))) if words else None
            lows, highs, starts, leaf_of = [], [], [], {}
            stack = [(0, np.zeros(DIMS, np.float32), np.full(DIMS, np.inf, np.float32))]
            while stack:
                node, low, high = stack.pop()
                a, b, _, _, left, right = tree.nodes[node] if tree else (0, sizes[length], None, None, -1, -1)
                if left >= 0:
                    dim, cut = tree.cuts[node]
                    lower, upper = low.copy(), high.copy()
                    upper[dim], lower[dim] = np.floor(cut), np.floor(cut) + 1
                    stack += [(left, low, upper), (right, lower, high)]
                    continue
                blocks = max(1, round((b - a) * share / (2 * target))) if tree else -(-sizes[length] // target)
                leaf_of[node] = len(starts)
                starts.append((number, blocks))
                lows.append(low)
                highs.append(high)
                number += blocks
            self.by_length[length] = tree, leaf_of, np.array(starts), np.array(lows), np.array(highs)
        self.count = number

    def home(self, length: int, q: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The region of each word."""
        tree, leaf_of, starts, _, _ = self.by_length[length]
        at = np.zeros(len(q), dtype=int)
        if tree:
            stack = [(0, np.arange(len(q)))]
            while stack:
                node, some = stack.pop()
                left, right = tree.nodes[node][4:]
                if left < 0:
                    at[some] = leaf_of[node]
                    continue
                dim, cut = tree.cuts[node]
                under = q[some, dim] <= np.floor(cut)
                stack += [(left, some[under]), (right, some[~under])]
        return starts[at, 0] + salt % starts[at, 1]

    def visits(self, length: int, q: np.ndarray, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(region, words) of the given length's regions that the words' boxes meet."""
        if length not in self.by_length:
            return
        _, _, starts, lows, highs = self.by_length[length]
        for (first, blocks), low, high in zip(starts.tolist(), lows, highs):
            some = np.flatnonzero(meets(low, high, q, down))
            if len(some):
                for k in range(first, first + blocks):
                    yield k, some


POINT, SAME, SHORTER = 0, 1, 2
_ROUTED = T.StructType([T.StructField("region", T.IntegerType()), T.StructField("role", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
_FOUND = T.StructType([T.StructField("word", T.StringType()), T.StructField("near", T.LongType()), T.StructField("best_n", T.LongType()), T.StructField("best", T.StringType())])


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(sizes).tolist():
        yield length, np.flatnonzero(sizes == length)


def _route(regions: Regions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, salt = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            for length, rows in _by_length(words):
                step = max(1, (1 << 24) // length)
                for i in range(0, len(rows), step):
                    some = rows[i : i + step]
                    q = vectors(letters([words[k] for k in some], length))
                    home = regions.home(length, q, salt[some])
                    out = [(home, POINT, some)]
                    for region, who in regions.visits(length, q, 1):
                        later = who[home[who] < region]  # each pair of regions is searched once
                        out.append((np.full(len(later), region), SAME, some[later]))
                    for region, who in regions.visits(length + 1, q, 0):
                        out.append((np.full(len(who), region), SHORTER, some[who]))
                    for region, role, who in out:
                        if len(who):
                            chosen = batch.take(pa.array(who))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(region, pa.int32()), pa.array(np.full(len(who), role), pa.int32()), chosen.column(0), chosen.column(1)], names=_ROUTED.names
                            )

    return run


def near_pairs(points: list[str], same: list[str], shorter: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Near pairs of a region as (which, left, right), a block at a time.

    ``which`` is "points" for two points (each pair once), "same" and
    "shorter" for a visitor (left) and a point (right).  All points have one
    length, which ``same`` has too; ``shorter`` have one letter less.
    """
    if not points:
        return
    length = len(points[0])
    rows = letters(points, length)
    vecs = vectors(rows)
    tree = KdTree(vecs)
    for which, words, down in (("points", points, 1), ("same", same, 1), ("shorter", shorter, 0)):
        if not words:
            continue
        own = rows if which == "points" else letters(words, length if down else length - 1)
        check = one_replaced if down else one_inserted
        for q, p in close_vectors(tree, vecs, vecs if which == "points" else vectors(own), down):
            if which == "points":
                once = q < p
                q, p = q[once], p[once]
            step = max(1, (1 << 24) // length)
            for i in range(0, len(q), step):
                a, b = q[i : i + step], p[i : i + step]
                good = check(own[a], rows[b])
                if good.any():
                    yield which, a[good], b[good]


class _Best:
    """Count, largest n and smallest word of that n among the near words of each of some words."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.near = np.zeros(len(words), np.int64)
        self.best_n = np.zeros(len(words), np.int64)
        self.best: list[str | None] = [None] * len(words)

    def add(self, mine: np.ndarray, other: _Best, theirs: np.ndarray) -> None:
        np.add.at(self.near, mine, 1)
        counts = other.n[theirs]
        top = self.best_n.copy()
        np.maximum.at(top, mine, counts)
        for i in np.flatnonzero(counts == top[mine]).tolist():
            k, word, c = mine[i], other.words[theirs[i]], counts[i]
            if c > self.best_n[k] or self.best[k] is None or word < self.best[k]:
                self.best_n[k], self.best[k] = c, word


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    table = pa.Table.from_batches(parts)
    role = table.column("role").to_numpy()
    groups = []
    for r in (POINT, SAME, SHORTER):
        mine = table.take(pa.array(np.flatnonzero(role == r)))
        groups.append(_Best(mine.column("word").to_pylist(), mine.column("n").to_numpy()))
    point, same, shorter = groups
    of = {"points": point, "same": same, "shorter": shorter}
    for which, a, b in near_pairs(point.words, same.words, shorter.words):
        of[which].add(a, point, b)
        point.add(b, of[which], a)
    for g in groups:
        some = np.flatnonzero(g.near).tolist()
        for i in range(0, len(some), BLOCK):
            k = some[i : i + BLOCK]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g.words[j] for j in k], pa.string()), pa.array(g.near[k]), pa.array(g.best_n[k]), pa.array([g.best[j] for j in k], pa.string())], names=_FOUND.names
            )


def near_words(words: DataFrame) -> DataFrame:
    """word, near, best_n, best of the words (word, n) that have a near word; ``words`` is read three times."""
    ship_code(words.sparkSession)
    # one row a length that occurs: k lengths need k * k / 2 letters of different words, so they are few
    sizes = {r[0]: r[1] for r in words.groupBy(F.length("word").alias("size")).count().collect()}
    sample = [r[0] for r in words.filter(F.length("word") <= SAMPLE_CHARS).select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    regions = Regions(sample, sizes)
    routed = words.select("word", "n", F.pmod(F.xxhash64(F.reverse("word")), F.lit(1 << 30)).alias("salt")).mapInArrow(_route(regions), _ROUTED)
    found = routed.groupBy("region").applyInArrow(_search, _FOUND)
    # -n first, so that the least is the most frequent and then the first by code points
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best")
    merged = found.groupBy("word").agg(F.sum("near").alias("near"), best)
    return merged.select("word", "near", (-F.col("best.minus")).alias("best_n"), F.col("best.word").alias("best"))


# ---------------------------------------------------------------- forms
def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FORM_FACTOR) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word (one letter inserted, deleted or replaced) with
    the largest n, of equal n the first by code points, if that n is at least
    ``factor`` times the word's; else null, as ``form_n``.  ``root`` is where
    the forms lead, the word itself without a form.  Rows without an id or
    that repeat count as they stand; a null text has no words; an empty table
    gives an empty result; other columns are ignored.
    """
    words = materialize(count_words(docs, id_col, text_col), "spelling-words")
    near = near_words(words).withColumnRenamed("word", "near_word")
    fits = F.col("best_n") >= F.col("n") * factor
    forms = words.join(near, F.col("word") == F.col("near_word"), "left").select(
        "word",
        "n",
        F.coalesce("near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best")).alias("form"),
        F.when(fits, F.col("best_n")).alias("form_n"),
    )
    forms = materialize(forms, "spelling-forms")
    tops = _roots(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("top"))).withColumnRenamed("word", "of")
    return forms.join(tops, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, top: where chains of links end.  n grows by the factor at each
    link, so a chain has at most 19 of them, and each round halves it."""
    links = materialize(links, "spelling-links")
    while True:
        above = links.select(F.col("word").alias("w"), F.col("top").alias("next"))
        further = links.join(above, F.col("top") == F.col("w"), "left").select("word", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved"))
        further = materialize(further, "spelling-links")
        if not further.filter("moved").limit(1).count():
            return further.select("word", "top")
        links = further.select("word", "top")


_BITS = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
SQL = f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, {_BITS} FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents
), counted AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL
), coded AS (
  SELECT run, n, [unicode(x) FOR x IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')] AS u FROM counted
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([CASE WHEN x < 128 THEN [CAST(x AS BIGINT)] ELSE [CAST(192 + x // 64 AS BIGINT), CAST(128 + x % 64 AS BIGINT)] END FOR x IN u])),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h
  FROM coded, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n FROM pairs GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n,
         CASE WHEN best_n >= 10 * v.n THEN (SELECT min(p.other) FROM pairs p WHERE p.word = v.word AND p.n = best_n) END AS form
  FROM v LEFT JOIN best USING (word)
), chain(word, top) AS (
  SELECT word, word FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.top = forms.word WHERE forms.form IS NOT NULL
), ends AS (SELECT chain.word, top FROM chain JOIN forms ON chain.top = forms.word WHERE form IS NULL)
SELECT forms.word, form, top AS root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
