"""Near-duplicate components by one-permutation MinHash.

1. Each text becomes its set of word shingles (64-bit hashes).  One hash range
   is cut into ``BANDS * rows`` equal bins, the smallest hash in each bin is
   the signature, and empty bins borrow by optimal densification: a bin's
   probe sequence, the same for all texts, is followed to the first full bin.
2. Texts with equal sets are one class; only its number goes on, so exact
   copies cost one row.
3. Bands of ``rows`` bins are bucket keys.  At a similarity of 0.85 six rows
   and 40 bands miss a pair with probability 6e-9, at 0.8 five rows 1e-7.
4. In each bucket one centre meets all the others: a star, so pairs grow with
   the members, not with their square.  The centre is the class that sits in
   the most and largest buckets, in a family of edited copies their original.
   Pairs are confirmed on the full sets.  A second star joins the members that
   are not in their first centre's component.
5. What stars can't see is a link of x and y when y isn't linked with their
   centre.  Let the core be the shingles that most members of the star have,
   and D(x) the difference of x and the core.  x and y are linked if and only
   if |D(x)| + |D(y)| - 2 |D(x) & D(y)| <= r (|x| + |y|) with
   r = (100 - p) / (100 + p), so with v(x) = |D(x)| - r |x| they share at least
   (v(x) + v(y)) / 2 differences.  If v(x) + v(y) <= 0 they are linked anyhow,
   and both with the member of the least v: a star of its own.  All other
   links share at least o = max(1, (v(x) + w) / 2) differences, w the least v
   of the possible partners; so in one order of the star's differences, rare
   ones first, the first |D| - o + 1 of x and of y have one in common.  A join
   on these finds all such pairs; they too are confirmed on the full sets.
   So no candidate of the buckets is lost.  Copies that differ from one text
   in ways of their own don't meet pair by pair, and neither do members whose
   common text the centre lacks or whose centre has text of its own.
6. Components come from repeated minimum labels with pointer jumping.

Nothing but row counts reaches the driver.  Hot buckets and centres meet in
equi-joins against one row per bucket or class, which AQE can split, and in
partial aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm import flat
from attrix.llm.shared import materialize, pick, ship_code

WORDS = 5
BANDS = 40
STAR_ROUNDS = 2


def rows_per_band(percent: int) -> int:
    """Largest band width that misses a pair at the threshold with less than 1e-6."""
    return max(r for r in range(1, 13) if (1 - (percent / 100) ** r) ** BANDS < 1e-6 or r == 1)


def signatures(sets: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation MinHash, a row per non-empty set."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    place = owner * bins + (((sets >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(sets), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    sig = np.zeros(n * bins, dtype=np.uint64)
    full = np.zeros(n * bins, dtype=bool)
    sig[place[first]], full[place[first]] = sets[first], True
    empty = np.flatnonzero(~full & np.repeat(np.diff(offsets) > 0, bins))
    dense, attempt = sig.copy(), 0
    while len(empty):
        attempt += 1
        own = empty % bins
        probe = (flat.mix(own.astype(np.uint64) + np.uint64((attempt << 20) + 1)) % np.uint64(bins)).astype(np.int64)
        source = empty - own + probe
        found = full[source]
        dense[empty[found]] = sig[source[found]]
        empty = empty[~found]
    return dense.reshape(n, bins)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, bins = sig.shape
    parts = sig.reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(1, bins // rows + 1, dtype=np.uint64), (n, bins // rows)).copy()
    for r in range(rows):
        key = flat.mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key


def _digests(sets: np.ndarray, offsets: np.ndarray) -> pa.Array:
    at = zip(offsets[:-1].tolist(), offsets[1:].tolist())
    return pa.array([hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in at], pa.binary())


def _features(rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.byte_slices(batch):
                sets, off = flat.shingle_sets(part.column(1), words)
                keys = band_keys(signatures(sets, off, BANDS * rows), rows)
                size = np.diff(off)
                bounds = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), _digests(sets, off), flat.long_lists(keys[size > 0].reshape(-1), bounds), *part.columns[2:]],
                    ["doc_id", "n_shingles", "digest", "bands", *part.schema.names[2:]],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.byte_slices(batch):
                sets, off = flat.shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), _digests(sets, off), flat.long_lists(sets, off)], ["id", "of", "shingles"])

    return run


def components(links: DataFrame, label: str = "cc") -> DataFrame:
    """(node, comp): smallest node reachable over ``links`` (a, b), for every node in them."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{label}-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), label)
    while True:
        there = labels.select(F.col("node").alias("b"), F.col("comp").alias("seen"))
        near = edges.join(there, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        # jump: the label of my label
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = materialize(
            lower.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), label
        )
        labels = new.select("node", "comp")
        if not new.filter("old <> comp").limit(1).count():
            return labels


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    words: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_digest: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id, kept.

    ``with_digest`` adds text_sha256, by which rows that repeat an id can be
    joined back.  Ids must be whole numbers.

    Texts are linked when 100 * |A & B| >= percent * |A | B| for their shingle
    sets; component_id is the smallest doc_id reachable and kept marks it.
    ``class_id`` is the smallest doc_id with the same set.  A null or blank
    text has no shingles and is its own component.  A row without an id can't
    be linked: its component_id and class_id are null and it is kept.  Rows
    that repeat an id carry the decision for their text.  An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = rows_per_band(percent)
    base = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = [F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")] if with_digest else []
    features = materialize(
        base.select("*", *digest).mapInArrow(
            _features(rows, words), f"doc_id long, n_shingles long, digest binary, bands array<long>{', text_sha256 string' if with_digest else ''}"
        ),
        "nd-features",
    )
    more = ["text_sha256"] if with_digest else []
    classes = features.filter("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")
    )
    # a table of its own, so that the join below has two plain exchanges and AQE can split a hot class; an id may
    # be the smallest of several classes, so they are numbered as they are written
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "nd-classes")
    members = classes.select("rep", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("width")).filter("width > 1")
    hot = materialize(members.join(buckets, "band"), "nd-hot")
    rank = hot.groupBy("rep").agg(F.sum("width").alias("rank"))
    active = materialize(hot.join(rank, "rep").select("band", "rep", "rank"), "nd-active")
    wanted = classes.join(rank, "rep", "left_semi").select("rep", "first_id", F.col("digest").alias("wanted"))
    texts = base.join(wanted, base["doc_id"] == wanted["first_id"], "left_semi")
    texts = texts.mapInArrow(_sets(words), "id long, of binary, shingles array<long>").dropDuplicates(["id", "of"])
    known = (F.col("id") == F.col("first_id")) & (F.col("of") == F.col("wanted"))
    sets = materialize(texts.join(wanted, known).select(F.col("rep").alias("id"), "shingles"), "nd-sets")
    stars, found, label = None, [], None
    while True:
        centres = active.groupBy("band").agg(F.max(F.struct("rank", (-F.col("rep")).alias("minus"))).alias("c"))
        centres = centres.select(F.col("band").alias("c_band"), (-F.col("c.minus")).alias("centre"))
        pairs = active.join(centres, (active["band"] == centres["c_band"]) & (active["rep"] != centres["centre"]))
        star = materialize(_met(pairs.select("centre", "rep").distinct(), sets, percent), "nd-star")
        stars = stars or star
        found.append(star.filter("linked").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")))
        label = components(_all(found), "nd-cc")
        if len(found) == STAR_ROUNDS:
            break
        apart = active.join(centres, active["band"] == centres["c_band"]).select("band", "rep", "rank", "centre")
        apart = _labelled(_labelled(apart, label, "rep", "comp"), label, "centre", "c_comp")
        active = materialize(apart.filter("comp <> c_comp").select("band", "rep", "rank"), "nd-active")
        if not active.limit(1).count():
            break
    # later rounds leave out members that met the first centre: only after the first can all be in one component
    if len(found) > 1:
        found.append(materialize(_unseen(stars, label, sets, percent), "nd-unseen"))
        label = components(_all(found), "nd-cc")
    first_ids = label.join(classes.select("rep", "first_id"), F.col("node") == F.col("rep")).groupBy("comp").agg(F.min("first_id").alias("component"))
    first_ids = materialize(first_ids.withColumnRenamed("comp", "of_comp"), "nd-components")
    class_of = features.select("doc_id", "n_shingles", "digest", *more)
    class_of = class_of.join(classes.select(F.col("digest").alias("d"), "rep", "first_id"), F.col("digest") == F.col("d"), "left")
    named = label.join(first_ids, F.col("comp") == F.col("of_comp")).select("node", "component")
    class_of = class_of.join(named, F.col("rep") == F.col("node"), "left")
    has_id = F.col("doc_id").isNotNull()
    class_id = F.when(has_id, F.coalesce("first_id", "doc_id"))
    component = F.when(has_id, F.coalesce("component", "first_id", "doc_id"))
    return class_of.select(
        "doc_id",
        F.col("n_shingles"),
        class_id.alias("class_id"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        *more,
    )


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _labelled(rows: DataFrame, label: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of the class in ``column``: itself where nothing is linked."""
    known = label.select(F.col("node").alias(f"{name}_node"), F.col("comp").alias(f"{name}_found"))
    joined = rows.join(known, F.col(column) == F.col(f"{name}_node"), "left")
    return joined.withColumn(name, F.coalesce(f"{name}_found", column)).drop(f"{name}_node", f"{name}_found")


def _with_sets(pairs: DataFrame, a: str, b: str, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("id").alias(a), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias(b), F.col("shingles").alias("of_b"))
    return pairs.join(left, a).join(right, b)


def _linked(both, n_a, n_b, percent: int):
    return 100 * both >= percent * (n_a + n_b - both)


def _met(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each pair (centre, rep) with its sets' sizes, whether it is linked, and the two-way difference."""
    met = _with_sets(pairs, "centre", "rep", sets)
    added, lost = F.array_except("of_b", "of_a"), F.array_except("of_a", "of_b")
    met = met.select("centre", "rep", F.size("of_a").cast("long").alias("n_c"), F.size("of_b").cast("long").alias("n"), F.concat(added, lost).alias("differs"), F.size(added).alias("n_added"))
    both = F.col("n") - F.col("n_added")
    return met.withColumn("linked", _linked(both, F.col("n_c"), F.col("n"), percent)).drop("n_added")


def _prefixes(stars: DataFrame, label: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rare differences by which members can meet, and pairs (a, b) that are near the core: see step 5."""
    up, down = 100 + percent, 100 - percent
    groups = stars.groupBy("centre").agg(F.count(F.lit(1)).alias("members"), F.max(~F.col("linked")).alias("some"))
    groups = materialize(groups.filter("members > 1 AND some").select(F.col("centre").alias("g"), "members"), "nd-groups")
    rows = stars.join(groups, stars["centre"] == groups["g"])
    often = rows.select("centre", "members", F.explode("differs").alias("s")).groupBy("centre", "s").agg(F.count(F.lit(1)).alias("freq"), F.max("members").alias("members"))
    turned = often.filter("2 * freq > members").groupBy(F.col("centre").alias("t_centre")).agg(F.collect_list("s").alias("turned"))
    turned = materialize(turned, "nd-turned")
    rows = _labelled(rows, label, "rep", "comp").join(turned, F.col("centre") == F.col("t_centre"), "left")
    differs = F.concat(F.array_except("differs", "turned"), F.array_except("turned", "differs"))
    rows = rows.select("centre", "rep", "comp", "linked", "n", F.when(F.col("turned").isNull(), F.col("differs")).otherwise(differs).alias("differs"))
    rows = rows.withColumn("d", F.size("differs").cast("long"))
    rows = materialize(rows.withColumn("v", up * F.col("d") - down * F.col("n")), "nd-members")
    bounds = rows.groupBy(F.col("centre").alias("b_centre")).agg(F.min(F.when(~F.col("linked"), F.col("v"))).alias("far_v"), F.min(F.struct("v", "rep", "comp")).alias("near"))
    rows = rows.join(materialize(bounds, "nd-bounds"), F.col("centre") == F.col("b_centre"))
    sure = rows.filter("v + near.v <= 0 AND comp <> near.comp").select(F.least("rep", "near.rep").alias("a"), F.greatest("rep", "near.rep").alias("b"))

    def few(other):
        return F.col("d") + 1 - F.greatest(F.ceil((F.col("v") + other) / (2 * up)), F.lit(1))

    # elements that a member takes to meet others, and those by which one that isn't linked with the centre is met
    rows = rows.withColumn("meets", few(F.col("far_v"))).withColumn("is_met", F.when(F.col("linked"), 0).otherwise(few(F.col("near.v"))))
    flat_rows = materialize(rows.select("centre", "rep", "comp", "v", "d", "meets", "is_met", F.explode("differs").alias("s")), "nd-differs")
    # a difference that one component alone has can't lead to another
    shared = flat_rows.groupBy("centre", "s").agg(F.count(F.lit(1)).alias("freq"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    shared = shared.select(F.col("centre").alias("f_centre"), F.col("s").alias("f_s"), F.when(F.col("lo") < F.col("hi"), F.col("freq")).otherwise(0).alias("freq"))
    ranked = flat_rows.join(shared, (flat_rows["centre"] == shared["f_centre"]) & (flat_rows["s"] == shared["f_s"]))
    whole = ["centre", "rep", "comp", "v", "d", "meets", "is_met"]
    first = F.greatest("meets", "is_met", F.lit(0)).cast("int")
    by_freq = ranked.groupBy(*whole).agg(F.sort_array(F.collect_list(F.struct("freq", "s"))).alias("by_freq"))
    prefixes = by_freq.select(*whole, F.posexplode(F.slice("by_freq", 1, first)).alias("k", "e")).filter("e.freq > 0")
    return materialize(prefixes.select(*whole, "k", F.col("e.s").alias("s")), "nd-prefixes"), sure


def _matches(prefixes: DataFrame) -> DataFrame:
    """Pairs of prefix elements that meet, once for each element that the two share."""

    def side(name: str, filter_: str) -> DataFrame:
        of = [F.col(c).alias(f"{name}_{c}") for c in ("comp", "v", "d", "k")]
        return prefixes.filter(filter_).select("centre", "s", F.col("rep").alias(name), *of)

    return side("x", "k < meets").join(side("y", "k < is_met"), ["centre", "s"])


def _unseen(stars: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of two members of a star of which one isn't linked with the centre."""
    prefixes, sure = _prefixes(stars, label, percent)
    # at the first difference that a linked pair shares, enough of them are left on both sides
    left = F.least(F.col("x_d") - F.col("x_k"), F.col("y_d") - F.col("y_k"))
    enough = 2 * (100 + percent) * left >= F.col("x_v") + F.col("y_v")
    pairs = _matches(prefixes).filter("x_comp <> y_comp").filter(enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pairs.union(sure).distinct()
    both = F.size(F.array_intersect("of_a", "of_b"))
    confirmed = _with_sets(pairs, "a", "b", sets).withColumn("both", both)
    return confirmed.filter(_linked(F.col("both"), F.size("of_a"), F.size("of_b"), percent)).select("a", "b")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), m AS (
  SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s
), g AS (
  SELECT sh, min(doc_id) AS rep, any_value(n) AS n FROM m WHERE n > 0 GROUP BY sh
), x AS (
  SELECT rep, n, unnest(sh) AS t FROM g
), p AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS n_both, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * n_both >= 85 * (na + nb - n_both)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT rep AS node, rep AS seen FROM g
  UNION
  SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
), c AS (
  SELECT node, min(seen) AS comp FROM r GROUP BY node
)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, coalesce(g.rep, m.doc_id) AS class_id,
       coalesce(c.comp, m.doc_id) AS component_id, coalesce(c.comp, m.doc_id) = m.doc_id AS kept
FROM m LEFT JOIN g ON m.sh = g.sh AND m.n > 0 LEFT JOIN c ON g.rep = c.node
"""
