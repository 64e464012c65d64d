"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a bag of words with their counts as weights.  For sample i, every
word w gets r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash of
(w, i); with weight x it has the level t = floor(ln x / r + b) and the value
ln a = ln c - r (t - b + 1).  The word and level with the least value are the
sample.  Two texts have the same sample with the probability of their
generalised Jaccard similarity, sum of min counts / sum of max counts.

Documents are compared with the next one by doc_id.  For that, ids are cut
into ranges of about as many rows; a range is one partition key from then on,
so texts are shuffled once, and words are counted and sampled where their text
is.  The first row of each range also goes, as a ghost, to the end of the
range before it, so that no row needs another range.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.llm.shared import normal_text, pick, shuffle_width

SAMPLES = 64
CELLS = 4096
ID_BITS = 24
LAST = (1 << 63) - 1
#: Values of the draw that orders rows of one id, and positions that tell equal texts apart in it.
DRAWS, COPIES = 1 << 30, 1 << 20
#: Tasks of the counting stage by shuffle partitions, so that a task's words fit in memory, and ranges by task.
TASKS, RANGES = 4, 4


def gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """x with 1 - (1 + x) exp(-x) = p, by bisection."""
    lo, hi = np.zeros(len(p)), np.full(len(p), 64.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        low = -np.expm1(-mid) - mid * np.exp(-mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """r and ln c by cell; CELLS more cells divide r's last and c's first cell."""
    p = (np.arange(CELLS) + 0.5) / CELLS
    r = np.concatenate((gamma_quantiles(p), gamma_quantiles(1 - p[::-1] / CELLS)))
    c = np.concatenate((gamma_quantiles(p), gamma_quantiles(p / CELLS)))
    return r, np.log(c)


def _tables_column() -> Column:
    """Both tables as one value per row, made by a generator: a plain constant would be copied into each of its uses."""
    r, c = (F.split(F.lit(",".join(f"{v:.12g}" for v in t)), ",").cast("array<double>") for t in _tables())
    return F.explode(F.array(F.struct(r.alias("r"), c.alias("c"))))


def _sample(i: int) -> Column:
    """Value (high bits, increasing) and identity (low bits) of a word's sample i."""
    x = F.xxhash64("term", F.lit(i))

    def bits(shift: int, n: int) -> Column:
        return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << n) - 1)).cast("int")

    r_cell, r_fine, c_cell, c_fine = bits(0, 12), bits(12, 12), bits(24, 12), bits(36, 12)
    b = (bits(48, 16) + F.lit(0.5)) / F.lit(65536.0)
    r = F.get(F.col("of.r"), F.when(r_cell == CELLS - 1, r_fine + CELLS).otherwise(r_cell))
    ln_c = F.get(F.col("of.c"), F.when(c_cell == 0, c_fine + CELLS).otherwise(c_cell))
    t = F.floor(F.col("ln_weight") / r + b)
    value = ln_c - r * (t - b + 1)
    high = F.shiftleft(((value + 64.0) * float(1 << 32)).cast("long"), ID_BITS)
    return high.bitwiseOR(F.col("term").bitwiseXOR(t * 7919).bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints (arrays)."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SAMPLES))


def as_text(samples: Column) -> Column:
    """Identities of the samples, six hexadecimal digits each."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << ID_BITS) - 1)))), 6, "0")), "")


def fingerprint_rows(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and samples (array) of each row; ``rows`` must be one partition key's on the first of ``keys``.

    Words are separated by white space and lower-cased.  A text without words
    has one, the empty word.
    """
    words = F.split(F.lower(F.trim(normal_text(F.col(text)))), " ")
    terms = rows.select(*keys, F.explode(words).alias("word")).select(*keys, F.xxhash64("word").alias("term"))
    counts = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("weight"))
    ready = counts.select(*keys, "term", F.ln(F.col("weight").cast("double")).alias("ln_weight"), _tables_column().alias("of"))
    least = ready.groupBy(*keys).agg(*[F.min(_sample(i)).alias(f"s{i}") for i in range(SAMPLES)])
    return least.select(*keys, F.array(*[F.col(f"s{i}") for i in range(SAMPLES)]).alias("samples"))


def _array(values: list[int]) -> Column:
    """A constant array as one string, which stays short in the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _ranged(rows: DataFrame) -> DataFrame:
    """Column ``part``: ranges of (place, draw) with about as many rows.

    A place that takes up several cuts has as many ranges, by ``draw``.
    """
    n = RANGES * TASKS * shuffle_width(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx("place", [k / n for k in range(1, n)], 5 * n)).first()[0] or [0]
    by_key: dict[float, Counter] = {}
    for c in cuts:
        by_key.setdefault(float(c), Counter())[int(c)] += 1
    # places that are one number as doubles share a cut: the commonest of them
    marks = [(key, *max(sorted(found.items()), key=lambda f: f[1])) for key, found in sorted(by_key.items())]
    ends = np.cumsum([0, *[times for _, _, times in marks]]).tolist()
    splits = [-float("inf"), *[key for key, _, _ in marks], float("inf")]
    cut = Bucketizer(splits=splits, inputCol="place_double", outputCol="bucket")
    rows = cut.transform(rows.withColumn("place_double", F.col("place").cast("double"))).withColumn("bucket", F.col("bucket").cast("int"))
    mark, times, end = (F.get(_array(a), F.col("bucket")) for a in ([-1, *[m for _, m, _ in marks]], [1, *[t for _, _, t in marks]], ends))
    within = F.floor(F.col("draw") * times / F.lit(DRAWS))
    part = F.when((F.col("bucket") == 0) | (F.col("place") > mark), end).when(F.col("place") == mark, end - times + 1 + within).otherwise(end - times + 1)
    return rows.withColumn("part", part.cast("int")).drop("place_double", "bucket")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the beginning of the next document by doc_id;
    rows of one id follow each other by a draw from their text and position,
    so that any number of them divides among tasks.  After the last document
    comes the first, and a lone document is its own next one.  A null text
    counts as empty; null ids come last.  Ids must be whole numbers.  An empty
    table gives an empty result; other columns are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("place"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)).alias("copy"),
    )
    base = base.withColumn("draw", F.pmod(F.xxhash64("text", "copy"), F.lit(DRAWS))).drop("copy")
    ranged = _ranged(base)
    order = Window.orderBy("part")  # over one row per range
    firsts = ranged.groupBy("part").agg(F.min(F.struct("place", "draw")).alias("first"))
    firsts = firsts.select(F.col("part").alias("f_part"), "first", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("before"))
    placed = ranged.join(F.broadcast(firsts), F.col("part") == F.col("f_part"))
    both = F.array(F.struct(F.col("part"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("part"), F.lit(True).alias("ghost")))
    here = F.slice(both, 1, F.when((F.col("place") == F.col("first.place")) & (F.col("draw") == F.col("first.draw")), 2).otherwise(1))
    rows = placed.select("doc_id", "place", "draw", "text", F.explode(here).alias("at"))
    rows = rows.select(F.col("at.part").alias("part"), F.col("at.ghost").alias("ghost"), "doc_id", "place", "draw", "text")
    rows = rows.repartition(TASKS * shuffle_width(docs.sparkSession), "part")
    along = Window.partitionBy("part").orderBy("ghost", "place", "draw", "text")
    rows = rows.withColumn("row", F.row_number().over(along)).withColumn("next", F.coalesce(F.lead("text").over(along), F.lit("")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    # with the id, both branches read the same columns, so the texts are exchanged once
    texts = rows.select("part", "row", "doc_id", F.posexplode(F.array("text", "edited")).alias("kind", "text"))
    samples = fingerprint_rows(texts, ["part", "row", "doc_id", "kind"])
    prints = samples.groupBy("part", "row", "doc_id").agg(
        F.max(F.when(F.col("kind") == 0, F.col("samples"))).alias("samples"), F.max(F.when(F.col("kind") == 1, F.col("samples"))).alias("edited_samples")
    )
    after = F.lead("samples").over(Window.partitionBy("part").orderBy("row"))
    prints = prints.withColumn("next_samples", after).select(
        "part",
        "row",
        as_text(F.col("samples")).alias("fingerprint"),
        as_text(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.col("next_samples")).alias("near_next"),
    )
    facts = rows.filter("NOT ghost").select(F.col("part").alias("r_part"), F.col("row").alias("r_row"), "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    joined = facts.join(prints, (F.col("part") == F.col("r_part")) & (F.col("row") == F.col("r_row")))
    return joined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
