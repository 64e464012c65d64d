"""Ranking, top-n, sampling, de-duplication and splits (survey section 2.8).

Deterministic "random" operators order rows by an md5-derived integer
(``hash_order``) so the same rows are chosen on every run, after any
recomputation, and by the DuckDB oracle.  Per-key picks use ``min_by`` /
``max_by`` aggregates (partial aggregation, so a hot key is not gathered in
one task) rather than a window over each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.operators.kernels import hash_order, qcut, row_numbers  # noqa: F401  (qcut: WIN-3)


def ranking(df: DataFrame, order: Sequence[str], descending: bool = True, out: str = "ranking") -> DataFrame:
    """WIN-2: 0-based rank by ``order`` (the leaderboard's mean score), ties
    broken by the remaining columns in ``order``; distributed row numbers."""
    tmp = df
    cols = []
    for i, c in enumerate(order):
        name = f"_o{i}"
        tmp = tmp.withColumn(name, -F.col(c) if descending and i == 0 else F.col(c))
        cols.append(name)
    r = row_numbers(tmp, cols, out="_rn")
    return r.withColumn(out, (F.col("_rn") - 1).cast("int")).drop("_rn", *cols)


def argmax_row(df: DataFrame, groups: Sequence[str], value: str, cols: Sequence[str], tie: str | None = None) -> DataFrame:
    """WIN-4: per group, the columns of the row with the largest ``value``
    (ties: largest ``tie`` column)."""
    order = F.struct(F.col(value), F.col(tie)) if tie else F.col(value)
    return df.groupBy(*groups).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r")).select(
        *groups, "_r.*"
    )


def head_hash_ordered(df: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """WIN-6 / WIN-7 (fixed n): the n rows with the smallest md5 order of the
    key (and seed) — ``limit`` alone is unordered.  Only rows in the band of
    hashes that should hold n of them are ordered, so the last task gets about
    n rows and not n of every partition; should the band hold too few (keys
    that repeat), all rows are."""
    h = hash_order(F.col(key)) if seed is None else hash_order(F.col(key), F.lit(seed))
    rows = df.withColumn("_h", h)
    total = df.count()
    if total > 2 * n:
        band = rows.where(F.col("_h") < F.lit(min(int((n + 10 * n**0.5 + 100) / total * (1 << 60)), 1 << 60)))
        if band.count() >= n:
            rows = band
    return rows.orderBy("_h", key).limit(n).drop("_h")


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 19) -> DataFrame:
    """WIN-7 (fraction): rows whose md5(key-seed) falls in the lowest
    ``fraction`` of the hash range — a map-side filter, reproducible."""
    band = int(fraction * (1 << 60))
    return df.where(hash_order(F.col(key), F.lit(seed)) < F.lit(band))


def drop_duplicates_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """WIN-8: one row per key, the first by ``order``."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order])).alias("_r")
    ).select(key, "_r.*")


def last_match(df: DataFrame, key: str, value: str, order: str, out: str | None = None) -> DataFrame:
    """WIN-9: the value of the last row per key in ``order``."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.col(order)).alias(out or value))


def split_threshold(test_fraction: float) -> str:
    """Hex prefix threshold: md5 prefix (4 hex digits) below it -> test."""
    return format(int(round(test_fraction * 0x10000)), "04x")


def train_test_split(df: DataFrame, key: str, test_fraction: float = 0.2, out: str = "split") -> DataFrame:
    """WIN-10: deterministic split on the key: first 4 md5 hex digits of the
    key below the threshold -> 'test' ('3333' for 20 %, '4000' for 25 %)."""
    t = split_threshold(test_fraction)
    prefix = F.substring(F.md5(F.col(key).cast("string")), 1, 4)
    return df.withColumn(out, F.when(prefix < F.lit(t), "test").otherwise("train"))
