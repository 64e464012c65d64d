"""Distributed building blocks that Catalyst does not give us directly.

* ``running_sums`` — running sums in a global sort order, per group, without
  a single-partition window: rows are range-partitioned on (groups, order),
  each range is summed locally in a window partitioned by the range id, and
  the per-range totals (at most #ranges x #groups rows) are turned into
  offsets.  This is the "prefix kernel" used by ROC/KS/gains/concordance,
  exact quantiles, qcut edges and global row numbers.
* ``cumulate`` — the kernel over distinct values (partial aggregation first,
  so a hot value is one row whatever its multiplicity).
* ``exact_quantiles`` / ``qcut_edges`` / ``qcut`` — pandas/numpy "linear"
  quantiles computed from cumulative counts (no per-group value map held in
  one task, unlike ``percentile``).
* ``hash_order`` — md5-derived 60-bit integer, identical in Spark and DuckDB,
  used for deterministic sampling, splits and permutations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.ml.feature import Bucketizer


def _n_ranges(df: DataFrame, n: int | None) -> int:
    if n:
        return int(n)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def hash_order(*cols: Column | str, sep: str = "-") -> Column:
    """60-bit integer from md5 of the '-'-joined string values (Spark == DuckDB)."""
    s = F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def range_cuts(df: DataFrame, col: str, n_ranges: int) -> list[float]:
    """Approximate equi-depth cut points of ``col`` (one pass, ``n_ranges`` - 1
    values collected).  They only balance the work; results never depend on them."""
    if n_ranges <= 1:
        return []
    probs = [i / n_ranges for i in range(1, n_ranges)]
    qs = df.select(range_key(df, col).alias("_q")).approxQuantile("_q", probs, 1.0 / (4 * n_ranges))
    return sorted({q for q in qs if q == q and q not in (_INF, -_INF)})


_INF = float("inf")
_DMAX = 1.7976931348623157e308


def range_key(df: DataFrame, col: str) -> Column:
    """A double that grows with ``col``: numbers as they are, times as seconds,
    strings by their first six bytes (ties only affect the balance)."""
    kind = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp").cast("double")
    return c.cast("double")


def assign_range(df: DataFrame, col: str, cuts: Sequence[float], out: str = "_rng") -> DataFrame:
    """Deterministic, order-preserving range id of ``col`` given sorted cut points
    (nulls first, NaN last, matching Spark's ascending sort)."""
    if not cuts:
        # one effective range: a real (non-foldable) assignment keeps the offset join keyed
        cuts = [_DMAX]
    b = Bucketizer(splits=[-_INF, *cuts, _INF], inputCol="_rq", outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn("_rq", F.coalesce(range_key(df, col), F.lit(-_INF)))).drop("_rq")


def running_sums(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    measures: Sequence[str],
    n_ranges: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive running sum in ``order`` within ``groups``)
    and ``tot_<m>`` (group total) for each measure; all other columns kept.

    Rows get a range id that is a pure function of the first order column
    (cut points computed once and embedded as literals), so every consumer
    and every recomputation after an executor loss sees the same ranges.
    Ties in ``order`` are summed in arbitrary order, so pass a unique order
    (or aggregate first, as ``cumulate`` does) when ties matter.
    """
    groups, order, measures = list(groups), list(order), list(measures)
    if cuts is None:
        cuts = range_cuts(df, order[0], _n_ranges(df, n_ranges))
    ranged = assign_range(df, order[0], cuts)
    w = (
        Window.partitionBy("_rng", *groups)
        .orderBy(*[F.col(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select("*", *[F.sum(m).over(w).alias(f"_lc_{m}") for m in measures])
    # per-range totals from the same windowed frame, so both consumers share
    # one exchange: at most #ranges x #groups rows
    btot = local.groupBy("_rng", *groups).agg(*[F.sum(m).alias(f"_bt_{m}") for m in measures])
    before = Window.partitionBy(*groups).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offs = btot.select(
        "_rng",
        *groups,
        *[F.coalesce(F.sum(f"_bt_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_bt_{m}").over(whole).alias(f"tot_{m}") for m in measures],
    )
    out = local.join(offs, ["_rng", *groups])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"_lc_{m}") + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"tot_{m}") for m in measures],
    )


def cumulate(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    measures: dict[str, Column],
    n_ranges: int | None = None,
) -> DataFrame:
    """One row per (groups, distinct value) with the summed measures, their
    inclusive ascending running sums ``cum_<m>`` and group totals ``tot_<m>``.

    ``measures`` maps output name -> per-row Column (e.g. ``{"pos": label}``).
    Null values of ``value`` are dropped.
    """
    groups = list(groups)
    base = df.where(F.col(value).isNotNull()).select(*groups, value, *[c.alias(n) for n, c in measures.items()])
    agg = base.groupBy(*groups, value).agg(*[F.sum(n).alias(n) for n in measures])
    return running_sums(agg, groups, [value], list(measures), n_ranges)


def label_counts(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Kernel specialised for binary evaluation: per distinct score,
    pos/neg counts, ascending cumulative pos/neg and class totals."""
    return cumulate(
        df,
        groups,
        score,
        {
            "pos": F.when(F.col(label) == 1, 1).otherwise(0).cast("long"),
            "neg": F.when(F.col(label) == 1, 0).otherwise(1).cast("long"),
        },
    )


def _positions(method: str, q: Column):
    """0-based (low, high) order-statistic positions and the interpolation
    fraction for quantile ``q`` of ``tot_cnt`` sorted values."""
    n = F.col("tot_cnt")
    if method == "linear":  # numpy/pandas default, DuckDB quantile_cont
        h = (n - 1) * q
        lo = F.floor(h)
        return lo, F.least(lo + 1, n - 1), h - lo
    if method == "lower":  # numpy interpolation='lower'
        lo = F.floor((n - 1) * q)
        return lo, lo, F.lit(0.0)
    if method == "mquantiles":  # scipy mquantiles, alphap = betap = 0.4
        aleph = n * q + (0.4 + q * 0.2)
        k = F.floor(F.least(F.greatest(aleph, F.lit(1.0)), n - 1))
        gamma = F.least(F.greatest(aleph - k, F.lit(0.0)), F.lit(1.0))
        return k - 1, k, gamma
    raise ValueError(f"unknown quantile method {method!r}")


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float],
    n_ranges: int | None = None,
    method: str = "linear",
    count: str | None = None,
) -> DataFrame:
    """Exact quantiles per group: columns ``groups..., q, quantile``.

    ``count`` names a column that says how many rows a row stands for.

    ``method``: 'linear' (numpy/pandas default, DuckDB ``quantile_cont``),
    'lower' (numpy interpolation='lower') or 'mquantiles' (scipy defaults).
    The two order statistics around each position are found in the
    cumulative-count table by a per-row generator over ``probs`` (no join, no
    value map held per group).
    """
    groups = list(groups)
    cum = cumulate(df, groups, value, {"cnt": (F.col(count) if count else F.lit(1)).cast("long")}, n_ranges)
    qs = F.array(*[F.lit(float(p)) for p in probs])

    def pos(q):
        lo, hi, frac = _positions(method, q)
        return F.struct(q.alias("q"), lo.alias("klo"), hi.alias("khi"), frac.cast("double").alias("frac"))

    inside = lambda k: (k >= F.col("cum_cnt") - F.col("cnt")) & (k < F.col("cum_cnt"))
    hits = cum.select(
        *groups,
        F.col(value).alias("_v"),
        F.explode(F.filter(F.transform(qs, pos), lambda s: inside(s["klo"]) | inside(s["khi"]))).alias("_s"),
        F.col("cum_cnt"),
        F.col("cnt"),
    )
    g = hits.groupBy(*groups, F.col("_s.q").alias("q")).agg(
        F.max(F.when(inside(F.col("_s.klo")), F.col("_v"))).alias("_vlo"),
        F.max(F.when(inside(F.col("_s.khi")), F.col("_v"))).alias("_vhi"),
        F.max(F.col("_s.frac")).alias("_frac"),
    )
    if method == "mquantiles":
        val = (1.0 - F.col("_frac")) * F.col("_vlo") + F.col("_frac") * F.col("_vhi")
    else:
        val = F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))
    return g.select(*groups, "q", val.alias("quantile"))


def qcut_edges(df: DataFrame, groups: Sequence[str], value: str, n_bins: int) -> DataFrame:
    """Distinct interior qcut edges per group as ``groups..., edges array<double>``
    (sorted).  pandas raises on duplicate edges; we merge them."""
    probs = [i / n_bins for i in range(1, n_bins)]
    q = exact_quantiles(df, groups, value, probs)
    return q.groupBy(*groups).agg(F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed bin number 1.. for ``value`` given sorted interior edges."""
    return F.aggregate(edges, F.lit(1), lambda acc, e: acc + F.when(value > e, 1).otherwise(0))


def qcut(df: DataFrame, value: str, n_bins: int, groups: Sequence[str] = (), out: str = "bin") -> DataFrame:
    """Equal-frequency bins (pandas ``qcut`` edges, right-closed, lowest included).

    The edges are fitted parameters, n_bins - 1 values: without groups they are
    one row and become literals; a table of edges by group is joined back (AQE
    picks the join)."""
    groups = list(groups)
    edges = qcut_edges(df, groups, value, n_bins)
    x = F.col(value)
    if not groups:
        row = edges.first()
        arr = F.array(*[F.lit(float(e)) for e in (row["edges"] if row else [])]).cast("array<double>")
        return df.withColumn(out, F.when(x.isNotNull(), bin_of(x, arr)))
    j = df.join(edges, groups, "left")
    return j.withColumn(out, F.when(x.isNotNull(), bin_of(x, F.col("edges")))).drop("edges")


def uniform_hash_cuts(n_ranges: int) -> list[float]:
    """Cut points for a ``hash_order`` column (uniform on [0, 2^60))."""
    return [float(i * (1 << 60) // n_ranges) for i in range(1, n_ranges)]


def row_numbers(
    df: DataFrame,
    order: Sequence[str],
    groups: Sequence[str] = (),
    out: str = "rn",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """1-based row number in ``order`` within ``groups`` (make ``order`` unique,
    e.g. end it with the key) — a global sort without a single-partition window.
    Pass ``cuts=uniform_hash_cuts(n)`` when ``order[0]`` is a ``hash_order``."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    r = running_sums(one, groups, order, ["_one"], cuts=cuts)
    return r.withColumnRenamed("cum__one", out).drop("_one", "tot__one")
