"""Dataset drift between a training snapshot and production requests (DRF-1..3).

Both sides are unpivoted once; categorical features are compared with the
reference's scaled chi-square, numeric ones with the two-sample KS test from
the distributed prefix kernel — one aggregation per test family, no loop
over features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.functions.stats import chi2_sf, ks_pvalue
from attrix.operators.aggregates import level_frequency
from attrix.operators.kernels import cumulate

P_VALUE_CUTOFF = 0.05
_INF = float("inf")


def _chi_from_frequencies(freq: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """chisquare(f_obs=prod_count, f_exp=train_count) per feature: a level
    unseen in training has expected 0, so the statistic is infinite and p = 0."""
    term = F.when(F.col("train_count") == 0, F.lit(_INF)).otherwise(
        F.pow(F.col("prod_count") - F.col("train_count"), 2) / F.col("train_count")
    )
    g = freq.groupBy(*groups, "feature").agg(F.sum(term).alias("chi2"), F.count(F.lit(1)).alias("levels"))
    return g.select(*groups, "feature", "chi2", chi2_sf(F.col("chi2"), F.col("levels") - 1).alias("p_value"))


def chi_square_shift(train: DataFrame, prod: DataFrame, features: Sequence[str]) -> DataFrame:
    """DRF-1: (feature, chi2, p_value) for categorical features."""
    return _chi_from_frequencies(level_frequency(train, prod, features))


def chi_square_from_counts(baseline: DataFrame, current: DataFrame, groups: Sequence[str], cutoff: float = P_VALUE_CUTOFF):
    """Streaming form (STR-3): baseline (feature, level, n) against current
    (groups..., feature, level, n), each side scaled to 1000 rows plus one and
    truncated, as in DRF-1.

    Without pairing every group with the whole baseline: levels present in a
    group join the baseline on (feature, level); baseline levels absent from
    the group each add (0 - e)^2 / e = e, i.e. the baseline total minus the
    expected counts of the present levels (per-feature totals, one row per
    feature).  Levels unseen in the baseline make the statistic infinite."""
    groups = list(groups)

    def scale(df, name, g):
        t = df.groupBy(*g, "feature").agg(F.sum("n").alias("_t"))
        return df.join(t, [*g, "feature"]).select(
            *g, "feature", "level", (F.col("n") / F.col("_t") * 1000.0 + 1.0).cast("int").alias(name)
        )

    base = scale(baseline, "train_count", [])
    cur = scale(current, "prod_count", groups)
    j = cur.join(base, ["feature", "level"], "left")
    per = j.groupBy(*groups, "feature").agg(
        F.sum(
            F.when(F.col("train_count").isNull(), F.lit(_INF)).otherwise(
                F.pow(F.col("prod_count") - F.col("train_count"), 2) / F.col("train_count")
            )
        ).alias("_present"),
        F.sum(F.coalesce("train_count", F.lit(0))).alias("_tp"),
        F.sum(F.when(F.col("train_count").isNull(), 1).otherwise(0)).alias("_new"),
    )
    totals = base.groupBy("feature").agg(F.sum("train_count").alias("_ta"), F.count(F.lit(1)).alias("_nb"))
    r = per.join(totals, "feature", "left")
    chi2 = F.col("_present") + (F.coalesce("_ta", F.lit(0)) - F.col("_tp"))
    levels = F.coalesce("_nb", F.lit(0)) + F.col("_new")
    out = r.select(*groups, "feature", chi2.alias("chi2"), chi2_sf(chi2, levels - 1).alias("p_value"))
    return out.withColumn("shift_occurred", F.col("p_value") <= cutoff)


def ks_shift(train: DataFrame, prod: DataFrame, features: Sequence[str]) -> DataFrame:
    """DRF-2: (feature, ks_statistic, p_value) for numeric features.  A feature
    with no values on one side gets p = 0 (the reference's fallback)."""

    def long(df, side):
        return df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot(
            [], list(features), "feature", "x"
        ).withColumn("_side", F.lit(side))

    both = long(train, 0).unionByName(long(prod, 1))
    k = cumulate(
        both,
        ["feature"],
        "x",
        {
            "a": F.when(F.col("_side") == 0, 1).otherwise(0).cast("long"),
            "b": F.when(F.col("_side") == 1, 1).otherwise(0).cast("long"),
        },
    )
    d = k.groupBy("feature").agg(
        F.max(F.abs(F.try_divide(F.col("cum_a"), F.col("tot_a")) - F.try_divide(F.col("cum_b"), F.col("tot_b")))).alias(
            "ks_statistic"
        ),
        F.max("tot_a").alias("n1"),
        F.max("tot_b").alias("n2"),
    )
    present = both.select("feature").distinct()
    return present.join(d, "feature", "left").select(
        "feature",
        "ks_statistic",
        F.when((F.col("n1") > 0) & (F.col("n2") > 0), ks_pvalue(F.col("ks_statistic"), "n1", "n2"))
        .otherwise(F.lit(0.0))
        .alias("p_value"),
    )


def dataset_shift_report(
    train: DataFrame,
    prod: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    cutoff: float = P_VALUE_CUTOFF,
) -> DataFrame:
    """DRF-3: (feature, p_value, shift_occurred = p <= cutoff, p_value_cutoff)."""
    parts = []
    if categorical:
        parts.append(chi_square_shift(train, prod, categorical).select("feature", "p_value"))
    if numeric:
        parts.append(ks_shift(train, prod, numeric).select("feature", "p_value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        "feature",
        "p_value",
        (F.col("p_value") <= cutoff).alias("shift_occurred"),
        F.lit(float(cutoff)).alias("p_value_cutoff"),
    )
