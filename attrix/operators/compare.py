"""Statistical comparison of classifiers (CMP-1..3): one aggregation pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.functions.stats import chi2_sf


def mcnemar(df: DataFrame, label: str, pred_a: str, pred_b: str, corrected: bool = True) -> DataFrame:
    """CMP-1: 2x2 right/wrong table of two models and McNemar's chi2
    ((|b - c| - 1)^2 / (b + c) with continuity correction), p on 1 dof.
    n01 = model a right and b wrong, n10 = a wrong and b right."""
    ra = F.col(pred_a) == F.col(label)
    rb = F.col(pred_b) == F.col(label)
    t = df.agg(
        F.sum(F.when(ra & rb, 1).otherwise(0)).cast("long").alias("n00"),
        F.sum(F.when(ra & ~rb, 1).otherwise(0)).cast("long").alias("n01"),
        F.sum(F.when(~ra & rb, 1).otherwise(0)).cast("long").alias("n10"),
        F.sum(F.when(~ra & ~rb, 1).otherwise(0)).cast("long").alias("n11"),
    )
    b, c = F.col("n01"), F.col("n10")
    num = F.pow(F.abs(b - c) - (1 if corrected else 0), 2)
    stat = F.try_divide(num, b + c)
    return t.withColumn("chi2", stat).withColumn("p", chi2_sf(F.col("chi2"), F.lit(1)))


def cochrans_q(df: DataFrame, label: str, preds: Sequence[str]) -> DataFrame:
    """CMP-2: Cochran's Q for M >= 2 models' correctness, p on M - 1 dof.
    Q = (M - 1) (M sum_j G_j^2 - T^2) / (M T - sum_i L_i^2)."""
    m = len(preds)
    if m < 2:
        raise ValueError("need at least two models")
    right = [F.when(F.col(p) == F.col(label), 1).otherwise(0) for p in preds]
    li = sum(right[1:], right[0])
    a = df.agg(
        *[F.sum(r).cast("double").alias(f"g{j}") for j, r in enumerate(right)],
        F.sum(F.pow(li, 2)).cast("double").alias("sl2"),
    )
    t = sum((F.col(f"g{j}") for j in range(1, m)), F.col("g0"))
    g2 = sum((F.pow(F.col(f"g{j}"), 2) for j in range(1, m)), F.pow(F.col("g0"), 2))
    q = F.try_divide((m - 1) * (m * g2 - F.pow(t, 2)), m * t - F.col("sl2"))
    return a.select(q.alias("q")).withColumn("p", chi2_sf(F.col("q"), F.lit(m - 1)))


def bias_variance(preds: DataFrame, key: str, label: str, round_col: str, pred: str) -> DataFrame:
    """CMP-3 decomposition of 0-1 loss from a (key, label, round, pred) table
    of repeated fits: main prediction = per-key mode (ties -> 0), expected loss,
    bias = main prediction wrong, variance = disagreement with the mode."""
    per_key = preds.groupBy(key).agg(
        F.first(label).alias("_y"),
        F.sum(F.col(pred)).alias("_ones"),
        F.count(F.lit(1)).alias("_r"),
        F.sum(F.when(F.col(pred) != F.col(label), 1).otherwise(0)).alias("_wrong"),
    ).withColumn("_main", F.when(F.col("_ones") * 2 > F.col("_r"), 1).otherwise(0))
    disagree = F.when(F.col("_main") == 1, F.col("_r") - F.col("_ones")).otherwise(F.col("_ones"))
    return per_key.agg(
        (F.sum("_wrong") / F.sum("_r")).alias("expected_loss"),
        F.avg(F.when(F.col("_main") != F.col("_y"), 1.0).otherwise(0.0)).alias("bias"),
        (F.sum(disagree) / F.sum("_r")).alias("variance"),
    )

