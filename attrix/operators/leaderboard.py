"""Cross-validation leaderboard (TRN-3 with PRJ-16, WIN-2, AGG-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.operators.projections import pivot_folds
from attrix.operators.windows import ranking

CV_FOLDS = 5


def cv_leaderboard(fold_scores: DataFrame, ids: Sequence[str], fold: str = "fold", score: str = "score",
                   n_folds: int = CV_FOLDS) -> DataFrame:
    """One row per trial: fold_0..fold_{n-1}, mean, std over the folds (sample
    std of the fold scores only — the reference also folds its mean in, Q7),
    and a 0-based ranking by mean descending (ties by the trial ids)."""
    wide = pivot_folds(fold_scores, ids, fold, score, n_folds)
    folds = [F.col(f"fold_{i}") for i in range(n_folds)]
    mean = sum(folds[1:], folds[0]) / n_folds
    var = sum((F.pow(f - mean, 2) for f in folds[1:]), F.pow(folds[0] - mean, 2)) / (n_folds - 1)
    wide = wide.withColumn("mean", mean).withColumn("std", F.sqrt(var))
    return ranking(wide, ["mean", *ids], descending=True)


def fold_of(key: str, n_folds: int = CV_FOLDS):
    """Deterministic fold id from the md5 order of the key."""
    from attrix.operators.kernels import hash_order

    return (hash_order(F.col(key)) % n_folds).cast("int")
