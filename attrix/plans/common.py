"""Shared helpers for query plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from attrix.operators.evaluate import predictions_frame
from attrix.plans import views


def r6(df: DataFrame, places: int = 6, **overrides: int) -> DataFrame:
    """Round every floating column (the oracle SQL rounds the same columns);
    ``overrides`` gives other precisions per column (e.g. long sums)."""
    return df.select(
        *[
            F.round(F.col(f.name), overrides.get(f.name, places)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r6_many(df: DataFrame) -> DataFrame:
    """``r6`` for results of very many rows, value for value the same: ``round``
    goes through a decimal, so it is left to values so near a tie (or so large)
    that a product of doubles might round them to the other side."""
    return df.select(
        *[
            _round6(F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _round6(x: Column) -> Column:
    scaled = x * F.lit(1e6)
    clear = (F.abs(x) < 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(1e6)).otherwise(F.round(x, 6))


def preds(spark, d) -> DataFrame:
    """v_pred with the reference's predictions frame columns (cutoff 0.5)."""
    return predictions_frame(views.v_pred(spark, d), "prob")


# SQL for the same predictions frame
PRED_SQL = "SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS predicted_class FROM v_pred"


def obs_once(spark, d, columns: Sequence[str] = ()) -> DataFrame:
    """v_obs written once under the checkpoint folder, for operators that read
    their input from several branches (quantile jobs, kernels, per-feature
    aggregates): the three joins and the lineitem aggregation run once, and the
    files of their exchanges go when they are done.  Without ``columns``, all."""
    from attrix.session import materialize, without_shuffle_files

    with without_shuffle_files(spark):
        return materialize(views.v_obs(spark, d).select(*columns or "*"), "v_obs")
