"""STR-3: streaming drift counts.

Level counts per (event-time window, feature, level) are kept as windowed
state (append mode, watermark-bounded); each micro-batch of finished windows
is compared with the static training baseline by the batch chi-square
operator inside ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.operators.drift import chi_square_from_counts


def windowed_level_counts(stream: DataFrame, features: Sequence[str], ts_col: str, window: str = "1 hour",
                          watermark: str = "10 minutes") -> DataFrame:
    long = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark).select(
        ts_col, *[F.col(c).cast("string").alias(c) for c in features]
    ).unpivot([ts_col], list(features), "feature", "level")
    return long.where(F.col("level").isNotNull()).groupBy(
        F.window(ts_col, window).alias("w"), "feature", "level"
    ).agg(F.count(F.lit(1)).alias("n"))


def drift_batch(counts: DataFrame, baseline: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """One micro-batch of finished windows -> (window_start, feature, p_value, shift_occurred)."""
    c = counts.select(F.col("w.start").alias("window_start"), "feature", "level", "n")
    return chi_square_from_counts(baseline, c, ["window_start"], cutoff)


def start_drift_stream(stream: DataFrame, baseline: DataFrame, features: Sequence[str], ts_col: str,
                       sink_path: str, checkpoint: str, window: str = "1 hour", trigger: dict | None = None):
    counts = windowed_level_counts(stream, features, ts_col, window)

    def write(batch: DataFrame, epoch: int) -> None:
        drift_batch(batch, baseline).write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")  # a replayed batch replaces its own rows

    q = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return q.trigger(**(trigger or {"availableNow": True})).start()
