"""Config snapshots, lookup dimensions, model metadata and dataset snapshots
(SRC-4, SRC-5, SRC-6, SRC-8, SNK-5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.operators.aggregates import with_scalar


def latest_snapshot(df: DataFrame, ts_col: str = "meta__inserted_at") -> DataFrame:
    """SRC-4: the rows stamped with the table's latest timestamp (scalar max
    joined back as a one-row broadcast; ties kept)."""
    mx = df.agg(F.max(ts_col).alias("_mx"))
    return with_scalar(df, mx).where(F.col(ts_col) == F.col("_mx")).drop("_mx")


def snapshot_map(df: DataFrame, key: str = "config_key", value: str = "config_value", ts_col: str = "meta__inserted_at") -> DataFrame:
    """SRC-4 map form: one row holding key -> value.  Of repeated keys the
    latest by ``ts_col`` wins (of equal times, or without that column, the
    largest value).  Meant for the small config table only."""
    age = [F.col(ts_col)] if ts_col in df.columns else []
    last = df.groupBy(key).agg(F.max_by(F.col(value), F.struct(*age, F.col(value))).alias(value))
    return last.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value)))).alias("config")
    )


def read_lookup(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """SRC-5: narrow projection of a dimension; callers ``.cache()`` it when it
    is reused (the reference's 24 h cache) and Spark broadcasts it when small."""
    return df.select(key, *cols)


def model_start_time(meta: DataFrame, model_uid: str, uid_col: str = "model_uid", ts_col: str = "training_timestamp"):
    """SRC-6: training timestamp of a model (earliest row for the uid)."""
    return meta.where(F.col(uid_col) == model_uid).groupBy(uid_col).agg(F.min(ts_col).alias(ts_col))


def save_dataset_snapshot(df: DataFrame, path: str, model_uid: str, split: str) -> None:
    """SNK-5: append the rows a model was trained/tested on, partitioned by
    model_uid and split so later reads prune to one run."""
    (
        df.withColumn("model_uid", F.lit(model_uid))
        .withColumn("split", F.lit(split))
        .write.mode("append")
        .partitionBy("model_uid", "split")
        .parquet(path)
    )


def training_snapshot(spark: SparkSession, path: str, model_uid: str, features: Sequence[str]) -> DataFrame:
    """SRC-8: train and test rows of a run (partition-pruned), model features only."""
    return spark.read.parquet(path).where(F.col("model_uid") == model_uid).select(*features)
