"""Result sinks (SNK-1, SNK-3, SNK-4, SNK-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame

RESULT_TABLES = ("model_metadata", "model_score", "feature_score", "data_shift", "concept_shift")


def append_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-1: append a result table (model scores, feature scores, drift rows)."""
    df.write.mode("append").format(fmt).save(path)


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """SNK-1 to a relational store (batched inserts from every partition)."""
    df.write.mode("append").jdbc(url, table, properties=properties or {})


def export_csv(df: DataFrame, path: str) -> None:
    """SNK-3: diagnostics as CSV with a header (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_pipeline(model, path: str) -> None:
    """SNK-4: persist a fitted ``PipelineModel`` under the run directory."""
    model.write().overwrite().save(path)


def create_table_from(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """SNK-6: create a table from a DataFrame (schema from the DataFrame) and
    read it back for validation."""
    w = df.write.mode("overwrite")
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)
