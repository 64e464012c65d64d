"""Observation-table readers (SRC-1, SRC-2) with null normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

NULL_TEXTS = ("nan", "None")


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN in floating columns and the texts 'nan'/'None' (pandas/DB-API
    artefacts) become SQL NULL, so downstream imputation is a ``coalesce``."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, StringType):
            c = F.when(~c.isin(*NULL_TEXTS), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_observations(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """SRC-1: scan the observation table.  Name the columns you need so the
    scan reads only those (the reference's ``select *`` is not repeated)."""
    df = spark.read.format(fmt).load(path)
    if columns:
        df = df.select(*columns)
    return normalize_nulls(df)


def read_jdbc_observations(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    num_partitions: int,
    properties: dict | None = None,
) -> DataFrame:
    """SRC-1 from a relational source: a partitioned JDBC scan (parallel range
    reads on ``partition_column``) instead of one connection pulling the table."""
    return normalize_nulls(
        spark.read.jdbc(
            url,
            table,
            column=partition_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=num_partitions,
            properties=properties or {},
        )
    )


def read_csv_observations(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """SRC-2: CSV with a header; pass ``schema`` in production (inference
    costs an extra pass over the files)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return normalize_nulls(r.csv(path))
