"""Projections, filters and schema operators (survey section 2.3).

All are narrow transformations (no shuffle) expressed with built-in column
functions so they stay inside whole-stage codegen and filters/projections
push down to the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MISSING = "missing"


def conform_schema(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ-1: keep exactly the mapped columns in mapping order, add missing ones
    as typed nulls and cast the rest (bad values become null, not errors)."""
    present = set(df.columns)
    return df.select(
        *[
            (F.expr(f"try_cast(`{c}` AS {t})") if c in present else F.lit(None).cast(t)).alias(c)
            for c, t in mapping.items()
        ]
    )


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-2."""
    return df.drop(*cols)


def encode_target(df: DataFrame, col: str, rule: str = "equals", positive: str = "yes", out: str | None = None) -> DataFrame:
    """PRJ-3: 1/0 target from a text label, by equality (training) or prefix
    'y' (exploration)."""
    if rule == "equals":
        cond = F.col(col) == positive
    elif rule == "startswith":
        cond = F.col(col).startswith(positive[:1])
    else:
        raise ValueError("rule must be 'equals' or 'startswith'")
    return df.withColumn(out or col, F.when(cond, 1).otherwise(0))


def split_xy(df: DataFrame, target: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """PRJ-4: predictors and target, both keyed."""
    return df.drop(target), df.select(key, target)


def columns_by_type(df: DataFrame, kind: str) -> list[str]:
    """PRJ-5: numeric or non-numeric column names (schema walk, no data)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if kind == "numeric":
        return num
    if kind == "non_numeric":
        return [c for c in df.columns if c not in num]
    raise ValueError("kind must be 'numeric' or 'non_numeric'")


def fill_missing(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    """PRJ-6: nulls and the literal text 'nan' (a pandas artefact) become ``value``."""
    cols = list(cols) if cols is not None else df.columns
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in cols:
            if isinstance(value, str):
                c = F.coalesce(F.nullif(c.cast("string"), F.lit("nan")), F.lit(value))
            else:
                c = F.coalesce(c, F.lit(value))
        out.append(c.alias(f.name))
    return df.select(*out)


def clip_bounds(df: DataFrame, feature: str, cutoff: float, new_amount: float, clip_type: str) -> DataFrame:
    """PRJ-7: values strictly beyond ``cutoff`` become ``new_amount``; nulls untouched."""
    c = F.col(feature)
    if clip_type == "upper":
        cond = c > cutoff
    elif clip_type == "lower":
        cond = c < cutoff
    else:
        raise ValueError("clip_type must either be upper or lower")
    return df.withColumn(feature, F.when(cond, F.lit(new_amount)).otherwise(c))


def map_values(df: DataFrame, feature: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """PRJ-8: dictionary map; unmapped values become null.  A literal map for
    small dictionaries; pass a DataFrame to ``map_values_join`` for large ones."""
    if not mapping:
        return df.withColumn(out or feature, F.lit(None))
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out or feature, F.try_element_at(m, F.col(feature)))


def map_values_join(df: DataFrame, feature: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """PRJ-8 for large dictionaries: left join (Spark/AQE broadcasts it when small)."""
    m = mapping.select(F.col(key).alias("_mk"), F.col(value).alias("_mv"))
    return df.join(m, df[feature] == m["_mk"], "left").withColumn(feature, F.col("_mv")).drop("_mk", "_mv")


def ratio_column(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """PRJ-9: ``<c1>_<c2>_ratio``; a zero or null divisor gives null (then imputed)."""
    return df.withColumn(f"{c1}_{c2}_ratio", F.try_divide(F.col(c1).cast("double"), F.nullif(F.col(c2).cast("double"), F.lit(0.0))))


def take_log(df: DataFrame, cols: Sequence[str], enabled: str = "yes") -> DataFrame:
    """PRJ-10: natural log; log(0) (-inf) becomes 0; log of a negative value is
    missing; any flag other than 'yes' is the identity."""
    if enabled != "yes":
        return df
    for c in cols:
        x = F.col(c).cast("double")
        df = df.withColumn(c, F.when(x == 0, F.lit(0.0)).when(x > 0, F.log(x)))
    return df


def threshold_class(df: DataFrame, prob: str, cutoff: float, out: str = "predicted_class", labels=(1, 0)) -> DataFrame:
    """PRJ-11: ``prob >= cutoff`` -> labels[0] else labels[1] (1/0 or 'yes'/'no')."""
    return df.withColumn(out, F.when(F.col(prob) >= cutoff, F.lit(labels[0])).otherwise(F.lit(labels[1])))


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """PRJ-12: IN-list for a literal list; a DataFrame of values becomes a
    left-semi join (broadcast by AQE when small)."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias("_in"))
        return df.join(v, df[col] == v["_in"], "left_semi")
    return df.where(F.col(col).isin(list(values)))


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """PRJ-13."""
    return df.where(F.col(col) == value)


def tag_rows(df: DataFrame, **values) -> DataFrame:
    """PRJ-14: constant columns."""
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df


def unpivot_features(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "variable", val: str = "value"):
    """PRJ-15: wide -> long (nulls kept, as ``melt``)."""
    return df.unpivot(list(ids), list(cols), var, val)


def pivot_folds(df: DataFrame, ids: Sequence[str], fold: str, value: str, n_folds: int) -> DataFrame:
    """PRJ-16: fold scores -> fold_0..fold_{n-1} columns (explicit level list, no extra pass)."""
    p = df.groupBy(*ids).pivot(fold, list(range(n_folds))).agg(F.first(value))
    return p.select(*ids, *[F.col(f"`{i}`").alias(f"fold_{i}") for i in range(n_folds)])


def one_key_record(df: DataFrame, cols: Sequence[str], out: str = "record") -> DataFrame:
    """PRJ-17: columns -> one JSON object per row (for export)."""
    return df.withColumn(out, F.to_json(F.struct(*[F.col(c) for c in cols])))


def rename_reorder(df: DataFrame, renames: Mapping[str, str], order: Sequence[str] | None = None) -> DataFrame:
    """PRJ-18."""
    for a, b in renames.items():
        df = df.withColumnRenamed(a, b)
    return df.select(*order) if order else df


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
