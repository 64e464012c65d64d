"""Exploratory aggregations (survey section 2.7).

Every per-feature loop of the reference becomes one ``unpivot`` followed by
one grouped aggregation; scalar totals are one-row aggregates evaluated once
and attached as literals, never a window over a whole feature or a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from attrix.operators.kernels import exact_quantiles
from attrix.session import materialize

FILL_UNKNOWN = "unknown"


def with_scalar(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame (an aggregate) to every row.

    The aggregate is evaluated once (one small job, as a scalar subquery would
    be) and attached as typed literals: no join, no repeated subquery, and a
    recomputation after an executor loss sees the same values."""
    row = scalars.first()
    fields = scalars.schema.fields
    vals = [typed_lit(None if row is None else row[f.name], f.dataType).alias(f.name) for f in fields]
    return df.select("*", *vals)


def typed_lit(value, dtype) -> Column:
    """Literal of a collected value with its Spark type.  Zone-free timestamps
    go through their text form (a Python datetime literal would be read as a
    zoned timestamp and shifted by the session zone)."""
    if value is not None and isinstance(dtype, TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(dtype)
    return F.lit(value).cast(dtype)


MAX_ATTACHED_ROWS = 10_000


def attach_rows(df: DataFrame, small: DataFrame, limit: int | None = MAX_ATTACHED_ROWS) -> DataFrame:
    """Pair every row of ``df`` with every row of a *bounded* table (target
    classes, folds x classes, a PDP grid): the table is collected once (its
    size is checked against ``limit``; None when the caller chose the number of
    rows, such as a grid's resolution) and exploded from a literal array, so
    the plan has no cross join."""
    rows = small.collect() if limit is None else small.limit(limit + 1).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"attach_rows: table has more than {limit} rows")
    fields = small.schema.fields
    arr = F.array(
        *[F.struct(*[typed_lit(r[f.name], f.dataType).alias(f.name) for f in fields]) for r in rows]
    )
    if not rows:
        return df.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    return df.select("*", F.explode(arr).alias("_a")).select(*[F.col(f"`{c}`") for c in df.columns], "_a.*")


def long_categorical(df: DataFrame, features: Sequence[str], ids: Sequence[str] = (), fill: str | None = FILL_UNKNOWN):
    """Unpivot categorical features to (ids..., category, level) with nulls filled."""
    cols = [
        (F.coalesce(F.col(c).cast("string"), F.lit(fill)) if fill is not None else F.col(c).cast("string")).alias(c)
        for c in features
    ]
    return df.select(*ids, *cols).unpivot(list(ids), list(features), "category", "level")


def target_balance(df: DataFrame, target: str) -> DataFrame:
    """AGG-1: (level, count, percentage) of the target; the total is that of the counts."""
    counts = materialize(df.groupBy(F.col(target).alias("level")).agg(F.count(F.lit(1)).alias("count")), "target-counts")
    return with_scalar(counts, counts.agg(F.sum("count").alias("_n"))).select("level", "count", (F.col("count") / F.col("_n")).alias("percentage"))


def category_dispersion(df: DataFrame, features: Sequence[str], fill: str = FILL_UNKNOWN) -> DataFrame:
    """AGG-2: per level of each categorical: total_count and share of all rows;
    ``feature`` is '<category>_<level>'.  The levels of one column add up to all rows."""
    long = long_categorical(df, features, fill=fill)
    counts = materialize(long.groupBy("category", "level").agg(F.count(F.lit(1)).alias("total_count")), "level-counts")
    total = counts.where(F.col("category") == features[0]).agg(F.sum("total_count").alias("_n"))
    return with_scalar(counts, total).select(
        F.concat_ws("_", "category", "level").alias("feature"),
        "total_count",
        (F.col("total_count") / F.col("_n")).alias("percentage_of_category_level"),
        "category",
    )


def category_target_connection(
    df: DataFrame, features: Sequence[str], target: str, positive: str = "yes", fill: str = FILL_UNKNOWN
) -> DataFrame:
    """AGG-3: per level, count of positives and actual minus expected positive
    share (expected = overall positive share, from one column's levels).  Only
    levels with positives."""
    long = long_categorical(df, features, ids=[target], fill=fill)
    g = long.groupBy("category", "level").agg(
        F.sum(F.when(F.col(target) == positive, 1).otherwise(0)).cast("long").alias("positive_count"),
        F.count(F.lit(1)).alias("feature_count"),
    )
    g = materialize(g, "level-targets")
    base = g.where(F.col("category") == features[0]).agg((F.sum("positive_count") / F.sum("feature_count")).alias("_p1"))
    return (
        with_scalar(g, base)
        .where(F.col("positive_count") > 0)
        .select(
            F.concat_ws("_", "category", "level").alias("feature"),
            "positive_count",
            (F.col("positive_count") / F.col("feature_count") - F.col("_p1")).alias("diff_from_expectation"),
        )
    )


def _pooled(per: DataFrame, label: str) -> DataFrame:
    """Moments by (level, feature), and those of all rows from them under ``label``."""
    n, mean = F.col("count"), F.col("mean")
    whole = per.groupBy("feature").agg(F.try_divide(F.sum(n * mean), F.sum(n)).alias("_mean"), F.sum(n).alias("_n"))
    spread = F.coalesce((n - 1) * F.col("std") * F.col("std"), F.lit(0.0)) + F.coalesce(n * F.pow(mean - F.col("_mean"), 2), F.lit(0.0))
    total = per.join(whole, "feature").groupBy("feature").agg(
        F.max("_n").alias("count"),
        F.max("_mean").alias("mean"),
        F.when(F.max("_n") > 1, F.sqrt(F.sum(spread) / (F.max("_n") - 1))).alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    each = per.where("level IS NOT NULL").withColumn("_all", F.lit(False))
    return each.unionByName(total.withColumn("level", F.lit(label)).withColumn("_all", F.lit(True)))


def _counted_total(counts: DataFrame, value: str, label: str) -> DataFrame:
    """Value counts (level, feature, value, n), and those of all rows from them under ``label``."""
    total = counts.groupBy("feature", value).agg(F.sum("n").alias("n"))
    each = counts.where("level IS NOT NULL").withColumn("_all", F.lit(False))
    return each.unionByName(total.withColumn("level", F.lit(label)).withColumn("_all", F.lit(True)))


def summary_statistics(
    df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], total_label: str = "total"
) -> DataFrame:
    """AGG-4: pandas ``describe(include='all')`` for all rows ('total') and per
    target level (rows of null level count in the total only; a level that is
    itself called like the total keeps rows of its own), long form: level, feature, count, unique, top, freq, mean,
    std, min, p25, p50, p75, max.  Quartiles are exact (prefix kernel); top
    takes the smallest value among equally frequent ones."""
    lvl = F.col(target).cast("string")
    parts = []
    if numeric:
        nl = df.select(lvl.alias("level"), *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
            ["level"], list(numeric), "feature", "x"
        )
        mom = nl.groupBy("level", "feature").agg(
            F.count("x").alias("count"),
            F.avg("x").alias("mean"),
            F.stddev_samp("x").alias("std"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
        )
        mom = _pooled(materialize(mom, "level-moments"), total_label)
        values = nl.where(F.col("x").isNotNull()).groupBy("level", "feature", "x").agg(F.count(F.lit(1)).alias("n"))
        values = _counted_total(materialize(values, "level-values"), "x", total_label)
        q = (
            exact_quantiles(values, ["_all", "level", "feature"], "x", [0.25, 0.5, 0.75], count="n")
            .groupBy("_all", "level", "feature")
            .pivot("q", [0.25, 0.5, 0.75])
            .agg(F.first("quantile"))
        )
        q = q.select("_all", "level", "feature", *[F.col(f"`{v}`").alias(n) for v, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
        parts.append(
            mom.join(q, ["_all", "level", "feature"], "left").select(
                "level",
                "feature",
                "count",
                F.lit(None).cast("long").alias("unique"),
                F.lit(None).cast("string").alias("top"),
                F.lit(None).cast("long").alias("freq"),
                "mean",
                "std",
                "min",
                "p25",
                "p50",
                "p75",
                "max",
            )
        )
    if categorical:
        cl = df.select(lvl.alias("level"), *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
            ["level"], list(categorical), "feature", "v"
        )
        # a null value keeps its row, so a feature whose values are all null still reports count 0
        counts = materialize(cl.groupBy("level", "feature", "v").agg(F.count(F.lit(1)).alias("n")), "level-values")
        counts = _counted_total(counts, "v", total_label)
        known = F.col("v").isNotNull()
        cat = counts.groupBy("_all", "level", "feature").agg(
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).cast("long").alias("count"),
            F.count("v").alias("unique"),
            F.min_by("v", F.when(known, F.struct((-F.col("n")).alias("nc"), F.col("v")))).alias("top"),
            F.max(F.when(known, F.col("n"))).cast("long").alias("freq"),
        ).select(
            "level",
            "feature",
            "count",
            "unique",
            "top",
            "freq",
            *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
        )
        parts.append(cat)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cluster_summary(df: DataFrame, cluster: str, variables: Sequence[str]) -> DataFrame:
    """AGG-5 / JN-6: mean, sum and non-null count per (cluster, variable) in one aggregation."""
    long = df.select(cluster, *[F.col(c).cast("double").alias(c) for c in variables]).unpivot(
        [cluster], list(variables), "variable", "value"
    )
    return long.groupBy(cluster, "variable").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"),
        F.count("value").alias("count"),
    )


def level_frequency(train: DataFrame, prod: DataFrame, features: Sequence[str], scale: float = 1000.0) -> DataFrame:
    """AGG-6: per feature and level, counts per side scaled to ``scale`` rows
    plus one, full outer join, missing -> 0, truncated to int.

    Levels are counted over non-null values, as pandas ``groupby`` drops NaN.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        long = long_categorical(df, features, fill=None).where(F.col("level").isNotNull())
        c = materialize(long.groupBy("category", "level").agg(F.count(F.lit(1)).alias("_c")), "level-counts")
        tot = c.groupBy("category").agg(F.sum("_c").alias("_t"))
        return c.join(tot, "category").select(
            "category", "level", (F.col("_c") / F.col("_t") * scale + 1.0).alias(name)
        )

    j = side(train, "train_count").join(side(prod, "prod_count"), ["category", "level"], "full_outer")
    return j.select(
        F.col("category").alias("feature"),
        "level",
        F.coalesce("train_count", F.lit(0.0)).cast("int").alias("train_count"),
        F.coalesce("prod_count", F.lit(0.0)).cast("int").alias("prod_count"),
    )


def normalized_value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """AGG-9: share of each level among the non-null values of its feature."""
    long = long_categorical(df, features, fill=None).where(F.col("level").isNotNull())
    c = materialize(long.groupBy("category", "level").agg(F.count(F.lit(1)).alias("count")), "level-counts")
    t = c.groupBy("category").agg(F.sum("count").alias("_t"))
    return c.join(t, "category").select(
        F.col("category").alias("feature"), "level", "count", (F.col("count") / F.col("_t")).alias("share")
    )
