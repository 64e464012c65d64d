"""Encoders and feature selection (survey section 2.5).

Fit-side statistics are single grouped aggregations over an unpivoted frame;
the fitted state is a small table (levels, means, scores) applied with a
join or literal expressions.  ``FrameStage`` (UDF-1) lifts any
``DataFrame -> DataFrame`` function into a ``pyspark.ml`` Transformer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.operators.aggregates import with_scalar
from attrix.operators.kernels import exact_quantiles, row_numbers
from attrix.session import materialize

SPARSE_LABEL = "sparse_combined"
SPARSITY_CUTOFF = 0.001
LOWEST = -1.7976931348623157e308


# ---------------------------------------------------------------- ENC-1
def sparse_levels(df: DataFrame, features: Sequence[str], cutoff: float = SPARSITY_CUTOFF) -> DataFrame:
    """Fit: (feature, level) pairs whose share of the column's non-null rows
    is <= cutoff (inclusive, as the reference)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in features]).unpivot(
        [], list(features), "feature", "level"
    ).where(F.col("level").isNotNull())
    c = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("_c"))
    # one total a column, from the counts: the rows are read once
    totals = c.groupBy("feature").agg(F.sum("_c").alias("_t"))
    return c.join(totals, "feature").where(F.col("_c") / F.col("_t") <= cutoff).select("feature", "level")


def combine_sparse_levels(df: DataFrame, sparse: DataFrame, features: Sequence[str]) -> DataFrame:
    """Apply: fitted sparse levels -> 'sparse_combined'; levels unseen at fit
    time pass through.  One left join per column against its slice of the
    (usually small, then broadcast by AQE) sparse table."""
    out = df
    for c in features:
        s = sparse.where(F.col("feature") == c).select(F.col("level").alias("_sl"), F.lit(True).alias("_hit"))
        out = (
            out.join(s, out[c].cast("string") == s["_sl"], "left")
            .withColumn(c, F.when(F.col("_hit"), F.lit(SPARSE_LABEL)).otherwise(F.col(c)))
            .drop("_sl", "_hit")
        )
    return out


# ---------------------------------------------------------------- ENC-2 / ENC-3 long forms
def one_hot_long(df: DataFrame, key: str, categorical: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """ENC-2 (dictionary vectoriser) in long form: (key, feature, value) with
    'col=value' -> 1.0 for strings (nulls and unseen levels contribute
    nothing) and numeric columns passed through under their own name."""
    cat = df.select(key, *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
        [key], list(categorical), "_c", "_v"
    ).where(F.col("_v").isNotNull()).select(key, F.concat_ws("=", "_c", "_v").alias("feature"), F.lit(1.0).alias("value"))
    if not numeric:
        return cat
    num = df.select(key, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [key], list(numeric), "feature", "value"
    ).where(F.col("value").isNotNull())
    return cat.unionByName(num)


# ---------------------------------------------------------------- ENC-4 / ENC-5
def impute_mean(df: DataFrame, cols: Sequence[str], means: DataFrame | None = None) -> DataFrame:
    """ENC-4: nulls -> training mean (``means``: one row of ``<col>`` means; fit on df if omitted)."""
    means = means if means is not None else df.agg(*[F.avg(c).alias(c) for c in cols])
    m = means.select(*[F.col(c).alias(f"_m_{c}") for c in cols])
    j = with_scalar(df, m)
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")))
    return j.drop(*[f"_m_{c}" for c in cols])


def standard_scale(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """ENC-5: (x - mean) / population sigma; a zero sigma divides by 1 (nulls stay null)."""
    stats = stats if stats is not None else df.agg(
        *[F.avg(c).alias(f"_mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols]
    )
    j = with_scalar(df, stats)
    for c in cols:
        sd = F.when(F.col(f"_sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_sd_{c}"))
        j = j.withColumn(c, (F.col(c) - F.col(f"_mu_{c}")) / sd)
    return j.drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


# ---------------------------------------------------------------- ENC-6 / ENC-7 / ENC-8
def select_percentile(scores: DataFrame, percentile: float, order: str = "position") -> DataFrame:
    """Column ``selected``: scores above the (100 - p)th linear percentile of all
    scores; ties at the threshold fill up to int(n * p / 100) features by ``order``
    (a unique column).

    ``scores`` has a row a feature, which can be a row a level, so the threshold
    comes from the quantile kernel and ties get distributed row numbers.  A
    feature without a score (no variance) counts as the lowest."""
    if percentile >= 100 or percentile <= 0:
        return scores.withColumn("selected", F.lit(percentile >= 100))
    scores = materialize(scores.withColumn("_s", F.coalesce("score", F.lit(LOWEST))), "feature-scores")
    row = exact_quantiles(scores, [], "_s", [1.0 - percentile / 100.0]).first()
    if row is None:
        return scores.drop("_s").withColumn("selected", F.lit(False))
    cut = F.lit(float(row["quantile"]))
    n, above = scores.agg(F.count(F.lit(1)), F.count(F.when(F.col("_s") > cut, 1))).first()
    room = int(n * percentile / 100.0) - above
    ties = row_numbers(scores.where(F.col("_s") == cut), [order], out="_rn").where(F.col("_rn") <= room)
    ties = ties.select(F.col(order).alias("_tie"), F.lit(True).alias("_in"))
    j = scores.join(ties, scores[order] == ties["_tie"], "left")
    return j.withColumn("selected", F.coalesce((F.col("_s") > cut) | F.col("_in"), F.lit(False))).drop("_tie", "_in", "_s")


def f_classif_scores(df: DataFrame, label: str, features: Sequence[str], percentile: float = 10) -> DataFrame:
    """ENC-6: one-way ANOVA F per numeric feature vs the class, then
    SelectPercentile.  F = (SSB / (k - 1)) / (SSW / (n - k)) with
    SSB = sum n_c (mean_c - mean)^2 and SSW = sum n_c var_pop_c.
    The scores table has one row per feature (its window is tiny)."""
    long = df.select(F.col(label).alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        ["_y"], list(features), "feature", "x"
    ).where(F.col("x").isNotNull())
    per = long.groupBy("feature", "_y").agg(
        F.count(F.lit(1)).alias("nc"), F.avg("x").alias("mc"), F.var_pop("x").alias("vc")
    )
    tot = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    j = per.join(tot, "feature")
    s = j.groupBy("feature").agg(
        F.sum(F.col("nc") * F.pow(F.col("mc") - F.col("m"), 2)).alias("ssb"),
        F.sum(F.col("nc") * F.col("vc")).alias("ssw"),
        F.count(F.lit(1)).alias("k"),
        F.max("n").alias("n"),
    )
    f = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k")))
    pos = F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(c), F.lit(i))])
    scores = s.select("feature", f.alias("score"), F.element_at(pos, F.col("feature")).alias("position"))
    return select_percentile(scores, percentile)


def level_class_counts(df: DataFrame, label: str, categorical: Sequence[str]) -> DataFrame:
    """(column, level, class, obs): rows of each non-null level by class; the label
    goes through the unpivot, so rows are read once and shuffled as partial counts."""
    long = df.select(F.col(label).alias("_y"), *[F.col(c).cast("string").alias(c) for c in categorical])
    long = long.unpivot(["_y"], list(categorical), "column", "level").where(F.col("level").isNotNull())
    return long.groupBy("column", "level", "_y").agg(F.count(F.lit(1)).cast("double").alias("obs"))


def chi2_from_counts(obs: DataFrame, classes: DataFrame) -> DataFrame:
    """(column, level, score, n) from ``level_class_counts`` and ``class_shares``.

    With e = share * n, the sum of (o - e)^2 / e over all classes is that of
    o^2 / e less n, and a class without the level adds nothing to the former."""
    g = obs.join(classes, obs["_y"].eqNullSafe(classes["class"])).groupBy("column", "level").agg(
        F.sum(F.try_divide(F.col("obs") * F.col("obs"), F.col("share"))).alias("_q"), F.sum("obs").alias("n")
    )
    return g.select("column", "level", (F.col("_q") / F.col("n") - F.col("n")).alias("score"), F.col("n").cast("long").alias("n"))


def class_shares(df: DataFrame, label: str) -> DataFrame:
    """(class, share): one row a class."""
    ny = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("_ny"))
    return with_scalar(ny, ny.agg(F.sum("_ny").alias("_n"))).select("class", (F.col("_ny") / F.col("_n")).alias("share"))


def chi2_scores(df: DataFrame, label: str, key: str, categorical: Sequence[str], percentile: float = 10) -> DataFrame:
    """ENC-7: scikit-learn's chi2 on one-hot indicators: observed = per-class
    sum of the feature, expected = class share x feature total;
    chi2 = sum (obs - exp)^2 / exp.  Built from sparse (feature, class) counts."""
    s = chi2_from_counts(level_class_counts(df, label, categorical), class_shares(df, label))
    s = s.select(F.concat_ws("=", "column", "level").alias("feature"), "score")
    return select_percentile(s.withColumn("position", F.col("feature")), percentile)


def variance_filter(df: DataFrame, key: str, categorical: Sequence[str], numeric: Sequence[str], threshold: float = 0.0):
    """ENC-8: population variance of each encoded column (one-hot indicators
    from their shares, numerics directly); keep when variance > threshold."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    oh = one_hot_long(df, key, categorical).groupBy("feature").agg(F.sum("value").alias("ones"))
    p = F.col("ones") / F.col("n")
    cat = with_scalar(oh, n).select("feature", (p - p * p).alias("variance"))
    parts = [cat]
    if numeric:
        num = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in numeric]).unpivot(
            [], list(numeric), "feature", "variance"
        )
        parts.append(num)
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out.withColumn("keep", F.col("variance") > threshold)


# ---------------------------------------------------------------- ENC-10
def non_dummy_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ENC-10: (column, is_dummy): a column is a dummy when every non-null
    value is exactly 0 or 1 — one aggregation pass, no distinct."""
    a = df.agg(
        *[
            F.coalesce(F.max(F.when(~F.col(c).cast("double").isin(0.0, 1.0), 1)), F.lit(0)).alias(c)
            for c in cols
        ]
    )
    return a.unpivot([], list(cols), "column", "_bad").select("column", (F.col("_bad") == 0).alias("is_dummy"))


# ---------------------------------------------------------------- UDF-1 / UDF-2 stages
class FrameStage(Transformer):
    """UDF-1: any ``DataFrame -> DataFrame`` function as a pipeline stage
    (not persistable; use SQL-expressible stages for saved pipelines)."""

    def __init__(self, fn: Callable[..., DataFrame], **kwargs):
        super().__init__()
        self.fn, self.kwargs = fn, kwargs

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fn(dataset, **self.kwargs)


class TableModel(Model, MLReadable, MLWritable):
    """A fitted model whose state is one table, kept beside its parameters.

    Fitting leaves the table in the shared folder and ``save`` copies it into
    the model folder, so its rows (levels of a column, say) never pass through
    the driver; applying joins it.
    """

    def __init__(self, table: DataFrame | None = None, **params):
        super().__init__()
        self.table = table
        self._set(**params)

    def write(self) -> MLWriter:
        return _TableModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableModelReader(cls)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.table = self.table
        return that


class _TableModelWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table.write.parquet(f"{path}/table")


class _TableModelReader(MLReader):
    def __init__(self, cls: type[TableModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _LevelParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "categorical columns", TypeConverters.toListString)
    cutoff = Param(Params._dummy(), "cutoff", "sparsity cutoff (share <= cutoff)", TypeConverters.toFloat)
    enabled = Param(Params._dummy(), "enabled", "'yes' to combine", TypeConverters.toString)


class CombineSparseLevels(Estimator, _LevelParams, DefaultParamsReadable, DefaultParamsWritable):
    """UDF-2 / ENC-1 as an Estimator; the sparse levels are the model's table."""

    @keyword_only
    def __init__(self, inputCols=None, cutoff=SPARSITY_CUTOFF, enabled="yes"):
        super().__init__()
        self._setDefault(cutoff=SPARSITY_CUTOFF, enabled="yes")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "CombineSparseLevelsModel":
        cols = self.getOrDefault(self.inputCols)
        levels = materialize(sparse_levels(dataset, cols, self.getOrDefault(self.cutoff)), "sparse-levels")
        return CombineSparseLevelsModel(levels, inputCols=cols, enabled=self.getOrDefault(self.enabled))


class CombineSparseLevelsModel(TableModel, _LevelParams):
    """Table: (feature, level) pairs to combine."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getOrDefault(self.enabled) != "yes":
            return dataset
        return combine_sparse_levels(dataset, self.table, self.getOrDefault(self.inputCols))
