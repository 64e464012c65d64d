"""Feature matrix stages: persistable Estimators over the library's own statistics (survey ENC-9, ENC-11).

Each fitted model is a table (a row a column, or a row a level) that is saved
in the model folder and joined when the model is applied; levels never pass
through the driver.  Statistics follow the reference: mean imputation,
population sigma, ANOVA F and class-sum chi-square with the same percentile
rule, and a variance filter.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.operators.encoders import LOWEST, CombineSparseLevels, TableModel, chi2_from_counts, class_shares, level_class_counts, select_percentile
from attrix.operators.kernels import row_numbers
from attrix.operators.projections import conform_schema
from attrix.session import materialize

NUMERIC, CATEGORICAL, FEATURES = "_numeric", "_categorical", "features"


class ConformSchema(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """PRJ-1 as a stage: the mapped columns with their types (missing ones are
    null), and those of ``keep`` (key, label) that are there."""

    mapping = Param(Params._dummy(), "mapping", "JSON object: column to type", TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "other columns that stay", TypeConverters.toListString)

    @keyword_only
    def __init__(self, mapping=None, keep=None):
        super().__init__()
        self._setDefault(keep=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        types = json.loads(self.getOrDefault(self.mapping))
        kept = {c: dataset.schema[c].dataType.simpleString() for c in self.getOrDefault(self.keep) if c in dataset.columns and c not in types}
        return conform_schema(dataset, {**kept, **types})


def keeping(model: Transformer, columns: Sequence[str]) -> Transformer:
    """The model with these columns passing through its conform step, if it has one."""
    if not isinstance(model, PipelineModel):
        return model
    stages = [
        s.copy({s.keep: [*s.getOrDefault(s.keep), *columns]}) if isinstance(s, ConformSchema) else keeping(s, columns) for s in model.stages
    ]
    return PipelineModel(stages=stages)


class _ColumnParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "class column", TypeConverters.toString)
    percentile = Param(Params._dummy(), "percentile", "share of the columns or levels to select, in percent", TypeConverters.toFloat)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    def _columns(self) -> list[str]:
        """By name: the order of slots, and of ties at the selectors' threshold."""
        return sorted(self.getOrDefault(self.inputCols))


def _vector(df: DataFrame, values: Sequence[Column], name: str) -> DataFrame:
    """A vector column of known size, so that an assembler needn't look at a row (a stream has none)."""
    out = df.withColumn(name, array_to_vector(F.array(*values).cast("array<double>")))
    return VectorSizeHint(inputCol=name, size=len(values), handleInvalid="optimistic").transform(out)


def chosen_features(scores: Mapping[str, float | None], percentile: float) -> set[str]:
    """The rule of ``select_percentile`` for a score a column, ties by name."""
    plain = {f: LOWEST if x is None else x for f, x in scores.items()}
    if percentile >= 100 or percentile <= 0 or not plain:
        return set(plain) if percentile >= 100 else set()
    ranked = sorted(plain.values())
    at = (len(ranked) - 1) * (1.0 - percentile / 100.0)
    low = math.floor(at)
    cut = ranked[low] + (at - low) * (ranked[min(low + 1, len(ranked) - 1)] - ranked[low])
    above = {f for f, x in plain.items() if x > cut}
    room = max(int(len(plain) * percentile / 100.0) - len(above), 0)
    return above | set(sorted(f for f, x in plain.items() if x == cut)[:room])


class NumericFeatures(Estimator, _ColumnParams, DefaultParamsReadable, DefaultParamsWritable):
    """Mean imputation, scaling by the population sigma, selection by ANOVA F,
    and no column without variance.  One pass over the rows."""

    @keyword_only
    def __init__(self, inputCols=None, labelCol="label", percentile=10.0, outputCol=NUMERIC):
        super().__init__()
        self._setDefault(labelCol="label", percentile=10.0, outputCol=NUMERIC)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "NumericFeaturesModel":
        cols = self._columns()
        label = F.col(self.getOrDefault(self.labelCol))
        long = dataset.select(label.alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["_y"], cols, "feature", "x")
        x = F.nanvl("x", F.lit(None).cast("double"))
        per = long.select("feature", "_y", x.alias("x")).groupBy("feature", "_y").agg(
            F.count(F.lit(1)).alias("rows"), F.count("x").alias("known"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")
        )
        per = materialize(per, "class-moments")  # a row a (column, class)
        known = per.where("known > 0")
        means = known.groupBy("feature").agg((F.sum(F.col("known") * F.col("mean")) / F.sum("known")).alias("fill"))
        # rows without a value have the mean: moments of the imputed column by class
        j = per.join(means, "feature")
        filled = j.select(
            "feature",
            "fill",
            "rows",
            F.when(F.col("known") > 0, (F.col("known") * F.col("mean") + (F.col("rows") - F.col("known")) * F.col("fill")) / F.col("rows"))
            .otherwise(F.col("fill"))
            .alias("m"),
            "known",
            F.coalesce("mean", "fill").alias("mean"),
            F.coalesce("var", F.lit(0.0)).alias("var"),
        )
        within = F.col("known") * (F.col("var") + F.pow(F.col("mean") - F.col("m"), 2)) + (F.col("rows") - F.col("known")) * F.pow(F.col("fill") - F.col("m"), 2)
        s = filled.groupBy("feature").agg(
            F.max("fill").alias("mean"),
            F.sum("rows").alias("n"),
            F.count(F.lit(1)).alias("k"),
            F.sum(F.col("rows") * F.pow(F.col("m") - F.col("fill"), 2)).alias("ssb"),
            F.sum(within).alias("ssw"),
        )
        score = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k")))
        s = s.select("feature", "mean", F.sqrt((F.col("ssb") + F.col("ssw")) / F.col("n")).alias("sigma"), score.alias("score"))
        found = s.collect()  # a row a column
        chosen = chosen_features({r["feature"]: r["score"] for r in found}, self.getOrDefault(self.percentile))
        rows = [(*r, r["feature"] in chosen, r["feature"] in chosen and r["sigma"] > 0) for r in found]
        schema = "feature string, mean double, sigma double, score double, selected boolean, kept boolean"
        return NumericFeaturesModel(
            materialize(dataset.sparkSession.createDataFrame(rows, schema), "numeric-features"),
            inputCols=self.getOrDefault(self.inputCols),
            outputCol=self.getOrDefault(self.outputCol),
        )


class NumericFeaturesModel(TableModel, _ColumnParams):
    """Table: (feature, mean, sigma, score, selected, kept), a row a column."""

    def kept(self) -> list:
        """Rows of the kept columns in the order of their slots: as many as the schema has columns, at most."""
        return self.table.where("kept").orderBy("feature").collect()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def scaled(r):
            x = F.nanvl(F.col(r["feature"]).cast("double"), F.lit(None).cast("double"))
            return (F.coalesce(x, F.lit(r["mean"])) - F.lit(r["mean"])) / F.lit(r["sigma"])

        return _vector(dataset, [scaled(r) for r in self.kept()], self.getOrDefault(self.outputCol))


class CategoricalFeatures(Estimator, _ColumnParams, DefaultParamsReadable, DefaultParamsWritable):
    """Indicators of the levels selected by class-sum chi-square that not all rows have."""

    @keyword_only
    def __init__(self, inputCols=None, labelCol="label", percentile=10.0, outputCol=CATEGORICAL):
        super().__init__()
        self._setDefault(labelCol="label", percentile=10.0, outputCol=CATEGORICAL)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "CategoricalFeaturesModel":
        label, cols = self.getOrDefault(self.labelCol), self._columns()
        scores = chi2_from_counts(level_class_counts(dataset, label, cols), class_shares(dataset, label))
        scores = scores.withColumn("feature", F.concat_ws("=", "column", "level"))
        chosen = select_percentile(scores, self.getOrDefault(self.percentile), "feature")
        total = dataset.count()
        chosen = materialize(chosen.withColumn("kept", F.col("selected") & (F.col("n") < total)), "level-scores")
        slots = row_numbers(chosen.where("kept").select("column", "level"), ["level"], ["column"], out="_rn")
        slots = slots.select(F.col("column").alias("_c"), F.col("level").alias("_l"), (F.col("_rn") - 1).alias("slot"))
        table = materialize(chosen.join(slots, (F.col("column") == F.col("_c")) & (F.col("level") == F.col("_l")), "left").drop("_c", "_l"), "level-features")
        sizes = {r["column"]: r["k"] for r in table.where("kept").groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
        return CategoricalFeaturesModel(
            table,
            inputCols=self.getOrDefault(self.inputCols),
            outputCol=self.getOrDefault(self.outputCol),
            sizes=[int(sizes.get(c, 0)) for c in cols],
        )


class CategoricalFeaturesModel(TableModel, _ColumnParams):
    """Table: (column, level, feature, score, n, selected, kept, slot), a row a level."""

    sizes = Param(Params._dummy(), "sizes", "kept levels of each column, by name", TypeConverters.toListInt)

    def used(self) -> list[tuple[str, int]]:
        return [(c, k) for c, k in zip(self._columns(), self.getOrDefault(self.sizes)) if k]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        used, out = self.used(), dataset
        at, hot = ([f"_{kind}_{i}" for i in range(len(used))] for kind in ("at", "hot"))
        for (c, size), name in zip(used, at):
            levels = self.table.where(F.col("kept") & (F.col("column") == c)).select(F.col("level").alias("_level"), F.col("slot").alias("_slot"))
            # levels that aren't kept, and unseen ones, have the slot that the encoder drops
            out = out.join(levels, out[c].cast("string") == levels["_level"], "left")
            out = out.withColumn(name, F.coalesce("_slot", F.lit(size)).cast("double")).drop("_level", "_slot")
        if not used:
            return _vector(out, [], self.getOrDefault(self.outputCol))
        largest = dataset.sparkSession.createDataFrame([tuple(float(size) for _, size in used)], at)
        encoder = OneHotEncoder(inputCols=at, outputCols=hot, dropLast=True, handleInvalid="error").fit(largest)
        joined = VectorAssembler(inputCols=hot, outputCol=self.getOrDefault(self.outputCol))
        return joined.transform(encoder.transform(out)).drop(*at, *hot)


# ---------------------------------------------------------------- ENC-11
def feature_stages(
    numeric: Sequence[str],
    categorical: Sequence[str],
    date_col: str | None = None,
    clips: Sequence[tuple[str, float, float, str]] = (),
    ratios: Sequence[tuple[str, str]] = (),
    log_cols: Sequence[str] = (),
    num_percentile: float = 10.0,
    cat_percentile: float = 10.0,
    combine_cutoff: float = 0.001,
    combine: str = "yes",
    conform: Mapping[str, str] | None = None,
    keep: Sequence[str] = ("key", "label", "split", "_weight"),
    label: str = "label",
) -> list:
    """ENC-11: the preprocessing chain as persistable stages: conform -> SQL
    feature steps (clips, ratios, logs, date parts, fill) -> sparse-level
    combining -> numeric branch (impute, scale, F selection) and categorical
    branch (one-hot, chi-square selection), each without constant columns ->
    ``features``.  ``conform`` maps columns to types; with it, other columns
    than these and ``keep`` are dropped first."""
    sel = ["*"]
    num = list(numeric)
    clipped: dict[str, str] = {}
    for c, cut, new, kind in clips:
        op = ">" if kind == "upper" else "<"
        x = clipped.get(c, f"`{c}`")  # bounds of one column apply one after the other
        clipped[c] = f"(CASE WHEN {x} {op} {cut} THEN {new} ELSE {x} END)"
    sel += [f"{x} AS `{c}__clip`" for c, x in clipped.items()]
    for a, b in ratios:
        x, y = (clipped.get(c, f"`{c}`") for c in (a, b))  # the reference clips first
        sel.append(f"try_divide(CAST({x} AS DOUBLE), nullif(CAST({y} AS DOUBLE), 0D)) AS `{a}_{b}_ratio`")
        num.append(f"{a}_{b}_ratio")
    for c in log_cols:
        x = clipped.get(c, f"`{c}`")
        sel.append(f"CASE WHEN {x} = 0 THEN 0D WHEN {x} > 0 THEN ln({x}) END AS `{c}__log`")
    cats = list(categorical)
    if date_col:
        d = f"try_to_date(`{date_col}`)"
        sel += [f"CAST(month({d}) AS STRING) AS month", f"concat('q', quarter({d})) AS quarter", f"CAST(year({d}) AS STRING) AS year"]
        cats += ["month", "quarter", "year"]
    # clipped and logged columns stand for the plain ones
    num_out = [f"{c}__log" if c in log_cols else f"{c}__clip" if c in clipped else c for c in num]
    fills = [f"coalesce(nullif(CAST(`{c}` AS STRING), 'nan'), 'missing') AS `{c}{FILLED}`" for c in cats]
    cf = [f"{c}{FILLED}" for c in cats]
    stages = [ConformSchema(mapping=json.dumps(dict(conform)), keep=list(keep))] if conform else []
    stages += [SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__"), SQLTransformer(statement=f"SELECT {', '.join(['*', *fills])} FROM __THIS__")]
    branches = []
    if cf:
        stages.append(CombineSparseLevels(inputCols=cf, cutoff=combine_cutoff, enabled=combine))
    if num_out:
        stages.append(NumericFeatures(inputCols=num_out, labelCol=label, percentile=float(num_percentile)))
        branches.append(NUMERIC)
    if cf:
        stages.append(CategoricalFeatures(inputCols=cf, labelCol=label, percentile=float(cat_percentile)))
        branches.append(CATEGORICAL)
    return [*stages, VectorAssembler(inputCols=branches, outputCol=FEATURES)]


#: Suffix of the filled categorical columns inside the pipeline.
FILLED = "__f"


# ---------------------------------------------------------------- ENC-9
def transform_only(model: PipelineModel) -> PipelineModel:
    """ENC-9: the feature stages alone (the encoded feature matrix)."""
    last = max(i for i, s in enumerate(model.stages) if isinstance(s, (NumericFeaturesModel, CategoricalFeaturesModel)))
    return PipelineModel(stages=model.stages[: last + 2])


def feature_lineage(model: PipelineModel) -> DataFrame:
    """ENC-9: (slot, feature) of the encoded inputs that survive both selectors
    and the variance filter, from the fitted tables: a level may fill a row each."""
    out = SparkSession.active().createDataFrame([], "slot long, feature string")
    start = 0
    for stage in model.stages:
        if isinstance(stage, NumericFeaturesModel):
            names = [r["feature"] for r in stage.kept()]
            if names:
                out = out.unionByName(out.sparkSession.createDataFrame(list(enumerate(names, start)), out.schema))
            start += len(names)
        if isinstance(stage, CategoricalFeaturesModel):
            for c, size in stage.used():
                mine = stage.table.where(F.col("kept") & (F.col("column") == c))
                out = out.unionByName(mine.select((F.col("slot") + F.lit(start)).alias("slot"), F.concat_ws("=", F.lit(c.removesuffix(FILLED)), "level").alias("feature")))
                start += size
    return out


def feature_rows(matrix: DataFrame, lineage: DataFrame, key: str = "key", vector: str = FEATURES) -> DataFrame:
    """(key, feature, value): the non-zero entries of a feature matrix by name."""
    from pyspark.ml.functions import vector_to_array

    long = matrix.select(key, F.posexplode(vector_to_array(vector)).alias("slot", "value")).where("value <> 0")
    return long.join(lineage, "slot").select(key, "feature", "value")
