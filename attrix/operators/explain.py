"""Model explanation (survey section 2.13).

A *scorer* is ``score_df(df) -> df`` adding a ``_score`` column (the positive
probability); ``expr_scorer`` wraps a closed-form Column expression and
``model_scorer`` a fitted ``pyspark.ml`` model.  Every explanation is built
as one DataFrame job: the rows to score (permuted, grid-substituted or
hybrid rows) are generated with joins/explodes, scored once in bulk, and
aggregated — no per-feature or per-row driver loop.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.operators.aggregates import attach_rows, with_scalar
from attrix.operators.evaluate import LOG_LOSS_EPS
from attrix.operators.kernels import exact_quantiles, hash_order, row_numbers
from attrix.operators.permute import permuted_scores
from attrix.session import materialize

ScoreFn = Callable[[DataFrame], DataFrame]
PDP_GRID = 100
PDP_PERCENTILES = (0.05, 0.95)
ALE_GRID = 20


def expr_scorer(expr: Callable[[], Column]) -> ScoreFn:
    return lambda df: df.withColumn("_score", expr())


def model_scorer(model, prob_col: str = "probability") -> ScoreFn:
    """Positive-class probability of a fitted pyspark.ml model (Vector column)."""
    from pyspark.ml.functions import vector_to_array

    def f(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        keep = df.columns
        return out.select(*keep, vector_to_array(F.col(prob_col))[1].alias("_score"))

    return f


def _neg_log_loss(label: str) -> Column:
    p = F.least(F.greatest(F.col("_score"), F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    return F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1.0 - p)))


# ---------------------------------------------------------------- XPL-1 / XPL-2
def linear_shapley(df: DataFrame, key: str, coefs: Mapping[str, float], intercept: float = 0.0) -> DataFrame:
    """XPL-1 closed form for a linear (log-odds) model: shap_j = b_j (x_j - mean_j)
    (missing x treated as the mean), expected_value = b0 + sum b_j mean_j.
    Long form (key, feature, shap, expected_value); contributions add up to
    margin(x) - expected_value."""
    feats = list(coefs)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in feats])
    ev = F.lit(float(intercept))
    for c in feats:
        ev = ev + F.lit(float(coefs[c])) * F.col(f"_m_{c}")
    j = with_scalar(df.select(key, *feats), means)
    items = [
        F.struct(
            F.lit(c).alias("feature"),
            (F.lit(float(coefs[c])) * (F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) - F.col(f"_m_{c}"))).alias("shap"),
        )
        for c in feats
    ]
    return j.select(key, F.explode(F.array(*items)).alias("_s"), ev.alias("expected_value")).select(
        key, "_s.feature", "_s.shap", "expected_value"
    )


def sampled_shapley(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    score_df: ScoreFn,
    background: DataFrame,
    permutations: int = 10,
) -> DataFrame:
    """XPL-1 for any model: permutation-sampling Shapley values.

    For each row and permutation, a background row z is picked by hash and
    F + 1 hybrid rows are built (the first s features of the permutation from
    x, the rest from z); all are scored in one ``score_df`` call and the
    score differences of consecutive hybrids are the contributions.  The
    background is a small sample (its size is the caller's bound) and goes to
    the rows, never the other way round: the exploded rows look small to the
    optimizer.  Output (key, feature, shap); per row the values add up to
    f(x) - mean over permutations of f(z)."""
    feats = list(features)
    nf = len(feats)
    bg = row_numbers(background.select(*feats), feats, out="_bid")  # ties are equal rows
    n_bg = bg.agg(F.count(F.lit(1)).alias("_nbg"))
    rows = df.select(key, *feats).select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_perm"))
    rows = with_scalar(rows, n_bg).withColumn("_bid", (hash_order(F.col(key), F.col("_perm")) % F.col("_nbg")) + 1)
    z = bg.select("_bid", *[F.col(c).alias(f"_z_{c}") for c in feats])
    rows = rows.join(F.broadcast(z), "_bid")
    # sort_array compares the structs as they are, array_sort calls a function for each pair
    by_name = sorted(range(nf), key=lambda i: feats[i])
    order = F.sort_array(
        F.array(*[F.struct(hash_order(F.col(key), F.col("_perm"), F.lit(feats[i])).alias("h"), F.lit(n).alias("f")) for n, i in enumerate(by_name)])
    )
    rows = rows.withColumn("_ord", order.getField("f"))
    # the place of each feature in the permutation, from 1
    places = [F.array_position("_ord", F.lit(n)).cast("int").alias(f"_at_{i}") for n, i in enumerate(by_name)]
    placed = rows.select(key, *feats, *[f"_z_{c}" for c in feats], *places)
    steps = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("_step"))
    hybrid = steps.select(
        key,
        "_step",
        *[f"_at_{i}" for i in range(nf)],
        *[F.when(F.col(f"_at_{i}") <= F.col("_step"), F.col(c)).otherwise(F.col(f"_z_{c}")).alias(c) for i, c in enumerate(feats)],
    )
    scored = score_df(hybrid)
    # a hybrid's score counts for the feature just added and against the next one
    signed = [
        F.sum(F.when(F.col(f"_at_{i}") == F.col("_step"), F.col("_score")).when(F.col(f"_at_{i}") == F.col("_step") + 1, -F.col("_score")))
        for i in range(nf)
    ]
    total = scored.groupBy(key).agg(*[s.alias(f"_s_{i}") for i, s in enumerate(signed)])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"_s_{i}") / F.lit(float(permutations))).alias("shap")) for i, c in enumerate(feats)])
    return total.select(key, F.explode(items).alias("_s")).select(key, "_s.feature", "_s.shap")


def global_importance(shap: DataFrame, model_uid: str = "model") -> DataFrame:
    """XPL-2: mean |shap| per feature (feature_score table layout)."""
    return shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("importance_score")).select(
        F.lit(model_uid).alias("model_uid"),
        "feature",
        "importance_score",
        F.lit("mean_abs_shap").alias("importance_metric"),
    )


# ---------------------------------------------------------------- XPL-4
def permutation_importance(
    df: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    score_df: ScoreFn,
    repeats: int = 10,
    shuffle: str = "bijection",
) -> DataFrame:
    """XPL-4: baseline neg log loss minus the score after permuting one
    feature, mean and population std over ``repeats`` permutations.

    With ``shuffle`` "hash" row i by key gives its value to the row whose rank by
    md5(key-feature-repeat) is i: the rows and the values of a range of hashes meet
    in one exchange, a few permutations at a time when there are many rows
    (``permuted_scores``).  With "bijection" a permutation is ``slot * a + b mod n``
    over the row numbers by key, with a prime to n: nothing is sorted for it, one
    join sends the values, and all permuted copies are scored in one pass."""
    feats = list(features)
    if shuffle not in ("hash", "bijection"):
        raise ValueError(f"unknown shuffle {shuffle!r}")
    numbered = row_numbers(df.withColumn("_key", F.col(key)), ["_key"], out="_slot").withColumn("_slot", F.col("_slot") - 1).drop("_key")
    base = score_df(df).agg(_neg_log_loss(label).alias("_base"))
    # every input column passes through, so any model can score the copies
    if shuffle == "hash":
        per = permuted_scores(numbered, key, df.columns, feats, repeats, lambda copies: score_df(copies).groupBy("_pair").agg(_neg_log_loss(label).alias("_s")))
    else:
        slots = materialize(numbered, "permutation-rows")
        n = slots.count()
        sent = [
            F.struct(F.pmod(F.col("_slot") * F.lit(a) + F.lit(b), F.lit(max(n, 1))).alias("_to"), F.lit(c).alias("feature"), F.lit(r).alias("rep"), F.col(c).cast("double").alias("donor"))
            for c, r, a, b in slot_bijections(feats, repeats, n)
        ]
        donors = slots.select(F.explode(F.array(*sent)).alias("_d")).select("_d.*")
        j = donors.join(slots, donors["_to"] == slots["_slot"])
        j = j.select(
            "feature",
            "rep",
            *[
                F.when(F.col("feature") == c, F.col("donor")).otherwise(F.col(c).cast("double")).alias(c)
                if c in feats
                else F.col(c)
                for c in df.columns
            ],
        )
        per = score_df(j).groupBy("feature", "rep").agg(_neg_log_loss(label).alias("_s"))
    imp = with_scalar(per, base).withColumn("_imp", F.col("_base") - F.col("_s"))
    return imp.groupBy("feature").agg(
        F.avg("_imp").alias("importance_mean"), F.stddev_pop("_imp").alias("importance_std")
    )


def slot_bijections(features: Sequence[str], repeats: int, n: int) -> list[tuple[str, int, int, int]]:
    """(feature, repeat, a, b) with a prime to n, from hashes; a * n stays under 2**62."""
    out = []
    for c in features:
        for r in range(repeats):
            h, g = (int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in (f"{c}-{r}", f"{r}-{c}"))
            a = max(h % max(1, min(n, (1 << 62) // max(n, 1))), 1)
            while math.gcd(a, n) > 1:
                a += 1
            out.append((c, r, a, g % max(n, 1)))
    return out


# ---------------------------------------------------------------- XPL-6 / XPL-7
def pdp_grid(df: DataFrame, feature: str, resolution: int = PDP_GRID, percentiles=PDP_PERCENTILES) -> DataFrame:
    """scikit-learn's grid: the unique values when there are fewer than
    ``resolution``, else ``resolution`` evenly spaced points between the
    scipy-mquantiles percentiles.  Returns (point, grid_value), at most
    ``resolution`` rows."""
    x = df.select(F.col(feature).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    n_unique = x.agg(F.count_distinct("_x").alias("n")).first()["n"]
    if n_unique < resolution:
        u = x.distinct()
        return row_numbers(u, ["_x"], out="point").select((F.col("point") - 1).cast("int").alias("point"), F.col("_x").alias("grid_value"))
    q = exact_quantiles(x, [], "_x", list(percentiles), method="mquantiles")
    ab = q.agg(
        F.max(F.when(F.col("q") == percentiles[0], F.col("quantile"))).alias("_a"),
        F.max(F.when(F.col("q") == percentiles[1], F.col("quantile"))).alias("_b"),
    )
    pts = ab.select("_a", "_b", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))).alias("point"))
    step = (F.col("_b") - F.col("_a")) / (resolution - 1)
    return pts.select(
        F.col("point").cast("int").alias("point"),
        F.when(F.col("point") == resolution - 1, F.col("_b")).otherwise(F.col("point") * step + F.col("_a")).alias("grid_value"),
    )


def _substitute(df: DataFrame, feature: str, grid: DataFrame) -> DataFrame:
    # the grid has at most ``resolution`` rows: collected and exploded per row
    return attach_rows(df, grid, limit=None).withColumn(feature, F.col("grid_value"))


def partial_dependence(df: DataFrame, feature: str, score_df: ScoreFn, resolution: int = PDP_GRID) -> DataFrame:
    """XPL-6: average prediction with ``feature`` set to each grid value."""
    grid = pdp_grid(df, feature, resolution)
    s = score_df(_substitute(df, feature, grid))
    return s.groupBy("point", "grid_value").agg(F.avg("_score").alias("average")).select(
        F.lit(feature).alias("feature"), "point", "grid_value", "average"
    )


def ice_curves(df: DataFrame, key: str, feature: str, score_df: ScoreFn, resolution: int = PDP_GRID) -> DataFrame:
    """XPL-7: per-row prediction at each grid value (individual curves)."""
    grid = pdp_grid(df, feature, resolution)
    s = score_df(_substitute(df, feature, grid))
    return s.select(key, "point", "grid_value", F.col("_score").alias("prediction"))


# ---------------------------------------------------------------- XPL-8
def ale(df: DataFrame, feature: str, score_df: ScoreFn, grid: int = ALE_GRID) -> DataFrame:
    """XPL-8: first-order accumulated local effects.

    Edges: distinct 'lower' quantiles at j/grid; bin k holds (e_{k-1}, e_k]
    (the minimum goes to bin 1); each row is scored with the feature at both
    edges of its bin; effects are averaged per bin, accumulated and centred by
    the count-weighted mean of adjacent-edge averages.  Output (point k,
    edge e_k, ale, size) for k = 0..K."""
    x = df.where(F.col(feature).isNotNull())
    q = exact_quantiles(x, [], feature, [j / grid for j in range(grid + 1)], method="lower")
    edges = q.agg(F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("_e"))
    j = with_scalar(x, edges)
    b = F.greatest(F.lit(1), F.aggregate("_e", F.lit(0), lambda acc, e: acc + F.when(e < F.col(feature), 1).otherwise(0)))
    j = j.withColumn("_bin", b)
    lo = j.withColumn(feature, F.element_at("_e", F.col("_bin"))).withColumn("_side", F.lit(0))
    hi = j.withColumn(feature, F.element_at("_e", F.col("_bin") + 1)).withColumn("_side", F.lit(1))
    s = score_df(lo.unionByName(hi))
    signed = F.when(F.col("_side") == 1, F.col("_score")).otherwise(-F.col("_score"))
    per_bin = s.groupBy("_bin").agg(
        (F.sum(signed) / F.sum(F.when(F.col("_side") == 1, 1).otherwise(0))).alias("eff"),
        F.sum(F.when(F.col("_side") == 1, 1).otherwise(0)).alias("size"),
    )
    # at most ``grid`` bins: the cumulative window is over a tiny table
    w = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    acc = per_bin.withColumn("ale", F.sum("eff").over(w)).withColumn(
        "ale_prev", F.coalesce(F.lag("ale").over(Window.orderBy("_bin")), F.lit(0.0))
    )
    centre = acc.agg(
        (F.sum((F.col("ale_prev") + F.col("ale")) / 2.0 * F.col("size")) / F.sum("size")).alias("_c")
    )
    pts = acc.select(F.col("_bin").alias("point"), "ale", "size").unionByName(
        edges.select(F.lit(0).alias("point"), F.lit(0.0).alias("ale"), F.lit(0).cast("long").alias("size"))
    )
    pts = with_scalar(with_scalar(pts, edges), centre)
    return pts.select(
        F.lit(feature).alias("feature"),
        "point",
        F.element_at("_e", F.col("point") + 1).alias("edge"),
        (F.col("ale") - F.col("_c")).alias("ale"),
        "size",
    )


# ---------------------------------------------------------------- XPL-3 / XPL-5 (MLlib fits)
def embedded_scores(model, feature_names: Sequence[str]) -> list[tuple[str, float]]:
    """XPL-3: coefficients squashed to (-1, 1) by (sigmoid(c) - 0.5) / 0.5, or
    impurity importances of tree ensembles; other models raise."""
    if hasattr(model, "coefficients"):
        vals = [(1.0 / (1.0 + math.exp(-c)) - 0.5) / 0.5 for c in model.coefficients.toArray().tolist()]
    elif hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        raise TypeError("model has neither coefficients nor feature importances")
    return sorted(zip(feature_names, vals), key=lambda t: -t[1])


def drop_column_importance(
    train: DataFrame,
    test: DataFrame,
    label: str,
    columns: Sequence[str],
    make_pipeline: Callable[[Sequence[str]], object],
    parallelism: int = 2,
    metric: Callable[[str], Column] | None = None,
) -> list[tuple[str, float]]:
    """XPL-5: refit without each column; importance = the metric with all
    columns minus the metric without it, as it is (log loss by default, an
    aggregate over ``label`` and ``_score``); a failed refit counts as 0.  Fits run
    from a small driver thread pool, each one a distributed MLlib job."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.functions import vector_to_array

    measure = metric or (lambda y: -_neg_log_loss(y))

    def score(model):
        s = model.transform(test).withColumn("_score", vector_to_array("probability")[1])
        return float(s.agg(measure(label).alias("s")).first()["s"])

    base = score(make_pipeline(list(columns)).fit(train))

    def one(c):
        try:
            model = make_pipeline([x for x in columns if x != c]).fit(train)
        except Exception as e:  # noqa: BLE001  (a pipeline can fail in any way: no column left, no level selected)
            warnings.warn(f"the refit without {c} failed and counts as 0: {e}", stacklevel=2)
            return c, 0.0
        return c, base - score(model)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        res = list(pool.map(one, columns))
    return sorted(res, key=lambda t: -t[1])


def explain_all(df: DataFrame, key: str, label: str, features: Sequence[str], score_df: ScoreFn,
                background_n: int = 100, sample_n: int | None = None, model_uid: str = "model", model=None,
                make_pipeline: Callable[[Sequence[str]], object] | None = None, train: DataFrame | None = None) -> dict[str, DataFrame]:
    """XPL-9: explanations on all rows, or on the first ``sample_n`` in md5
    order when the caller asks for a sample.

    ``model`` (a fitted pipeline) adds its embedded scores, and if it ends with
    trees their exact Shapley values take the place of the sampled ones;
    ``make_pipeline`` and ``train`` add the importance of columns by refits."""
    from attrix.operators.windows import head_hash_ordered

    s = materialize(df if sample_n is None else head_hash_ordered(df, key, sample_n), "explain-rows")
    spark = df.sparkSession
    if model is not None and has_trees(model.stages[-1]):
        from attrix.operators.trees import model_shapley

        shap = model_shapley(s, key, model)
    else:
        shap = sampled_shapley(s, key, features, score_df, head_hash_ordered(s, key, background_n, seed=1))
    out = {
        "shap": shap,
        "global_importance": global_importance(shap, model_uid),
        "permutation_importance": permutation_importance(s, key, label, features, score_df, shuffle="hash"),
    }
    if model is not None:
        from attrix.operators.stages import feature_lineage

        names = [r["feature"] for r in feature_lineage(model).orderBy("slot").collect()]
        out["embedded_scores"] = spark.createDataFrame(embedded_scores(model.stages[-1], names), "feature string, importance_score double")
    if make_pipeline is not None:
        dropped = drop_column_importance(train if train is not None else s, s, label, features, make_pipeline)
        out["drop_column_importance"] = spark.createDataFrame(dropped, "feature string, importance_score double")
    for c in features:
        out[f"pdp_{c}"] = partial_dependence(s, c, score_df)
        out[f"ice_{c}"] = ice_curves(s, key, c, score_df)
        out[f"ale_{c}"] = ale(s, c, score_df)
    return out


def has_trees(model) -> bool:
    """Whether a fitted classifier is made of trees."""
    return hasattr(model, "trees") or hasattr(model, "depth") or type(model).__name__ == "ExtraTreesModel"
