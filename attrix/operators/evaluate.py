"""Binary-classifier evaluation over a predictions DataFrame.

Input convention: one row per scored observation with an integer ``label``
(0/1), a positive-class probability ``prob`` and, where a metric needs hard
classes, ``predicted_class``.  Every curve and rank statistic is computed
from the distributed prefix kernel (``kernels.label_counts``); nothing is
sorted in one task and no negative x positive pairs are formed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.functions.stats import ks_pvalue
from attrix.operators.aggregates import with_scalar
from attrix.session import materialize
from attrix.operators.kernels import (
    _n_ranges,
    bin_of,
    cumulate,
    exact_quantiles,
    hash_order,
    label_counts,
    qcut,
    qcut_edges,
    row_numbers,
    uniform_hash_cuts,
)

# Fixed values used by the reference service and training scripts.
CLASS_CUTOFF = 0.50
CALIBRATION_BINS = [10, 25, 50, 100]
LOG_LOSS_EPS = 1e-15
METRIC_NAMES = ["log_loss", "brier_score_loss", "roc_auc", "f1", "balanced_accuracy_score"]


def predictions_frame(df: DataFrame, prob: str = "prob", cutoff: float = CLASS_CUTOFF) -> DataFrame:
    """EVL-1: add ``prob_0 = 1 - prob`` and ``predicted_class = prob >= cutoff``."""
    return df.withColumn("prob_0", 1.0 - F.col(prob)).withColumn(
        "predicted_class", F.when(F.col(prob) >= cutoff, 1).otherwise(0)
    )


# ---------------------------------------------------------------- scalar metrics
def log_loss_expr(label: str = "label", prob: str = "prob") -> Column:
    p = F.least(F.greatest(F.col(prob), F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    return -F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1.0 - p)))


def brier_expr(label: str = "label", prob: str = "prob") -> Column:
    return F.avg(F.pow(F.col(prob) - F.col(label), 2))


def _conf(label: str, cls: str):
    y, c = F.col(label), F.col(cls)
    tp = F.sum(F.when((y == 1) & (c == 1), 1).otherwise(0))
    fp = F.sum(F.when((y == 0) & (c == 1), 1).otherwise(0))
    fn = F.sum(F.when((y == 1) & (c == 0), 1).otherwise(0))
    tn = F.sum(F.when((y == 0) & (c == 0), 1).otherwise(0))
    return tp, fp, fn, tn


def f1_expr(label: str = "label", cls: str = "predicted_class") -> Column:
    tp, fp, fn, _ = _conf(label, cls)
    den = 2 * tp + fp + fn
    return F.when(den == 0, F.lit(0.0)).otherwise(2.0 * tp / den)


def balanced_accuracy_expr(label: str = "label", cls: str = "predicted_class") -> Column:
    tp, fp, fn, tn = _conf(label, cls)
    tpr = F.try_divide(tp, tp + fn)
    tnr = F.try_divide(tn, tn + fp)
    return F.when(tpr.isNull(), tnr).when(tnr.isNull(), tpr).otherwise((tpr + tnr) / 2.0)


def roc_auc(df: DataFrame, label: str = "label", prob: str = "prob", groups: Sequence[str] = ()) -> DataFrame:
    """EVL-3: Mann-Whitney AUC with half credit for ties, per group."""
    return _auc(label_counts(df, groups, prob, label), groups)


def _auc(k: DataFrame, groups: Sequence[str]) -> DataFrame:
    contrib = F.col("neg") * (F.col("tot_pos") - F.col("cum_pos")) + 0.5 * F.col("neg") * F.col("pos")
    return k.groupBy(*groups).agg(
        F.try_divide(F.sum(contrib), F.max("tot_pos") * F.max("tot_neg")).alias("roc_auc"),
    )


def score_cells(
    df: DataFrame, label: str = "label", prob: str = "prob", cls: str = "predicted_class", groups: Sequence[str] = ()
) -> DataFrame:
    """The score table: (groups, prob, cls, pos, neg), written once.  Rows with one
    score are one row, and every metric, curve and calibration follows from it."""
    positive = F.col(label) == 1
    cells = df.groupBy(*groups, F.col(prob).alias("prob"), F.col(cls).alias("cls")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("pos"), F.sum(F.when(positive, 0).otherwise(1)).alias("neg")
    )
    return materialize(cells, "score-cells")


def cell_scores(cells: DataFrame, groups: Sequence[str] = (), metrics: Sequence[str] = tuple(METRIC_NAMES)) -> DataFrame:
    """Metrics of ``score_cells``: wide, with ``observations`` and ``n_pos``."""
    groups = list(groups)
    pos, neg, prob = F.col("pos"), F.col("neg"), F.col("prob")
    p = F.least(F.greatest(prob, F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    scored = F.sum(F.when(prob.isNotNull(), pos + neg))
    hit = F.col("cls") == 1
    tp, fp = F.sum(F.when(hit, pos).otherwise(0)), F.sum(F.when(hit, neg).otherwise(0))
    missed = F.col("cls") == 0
    fn, tn = F.sum(F.when(missed, pos).otherwise(0)), F.sum(F.when(missed, neg).otherwise(0))
    tpr, tnr = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    simple = {
        "log_loss": -F.sum(pos * F.log(p) + neg * F.log(1.0 - p)) / scored,
        "brier_score_loss": F.sum(pos * F.pow(prob - 1, 2) + neg * F.pow(prob, 2)) / scored,
        "f1": F.when(2 * tp + fp + fn == 0, F.lit(0.0)).otherwise(2.0 * tp / (2 * tp + fp + fn)),
        "balanced_accuracy_score": F.when(tpr.isNull(), tnr).when(tnr.isNull(), tpr).otherwise((tpr + tnr) / 2.0),
    }
    wide = cells.groupBy(*groups).agg(
        F.sum(pos + neg).alias("observations"), F.sum(pos).cast("long").alias("n_pos"), *[simple[m].alias(m) for m in metrics if m in simple]
    )
    if "roc_auc" not in metrics:
        return wide
    auc = _auc(cumulate(cells, groups, "prob", {"pos": pos, "neg": neg}), groups)
    return wide.join(auc, groups, "left") if groups else with_scalar(wide, auc)


def metric_scores(
    df: DataFrame,
    label: str = "label",
    prob: str = "prob",
    cls: str = "predicted_class",
    groups: Sequence[str] = (),
    metrics: Sequence[str] = tuple(METRIC_NAMES),
    scorers: Mapping[str, Callable[[str, str, str], Column]] | None = None,
) -> DataFrame:
    """UDF-3 metric registry applied per group: long form ``groups..., metric, score``
    plus ``observations`` and class counts ``n_pos``/``n_neg``, from the score table.

    ``scorers`` adds metrics of the caller's own: name -> f(label, prob, class
    column), an aggregate over the rows."""
    groups = list(groups)
    wide = cell_scores(score_cells(df, label, prob, cls, groups), groups, metrics)
    names = list(metrics)
    if scorers:
        own = df.groupBy(*groups).agg(*[f(label, prob, cls).alias(name) for name, f in scorers.items()])
        wide = wide.join(own, groups, "left") if groups else with_scalar(wide, own)
        names += list(scorers)
    wide = wide.withColumn("n_neg", F.col("observations") - F.col("n_pos"))
    return wide.unpivot([*groups, "observations", "n_pos", "n_neg"], names, "metric", "score")


def metric_table(df: DataFrame, model_uid: str, label="label", prob="prob", cls="predicted_class", scorers=None) -> DataFrame:
    """EVL-7: (scoring_metric, holdout_score, model_uid, holdout_type='test')."""
    m = metric_scores(df, label, prob, cls, scorers=scorers)
    return m.select(
        F.col("metric").alias("scoring_metric"),
        F.col("score").alias("holdout_score"),
        F.lit(model_uid).alias("model_uid"),
        F.lit("test").alias("holdout_type"),
    )


# ---------------------------------------------------------------- curves
def roc_points(df: DataFrame, label: str = "label", prob: str = "prob", groups: Sequence[str] = ()) -> DataFrame:
    """EVL-8: (threshold, fpr, tpr) per distinct score, descending, plus the
    starting point (max score + 1, 0, 0).  Collinear points are kept."""
    groups = list(groups)
    k = label_counts(df, groups, prob, label)
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    pts = k.select(
        *groups,
        F.col(prob).alias("threshold"),
        F.try_divide(fp, F.col("tot_neg")).alias("fpr"),
        F.try_divide(tp, F.col("tot_pos")).alias("tpr"),
    )
    start = k.groupBy(*groups).agg(
        (F.max(prob) + 1.0).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return pts.unionByName(start)


def optimal_cutoff(df: DataFrame, label: str = "label", prob: str = "prob", groups: Sequence[str] = ()) -> DataFrame:
    """EVL-9: threshold maximising tpr - fpr (highest threshold on ties)."""
    pts = roc_points(df, label, prob, groups)
    best = F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(F.col("tpr") - F.col("fpr"), F.col("threshold")))
    return pts.groupBy(*groups).agg(best.alias("b")).select(
        *groups,
        F.col("b.threshold").alias("optimal_threshold"),
        F.col("b.tpr").alias("best_tpr"),
        F.col("b.fpr").alias("best_fpr"),
    )


def gains_points(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """EVL-12: cumulative gains and lift for both classes at each distinct score.

    Class 1 ranks rows by ``prob`` descending, class 0 by ``1 - prob``
    descending (i.e. ``prob`` ascending).  ``percentage`` is the share of rows
    ranked at or above the score, ``gain`` the share of the class captured,
    ``lift = gain / percentage``.
    """
    k = cumulate(
        df,
        [],
        prob,
        {
            "cnt": F.lit(1).cast("long"),
            "pos": F.when(F.col(label) == 1, 1).otherwise(0).cast("long"),
            "neg": F.when(F.col(label) == 1, 0).otherwise(1).cast("long"),
        },
    )
    c1_pct = F.try_divide(F.col("tot_cnt") - F.col("cum_cnt") + F.col("cnt"), F.col("tot_cnt"))
    c1_gain = F.try_divide(F.col("tot_pos") - F.col("cum_pos") + F.col("pos"), F.col("tot_pos"))
    c0_pct = F.try_divide(F.col("cum_cnt"), F.col("tot_cnt"))
    c0_gain = F.try_divide(F.col("cum_neg"), F.col("tot_neg"))
    one = k.select(
        F.lit(1).alias("class"), F.col(prob).alias("threshold"), c1_pct.alias("percentage"), c1_gain.alias("gain")
    )
    zero = k.select(
        F.lit(0).alias("class"),
        (1.0 - F.col(prob)).alias("threshold"),
        c0_pct.alias("percentage"),
        c0_gain.alias("gain"),
    )
    return one.unionByName(zero).withColumn("lift", F.try_divide(F.col("gain"), F.col("percentage")))


def concordance(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """EVL-13: exact concordant/discordant counts over all negative x positive
    pairs, ties counted as discordant (the reference's rule), without forming pairs."""
    k = label_counts(df, [], prob, label)
    disc = F.col("pos") * (F.col("tot_neg") - F.col("cum_neg") + F.col("neg"))
    a = k.agg(
        F.sum(disc).alias("discordant_pairs"),
        (F.max("tot_pos") * F.max("tot_neg")).alias("pairs"),
    )
    return a.select(
        F.col("pairs").cast("long").alias("pairs"),
        F.col("discordant_pairs").cast("long").alias("discordant_pairs"),
        (1.0 - F.try_divide(F.col("discordant_pairs"), F.col("pairs"))).alias("concordant_discordant_ratio"),
        F.try_divide(F.col("pairs") - 2 * F.col("discordant_pairs"), F.col("pairs")).alias("somers_d"),
    )


def ks_curve_points(df: DataFrame, label: str = "label", prob: str = "prob", groups: Sequence[str] = ()) -> DataFrame:
    """EVL-15: empirical CDF of each class at every distinct score."""
    k = label_counts(df, groups, prob, label)
    return k.select(
        *groups,
        F.col(prob).alias("threshold"),
        F.try_divide(F.col("cum_pos"), F.col("tot_pos")).alias("cdf_pos"),
        F.try_divide(F.col("cum_neg"), F.col("tot_neg")).alias("cdf_neg"),
        F.col("tot_pos"),
        F.col("tot_neg"),
    )


def ks_by_class(df: DataFrame, label: str = "label", prob: str = "prob", groups: Sequence[str] = ()) -> DataFrame:
    """EVL-14: two-sample KS statistic of scores, positives vs negatives, and p."""
    c = ks_curve_points(df, label, prob, groups)
    a = c.groupBy(*groups).agg(
        F.max(F.abs(F.col("cdf_pos") - F.col("cdf_neg"))).alias("ks_statistic"),
        F.max("tot_pos").alias("n_pos"),
        F.max("tot_neg").alias("n_neg"),
    )
    return a.select(*groups, "ks_statistic", ks_pvalue(F.col("ks_statistic"), "n_pos", "n_neg").alias("p_value"))


# ---------------------------------------------------------------- tables
def confusion_counts(df: DataFrame, label: str, cls: str) -> DataFrame:
    tp, fp, fn, tn = _conf(label, cls)
    return df.agg(
        tn.cast("long").alias("tn"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), tp.cast("long").alias("tp")
    )


def _rates(d: DataFrame) -> DataFrame:
    return d.withColumn("fpr_pct", F.round(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")) * 100.0, 2)).withColumn(
        "fnr_pct", F.round(F.try_divide(F.col("fn"), F.col("fn") + F.col("tp")) * 100.0, 2)
    )


def confusion_table(df: DataFrame, label: str = "label", prob: str = "prob", cutoff: float = CLASS_CUTOFF) -> DataFrame:
    """EVL-16 / AGG-10: confusion counts and FPR/FNR % for the fixed cutoff
    and for the optimal (Youden) cutoff."""
    fixed = confusion_counts(df.withColumn("_c", F.when(F.col(prob) >= cutoff, 1).otherwise(0)), label, "_c")
    fixed = fixed.select(F.lit("predicted_class").alias("class_column"), F.lit(float(cutoff)).alias("cutoff"), "*")
    opt = optimal_cutoff(df, label, prob).select(F.col("optimal_threshold").alias("_t"))
    j = with_scalar(df, opt).withColumn("_c", F.when(F.col(prob) >= F.col("_t"), 1).otherwise(0))
    tp, fp, fn, tn = _conf(label, "_c")
    best = j.agg(
        F.lit("optimal_predicted_class").alias("class_column"),
        F.max("_t").alias("cutoff"),
        tn.cast("long").alias("tn"),
        fp.cast("long").alias("fp"),
        fn.cast("long").alias("fn"),
        tp.cast("long").alias("tp"),
    )
    return _rates(fixed.unionByName(best))


def calibration_table(
    df: DataFrame,
    label: str = "label",
    prob: str = "prob",
    n_bins: int = 10,
    strategy: str = "uniform",
) -> DataFrame:
    """EVL-11: one calibration curve, see ``calibration_tables``."""
    return calibration_tables(df, label, prob, [n_bins], [strategy])


def calibration_tables(
    df: DataFrame, label: str = "label", prob: str = "prob", bins: Sequence[int] = tuple(CALIBRATION_BINS), strategies: Sequence[str] = ("uniform", "quantile")
) -> DataFrame:
    """EVL-11: calibration curve points (non-empty bins only) of each number of bins and strategy.

    Bins are left-closed as in ``np.digitize``: uniform edges j*(1+1e-8)/n;
    quantile edges are exact linear quantiles at j/n with the top edge
    padded by 1e-8.  Output: n_bins, strategy, bin, prob_true, prob_pred, count.
    All quantiles come from one call over the score table, and each score goes
    to its bins in one pass.
    """
    unknown = set(strategies) - {"uniform", "quantile"}
    if unknown:
        raise ValueError(f"unknown strategy {sorted(unknown)}")
    rows = df.withColumn("_cls", F.lit(0))
    cells = score_cells(rows, label, prob, "_cls").where("prob IS NOT NULL")
    edges: dict[float, float] = {}
    if "quantile" in strategies:
        probs = sorted({j / n for n in bins for j in range(1, n)})
        counted = cells.withColumn("_n", F.col("pos") + F.col("neg"))
        edges = {r["q"]: r["quantile"] for r in exact_quantiles(counted, [], "prob", probs, count="_n").collect()}
    places = []
    for n in bins:
        for s in strategies:
            step = (1.0 + 1e-8) / n
            cuts = [j * step for j in range(1, n + 1)] if s == "uniform" else [edges[j / n] for j in range(1, n) if j / n in edges]
            cuts = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
            at = F.aggregate(cuts, F.lit(0), lambda acc, e: acc + F.when(F.col("prob") >= e, 1).otherwise(0))
            places.append(F.struct(F.lit(n).alias("n_bins"), F.lit(s).alias("strategy"), at.alias("bin")))
    long = cells.select("prob", "pos", "neg", F.explode(F.array(*places)).alias("_b"))
    n = F.sum(F.col("pos") + F.col("neg"))
    return long.groupBy("_b.n_bins", "_b.strategy", "_b.bin").agg(
        (F.sum("pos") / n).alias("prob_true"),
        (F.sum(F.col("prob") * (F.col("pos") + F.col("neg"))) / n).alias("prob_pred"),
        n.alias("count"),
    )


def class_lift(df: DataFrame, label: str = "label", cls: str = "predicted_class") -> DataFrame:
    """EVL-18: precision of the predicted positives divided by the base rate."""
    tp, fp, fn, tn = _conf(label, cls)
    return df.agg(F.try_divide(F.try_divide(tp, tp + fp), F.try_divide(tp + fn, tp + fp + fn + tn)).alias("lift"))


def probability_lift(df: DataFrame, label: str = "label", prob: str = "prob", n_bins: int = 10) -> DataFrame:
    """EVL-19: sum |base - mean y| / sum |mean p - mean y| over qcut bins of prob."""
    binned = qcut(df, prob, n_bins, out="_bin")
    per_bin = binned.groupBy("_bin").agg(F.avg(prob).alias("p"), F.avg(F.col(label).cast("double")).alias("y"))
    base = df.agg(F.avg(F.col(label).cast("double")).alias("base"))
    j = with_scalar(per_bin, base)
    return j.agg(
        F.try_divide(F.sum(F.abs(F.col("base") - F.col("y"))), F.sum(F.abs(F.col("p") - F.col("y")))).alias("lift")
    )


def density_points(df: DataFrame, value: str, groups: Sequence[str] = (), grid: int = 200, cut: float = 3.0) -> DataFrame:
    """EVL-20: Gaussian KDE on a ``grid``-point support (Scott bandwidth,
    support min - cut*bw .. max + cut*bw).  A constant column has no bandwidth:
    its density is null.

    Exact: rows are first reduced to (value, count), so the work is
    #distinct values x grid; each distinct value gives its kernel at all points
    (no join against the grid), summed up where it is first.
    """
    groups = list(groups)
    d = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    dv = d.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c"))
    st = d.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"),
        F.stddev_samp("_v").alias("_sd"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    ).withColumn("_bw", F.col("_sd") * F.pow(F.col("_n"), -0.2))
    # written, so that its size is known: a row a group, which no shuffle of the values by group need wait for
    j = dv.join(materialize(st, "density-groups"), groups) if groups else with_scalar(dv, st)
    lo = F.col("_lo") - cut * F.col("_bw")
    hi = F.col("_hi") + cut * F.col("_bw")
    pts = j.select(
        *groups, "_v", "_c", "_n", "_bw", lo.alias("_a"), hi.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point")
    ).withColumn("x", F.col("_a") + F.col("point") * (F.col("_b") - F.col("_a")) / (grid - 1))
    kern = F.col("_c") * F.exp(-0.5 * F.pow(F.try_divide(F.col("x") - F.col("_v"), F.col("_bw")), 2))
    return pts.groupBy(*groups, "point", "x").agg(
        F.try_divide(F.sum(kern), F.max("_n") * F.max("_bw") * F.lit((2 * 3.141592653589793) ** 0.5)).alias("density")
    )


# ---------------------------------------------------------------- bootstrap
def bootstrap_scores(
    df: DataFrame,
    key: str = "key",
    label: str = "label",
    prob: str = "prob",
    cls: str = "predicted_class",
    samples: int = 30,
    metrics: Sequence[str] = tuple(METRIC_NAMES),
) -> DataFrame:
    """EVL-17: ``samples`` draws of int(n / samples) rows without replacement;
    each draw takes the rows with the smallest md5(key-sample) order, so the
    draw is deterministic and identical in any engine.  Each metric is
    scored per draw and described (count, mean, std, min, quartiles, max).

    Rows are expanded per draw and filtered map-side to a hash band that holds
    the draw with overwhelming probability; the exact m-smallest selection is
    then a distributed row number per draw.  If a band ever holds fewer than m
    rows, that draw is recomputed from the full data.
    """
    n = df.count()
    m = n // samples
    ids = F.sequence(F.lit(0), F.lit(samples - 1))
    frac = min(1.0, (m + 10 * m**0.5 + 100) / max(n, 1))
    band = int(frac * (1 << 60))
    # the hashes of a row are filtered before it is copied
    drawn_by = F.filter(F.transform(ids, lambda i: F.struct(i.alias("sample"), hash_order(F.col(key), i).alias("h"))), lambda e: e["h"] < F.lit(band))
    cand = materialize(df.select("*", F.explode(drawn_by).alias("_d")).select(*df.columns, "_d.sample", F.col("_d.h").alias("_h")), "bootstrap-candidates")
    short = [r["sample"] for r in cand.groupBy("sample").count().where(F.col("count") < m).select("sample").collect()]
    if short:
        again = df.select("*", F.explode(F.array(*[F.lit(i) for i in short])).alias("sample")).withColumn("_h", hash_order(F.col(key), F.col("sample")))
        cand = cand.where(~F.col("sample").isin(short)).unionByName(again)
    ranked = row_numbers(cand, ["_h", key], ["sample"], cuts=uniform_hash_cuts(_n_ranges(cand, None)))
    drawn = ranked.where(F.col("rn") <= m).drop("rn", "_h")
    scores = metric_scores(drawn, label, prob, cls, ["sample"], metrics)
    return describe(scores, ["metric"], "score")


def describe(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """pandas ``describe`` of a small per-group series (exact quartiles)."""
    return df.groupBy(*groups).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.percentile(value, 0.25).alias("p25"),
        F.percentile(value, 0.5).alias("p50"),
        F.percentile(value, 0.75).alias("p75"),
        F.max(value).alias("max"),
    )


def metrics_by_partition(
    preds: DataFrame,
    features: DataFrame,
    key: str = "key",
    label: str = "label",
    prob: str = "prob",
    cls: str = "predicted_class",
    categorical: Sequence[str] = (),
    numeric: Sequence[str] = (),
    numeric_bins: int = 10,
    drop_cols: Sequence[str] = (),
    metrics: Sequence[str] = tuple(METRIC_NAMES),
) -> DataFrame:
    """EVL-10: every metric on every categorical level and every qcut bin of
    every numeric feature; partitions holding one class are skipped.

    Output: metric, score, partition ('<feature>_<level>'; numeric levels are
    'q<bin>' and 'nan' for missing values, as pandas renders a NaN bin),
    observations.  One key join, one explode into (feature, level), and one
    grouped score table that all metrics come from — no per-feature loop.
    """
    cats = [c for c in categorical if c not in drop_cols]
    nums = [c for c in numeric if c not in drop_cols]
    # read by the quantile kernel and for the score table: materialise once
    j = materialize(preds.select(key, label, prob, cls).join(features.select(key, *cats, *nums), key), "by-partition")
    levels = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cats]
    if nums:
        # numeric_bins - 1 edges a column become literals, so no row joins them
        long = j.select(*[F.col(c).cast("double").alias(c) for c in nums]).unpivot([], nums, "feature", "_x")
        edges = {r["feature"]: r["edges"] for r in qcut_edges(long, ["feature"], "_x", numeric_bins).collect()}
        for c in nums:
            x, cuts = F.col(c).cast("double"), F.array(*[F.lit(float(e)) for e in edges.get(c, [])]).cast("array<double>")
            level = F.when(x.isNull(), F.lit("nan")).otherwise(F.concat(F.lit("q"), bin_of(x, cuts).cast("string")))
            levels.append(F.struct(F.lit(c).alias("feature"), level.alias("level")))
    long_all = j.select(label, prob, cls, F.explode(F.array(*levels)).alias("_l")).select(label, prob, cls, "_l.feature", "_l.level").where("level IS NOT NULL")
    sc = metric_scores(long_all, label, prob, cls, ["feature", "level"], metrics)
    return sc.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(
        "metric",
        "score",
        F.concat_ws("_", "feature", "level").alias("partition"),
        "observations",
    )


def evaluate_all(
    preds: DataFrame,
    model_uid: str,
    features: DataFrame | None = None,
    categorical: Sequence[str] = (),
    numeric: Sequence[str] = (),
    key: str = "key",
    label: str = "label",
    prob: str = "prob",
) -> dict[str, DataFrame]:
    """EVL-21: every evaluation table of a model, by name.  The predictions
    frame is read by ~15 reports, so it is materialised once first."""
    p = materialize(predictions_frame(preds.select(key, label, prob), prob), "predictions")
    out = {
        "metric_table": metric_table(p, model_uid, label, prob),
        "density": density_points(p, prob),
        "bootstrap": bootstrap_scores(p, key, label, prob),
        "calibration": None,
        "optimal_cutoff": optimal_cutoff(p, label, prob),
        "confusion": confusion_table(p, label, prob),
        "roc": roc_points(p, label, prob),
        "class_lift": class_lift(p, label),
        "probability_lift": probability_lift(p, label, prob),
        "gains": gains_points(p, label, prob),
        "ks": ks_by_class(p, label, prob),
        "ks_curve": ks_curve_points(p, label, prob),
        "concordance": concordance(p, label, prob),
    }
    out["calibration"] = calibration_tables(p, label, prob)
    if features is not None:
        out["by_partition"] = metrics_by_partition(
            p, features, key, label, prob, categorical=categorical, numeric=numeric
        )
    return out
