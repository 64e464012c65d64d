"""Evaluation queries (survey section 2.11) on the v_pred / v_obs test views."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrix.functions.stats import kolmogorov_sf_sql
from attrix.operators import evaluate as ev
from attrix.plans import views
from attrix.plans.common import PRED_SQL, preds, r6
from attrix.plans.registry import query

P = f"p AS ({PRED_SQL})"
CLIP = "least(greatest(prob, 1e-15), 1 - 1e-15)"
LL = f"-avg(CASE WHEN label = 1 THEN ln({CLIP}) ELSE ln(1 - {CLIP}) END)"
CONF = """SUM(CASE WHEN label = 1 AND predicted_class = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
       SUM(CASE WHEN label = 0 AND predicted_class = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
       SUM(CASE WHEN label = 1 AND predicted_class = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn,
       SUM(CASE WHEN label = 0 AND predicted_class = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn"""
# kernel over distinct scores, optionally partitioned
KERNEL = """k AS (SELECT {g} prob, SUM(label)::DOUBLE AS pos, SUM(1 - label)::DOUBLE AS neg, COUNT(*)::DOUBLE AS cnt
       FROM {src} GROUP BY {g} prob),
c AS (SELECT *, SUM(pos) OVER (PARTITION BY {pg} ORDER BY prob) AS cum_pos,
              SUM(neg) OVER (PARTITION BY {pg} ORDER BY prob) AS cum_neg,
              SUM(cnt) OVER (PARTITION BY {pg} ORDER BY prob) AS cum_cnt,
              SUM(pos) OVER (PARTITION BY {pg}) AS tot_pos, SUM(neg) OVER (PARTITION BY {pg}) AS tot_neg,
              SUM(cnt) OVER (PARTITION BY {pg}) AS tot_cnt FROM k)"""


def kernel_sql(src: str = "p", groups: str = "") -> str:
    g = f"{groups}, " if groups else ""
    pg = groups if groups else "1"
    return KERNEL.format(g=g, src=src, pg=pg)


AUC = "SUM(neg * (tot_pos - cum_pos) + 0.5 * neg * pos) / (max(tot_pos) * max(tot_neg))"


@query("evl2_log_loss", f"WITH {P} SELECT round({LL}, 6) AS log_loss FROM p", ("v_pred",))
def evl2(spark, d):
    return r6(preds(spark, d).agg(ev.log_loss_expr().alias("log_loss")))


@query("evl3_roc_auc", f"WITH {P}, {kernel_sql()} SELECT round({AUC}, 6) AS roc_auc FROM c", ("v_pred",))
def evl3(spark, d):
    return r6(ev.roc_auc(preds(spark, d)))


@query("evl4_brier_score", f"WITH {P} SELECT round(avg(pow(prob - label, 2)), 6) AS brier_score_loss FROM p", ("v_pred",))
def evl4(spark, d):
    return r6(preds(spark, d).agg(ev.brier_expr().alias("brier_score_loss")))


@query(
    "evl5_f1",
    f"WITH {P}, t AS (SELECT {CONF} FROM p) "
    "SELECT round(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END, 6) AS f1 FROM t",
    ("v_pred",),
)
def evl5(spark, d):
    return r6(preds(spark, d).agg(ev.f1_expr().alias("f1")))


@query(
    "evl6_balanced_accuracy",
    f"WITH {P}, t AS (SELECT {CONF} FROM p) "
    "SELECT round((tp/(tp+fn) + tn/(tn+fp)) / 2, 6) AS balanced_accuracy_score FROM t",
    ("v_pred",),
)
def evl6(spark, d):
    return r6(preds(spark, d).agg(ev.balanced_accuracy_expr().alias("balanced_accuracy_score")))


_METRICS_SQL = f"""
g AS (SELECT {{grp}} count(*) AS observations, SUM(label) AS n_pos, {LL} AS log_loss,
             avg(pow(prob - label, 2)) AS brier_score_loss, {CONF} FROM {{src}} GROUP BY ALL),
auc AS (SELECT {{grp}} {AUC} AS roc_auc FROM c GROUP BY ALL),
m AS (SELECT g.*, auc.roc_auc,
             CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END AS f1,
             CASE WHEN tp+fn = 0 THEN tn/(tn+fp) WHEN tn+fp = 0 THEN tp/(tp+fn)
                  ELSE (tp/(tp+fn) + tn/(tn+fp)) / 2 END AS balanced_accuracy_score
      FROM g JOIN auc ON {{on}}),
u AS (SELECT {{grp}} observations, n_pos, 'log_loss' AS metric, log_loss AS score FROM m
      UNION ALL SELECT {{grp}} observations, n_pos, 'brier_score_loss', brier_score_loss FROM m
      UNION ALL SELECT {{grp}} observations, n_pos, 'roc_auc', roc_auc FROM m
      UNION ALL SELECT {{grp}} observations, n_pos, 'f1', f1 FROM m
      UNION ALL SELECT {{grp}} observations, n_pos, 'balanced_accuracy_score', balanced_accuracy_score FROM m)"""


def metrics_sql(src: str, groups: list[str]) -> str:
    grp = "".join(f"{g}, " for g in groups)
    on = " AND ".join(f"g.{x} = auc.{x}" for x in groups) if groups else "TRUE"
    return kernel_sql(src, ", ".join(groups)) + "," + _METRICS_SQL.format(grp=grp, src=src, on=on)


@query(
    "evl7_metric_table",
    f"WITH {P}, {metrics_sql('p', [])} "
    "SELECT metric AS scoring_metric, round(score, 6) AS holdout_score, 'model_v' AS model_uid, "
    "'test' AS holdout_type FROM u",
    ("v_pred",),
)
def evl7(spark, d):
    return r6(ev.metric_table(preds(spark, d), "model_v"))


ROC_SQL = f"""WITH {P}, {kernel_sql()},
rp AS (SELECT prob AS threshold, (tot_neg - cum_neg + neg) / tot_neg AS fpr, (tot_pos - cum_pos + pos) / tot_pos AS tpr FROM c
       UNION ALL SELECT max(prob) + 1, 0.0, 0.0 FROM c)"""


@query(
    "evl8_roc_points",
    ROC_SQL + " SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM rp",
    ("v_pred",),
)
def evl8(spark, d):
    return r6(ev.roc_points(preds(spark, d)))


@query(
    "evl9_optimal_cutoff",
    ROC_SQL
    + " SELECT round(threshold, 6) AS optimal_threshold, round(tpr, 6) AS best_tpr, round(fpr, 6) AS best_fpr"
    " FROM rp ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1",
    ("v_pred",),
)
def evl9(spark, d):
    return r6(ev.optimal_cutoff(preds(spark, d)))


DECILES = "[" + ", ".join(repr(i / 10) for i in range(1, 10)) + "]"


def _bysql() -> str:
    cats = " UNION ALL ".join(
        f"SELECT key, label, prob, predicted_class, '{c}' AS feature, {c} AS level FROM j WHERE {c} IS NOT NULL"
        for c in ("cat_a", "cat_b", "cat_c")
    )
    nums = " UNION ALL ".join(
        f"SELECT key, label, prob, predicted_class, '{c}' AS feature, {c} AS x FROM j" for c in ("num_a", "num_b", "num_c")
    )
    return f"""WITH {P},
j AS (SELECT p.key, label, prob, predicted_class, cat_a, cat_b, cat_c, num_a, num_b, num_c
      FROM p JOIN v_obs o ON p.key = o.key),
numl AS ({nums}),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {DECILES}))) AS e
          FROM numl WHERE x IS NOT NULL GROUP BY feature),
allp AS ({cats} UNION ALL
         SELECT key, label, prob, predicted_class, n.feature,
                CASE WHEN x IS NULL THEN 'nan' ELSE 'q' || CAST(1 + len(list_filter(e, lambda v: x > v)) AS VARCHAR) END
         FROM numl n JOIN edges ON n.feature = edges.feature),
{metrics_sql('allp', ['feature', 'level'])}
SELECT metric, round(score, 6) AS score, feature || '_' || level AS partition, observations
FROM u WHERE n_pos > 0 AND n_pos < observations"""


@query("evl10_metrics_by_partition", _bysql(), ("v_pred", "v_obs"))
def evl10(spark, d):
    return r6(
        ev.metrics_by_partition(
            preds(spark, d),
            views.v_obs(spark, d),
            categorical=["cat_a", "cat_b", "cat_c"],
            numeric=["num_a", "num_b", "num_c"],
        )
    )


def _calsql() -> str:
    parts = []
    for n in ev.CALIBRATION_BINS:
        step = f"((1 + 1e-8) / {n})"
        parts.append(
            f"SELECT {n} AS n_bins, 'uniform' AS strategy, "
            f"CAST(list_sum(list_transform(range(1, {n + 1}), lambda j: CASE WHEN prob >= j * {step} THEN 1 ELSE 0 END)) AS INTEGER) AS bin, "
            "label, prob FROM p"
        )
        qs = "[" + ", ".join(repr(j / n) for j in range(1, n)) + "]"
        parts.append(
            f"SELECT {n}, 'quantile', CAST(len(list_filter(e, lambda v: prob >= v)) AS INTEGER), label, prob "
            f"FROM p, (SELECT quantile_cont(prob, {qs}) AS e FROM p) qe"
        )
    return (
        f"WITH {P}, b AS ({' UNION ALL '.join(parts)}) "
        "SELECT n_bins, strategy, bin, round(avg(label), 6) AS prob_true, round(avg(prob), 6) AS prob_pred, "
        "count(*) AS count FROM b GROUP BY n_bins, strategy, bin"
    )


@query("evl11_calibration_table", _calsql(), ("v_pred",))
def evl11(spark, d):
    return r6(ev.calibration_tables(preds(spark, d)))


@query(
    "evl12_gains_lift_points",
    f"""WITH {P}, {kernel_sql()},
g AS (SELECT 1 AS class, prob AS threshold, (tot_cnt - cum_cnt + cnt) / tot_cnt AS percentage,
             (tot_pos - cum_pos + pos) / tot_pos AS gain FROM c
      UNION ALL SELECT 0, 1 - prob, cum_cnt / tot_cnt, cum_neg / tot_neg FROM c)
SELECT class, round(threshold, 6) AS threshold, round(percentage, 6) AS percentage, round(gain, 6) AS gain,
       round(gain / percentage, 6) AS lift FROM g""",
    ("v_pred",),
)
def evl12(spark, d):
    return r6(ev.gains_points(preds(spark, d)))


@query(
    "evl13_concordance",
    f"""WITH {P}, {kernel_sql()},
a AS (SELECT SUM(pos * (tot_neg - cum_neg + neg)) AS dp, max(tot_pos) * max(tot_neg) AS pairs FROM c)
SELECT CAST(pairs AS BIGINT) AS pairs, CAST(dp AS BIGINT) AS discordant_pairs,
       round(1 - dp / pairs, 6) AS concordant_discordant_ratio, round((pairs - 2 * dp) / pairs, 6) AS somers_d FROM a""",
    ("v_pred",),
)
def evl13(spark, d):
    return r6(ev.concordance(preds(spark, d)))


@query(
    "evl14_ks_statistic",
    f"""WITH {P}, {kernel_sql()},
a AS (SELECT max(abs(cum_pos / tot_pos - cum_neg / tot_neg)) AS ks, max(tot_pos) AS n1, max(tot_neg) AS n2 FROM c)
SELECT round(ks, 6) AS ks_statistic, round({kolmogorov_sf_sql('ks * sqrt(n1 * n2 / (n1 + n2))')}, 6) AS p_value FROM a""",
    ("v_pred",),
)
def evl14(spark, d):
    return r6(ev.ks_by_class(preds(spark, d)))


@query(
    "evl15_ks_curve_points",
    f"""WITH {P}, {kernel_sql()}
SELECT round(prob, 6) AS threshold, round(cum_pos / tot_pos, 6) AS cdf_pos, round(cum_neg / tot_neg, 6) AS cdf_neg,
       CAST(tot_pos AS BIGINT) AS tot_pos, CAST(tot_neg AS BIGINT) AS tot_neg FROM c""",
    ("v_pred",),
)
def evl15(spark, d):
    return r6(ev.ks_curve_points(preds(spark, d)))


@query(
    "evl16_confusion_table",
    ROC_SQL
    + """,
opt AS (SELECT threshold AS t FROM rp ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1),
cc AS (SELECT 'predicted_class' AS class_column, 0.5 AS cutoff, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS cl, label FROM p
       UNION ALL SELECT 'optimal_predicted_class', t, CASE WHEN prob >= t THEN 1 ELSE 0 END, label FROM p, opt),
t AS (SELECT class_column, cutoff,
             SUM(CASE WHEN label = 0 AND cl = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
             SUM(CASE WHEN label = 0 AND cl = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
             SUM(CASE WHEN label = 1 AND cl = 0 THEN 1 ELSE 0 END)::BIGINT AS fn,
             SUM(CASE WHEN label = 1 AND cl = 1 THEN 1 ELSE 0 END)::BIGINT AS tp FROM cc GROUP BY class_column, cutoff)
SELECT class_column, round(cutoff::DOUBLE, 6) AS cutoff, tn, fp, fn, tp,
       round(fp / (fp + tn) * 100, 2) AS fpr_pct, round(fn / (fn + tp) * 100, 2) AS fnr_pct FROM t""",
    ("v_pred",),
)
def evl16(spark, d):
    return r6(ev.confusion_table(views.v_pred(spark, d)))


def _bootsql() -> str:
    return f"""WITH {P}, nn AS (SELECT count(*) // 30 AS m FROM p),
x AS (SELECT s.range AS sample, p.*,
             ('0x' || substr(md5(CAST(p.key AS VARCHAR) || '-' || CAST(s.range AS VARCHAR)), 1, 15))::BIGINT AS h
      FROM p CROSS JOIN range(30) s),
r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY h, key) AS rn FROM x),
dd AS (SELECT r.* FROM r, nn WHERE rn <= m),
{metrics_sql('dd', ['sample'])}
SELECT metric, count(score) AS count, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std,
       round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS p25,
       round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75,
       round(max(score), 6) AS max
FROM u GROUP BY metric"""


@query("evl17_bootstrap_scores", _bootsql(), ("v_pred",))
def evl17(spark, d):
    return r6(ev.bootstrap_scores(preds(spark, d)))


@query(
    "evl18_class_lift",
    f"WITH {P}, t AS (SELECT {CONF} FROM p) SELECT round((tp / (tp + fp)) / ((tp + fn) / (tp + fp + fn + tn)), 6) AS lift FROM t",
    ("v_pred",),
)
def evl18(spark, d):
    return r6(ev.class_lift(preds(spark, d)))


@query(
    "evl19_probability_lift",
    f"""WITH {P}, e AS (SELECT list_sort(list_distinct(quantile_cont(prob, {DECILES}))) AS e FROM p),
b AS (SELECT p.*, 1 + len(list_filter(e, lambda v: prob > v)) AS bin FROM p, e),
g AS (SELECT bin, avg(prob) AS pm, avg(label) AS ym FROM b GROUP BY bin),
base AS (SELECT avg(label) AS base FROM p)
SELECT round(sum(abs(base - ym)) / sum(abs(pm - ym)), 6) AS lift FROM g, base""",
    ("v_pred",),
)
def evl19(spark, d):
    return r6(ev.probability_lift(preds(spark, d)))


@query(
    "evl20_density_points",
    f"""WITH {P}, st AS (SELECT count(*) AS n, stddev_samp(prob) * pow(count(*), -0.2) AS bw,
                       min(prob) AS lo, max(prob) AS hi FROM p),
dv AS (SELECT prob AS v, count(*) AS c FROM p GROUP BY prob),
g AS (SELECT CAST(range AS INTEGER) AS point,
             (lo - 3.0 * bw) + range * ((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199 AS x, n, bw FROM st, range(200))
SELECT point, round(x, 6) AS x, round(sum(c * exp(-0.5 * pow((x - v) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM g, dv GROUP BY point, x, n, bw""",
    ("v_pred",),
)
def evl20(spark, d):
    return r6(ev.density_points(preds(spark, d), "prob"))


@query(
    "evl1_predictions_frame",
    "SELECT key, label, round(prob, 6) AS prob, round(1 - prob, 6) AS prob_0, "
    "CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS predicted_class FROM v_pred",
    ("v_pred",),
)
def evl1(spark, d):
    return r6(preds(spark, d).select("key", "label", "prob", "prob_0", "predicted_class"))


__all__ = ["F"]


DOCS = "p AS (SELECT key, label, score AS prob FROM v_docs)"


@query(
    "evl3_roc_auc_docs",
    f"WITH {DOCS}, {kernel_sql()} SELECT round({AUC}, 6) AS roc_auc, CAST(max(tot_pos) AS BIGINT) AS n_pos, "
    "CAST(max(tot_neg) AS BIGINT) AS n_neg FROM c",
    ("v_docs",),
)
def evl3_docs(spark, d):
    """EVL-3 cross-check on a second table: document quality vs a length score."""
    docs = views.v_docs(spark, d).select("key", "label", F.col("score").alias("prob"))
    k = ev.roc_auc(docs)
    counts = docs.agg(
        F.sum("label").cast("long").alias("n_pos"), F.sum(1 - F.col("label")).cast("long").alias("n_neg")
    )
    from attrix.operators.aggregates import with_scalar

    return r6(with_scalar(k, counts))


@query(
    "evl14_ks_statistic_docs",
    f"""WITH {DOCS}, {kernel_sql()},
a AS (SELECT max(abs(cum_pos / tot_pos - cum_neg / tot_neg)) AS ks, max(tot_pos) AS n1, max(tot_neg) AS n2 FROM c)
SELECT round(ks, 6) AS ks_statistic, round({kolmogorov_sf_sql('ks * sqrt(n1 * n2 / (n1 + n2))')}, 6) AS p_value FROM a""",
    ("v_docs",),
)
def evl14_docs(spark, d):
    """EVL-14 cross-check on the documents view."""
    docs = views.v_docs(spark, d).select("key", "label", F.col("score").alias("prob"))
    return r6(ev.ks_by_class(docs))
