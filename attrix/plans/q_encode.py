"""Encoder, feature-selection, comparison and leaderboard queries
(survey sections 2.5, 2.10 TRN-3, 2.12)."""

from __future__ import annotations

from math import exp, factorial

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from attrix.functions.stats import chi2_sf_sql
from attrix.operators import compare as cm
from attrix.operators import encoders as en
from attrix.operators import evaluate as ev
from attrix.operators import stages as sg
from attrix.operators.explore import dummies_long
from attrix.operators.extra_trees import ExtraTreesClassifier
from attrix.operators.leaderboard import cv_leaderboard, fold_of
from attrix.operators.projections import pivot_folds
from attrix.operators.train import POISSON_TERMS, poisson_weight
from attrix.plans import views
from attrix.plans.common import obs_once, r6
from attrix.plans.registry import query

CATS = ["cat_a", "cat_b", "cat_c"]
NUMS = ["num_a", "num_b", "num_c"]


def _u(tmpl, cols):
    return " UNION ALL ".join(tmpl.format(c=c) for c in cols)


# ---------------------------------------------------------------- comparison
CLS = """t AS (SELECT key, label, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS a,
                     CASE WHEN prob_b >= 0.5 THEN 1 ELSE 0 END AS b,
                     CASE WHEN prob_c >= 0.5 THEN 1 ELSE 0 END AS c FROM v_pred)"""


def _cls(spark, d):
    p = views.v_pred(spark, d)
    return p.select(
        "key",
        "label",
        *[F.when(F.col(c) >= 0.5, 1).otherwise(0).alias(n) for c, n in (("prob", "a"), ("prob_b", "b"), ("prob_c", "c"))],
    )


@query(
    "cmp1_mcnemar",
    f"""WITH {CLS},
n AS (SELECT SUM(CASE WHEN a = label AND b = label THEN 1 ELSE 0 END)::BIGINT AS n00,
             SUM(CASE WHEN a = label AND b <> label THEN 1 ELSE 0 END)::BIGINT AS n01,
             SUM(CASE WHEN a <> label AND b = label THEN 1 ELSE 0 END)::BIGINT AS n10,
             SUM(CASE WHEN a <> label AND b <> label THEN 1 ELSE 0 END)::BIGINT AS n11 FROM t),
s AS (SELECT *, pow(abs(n01 - n10) - 1, 2) / (n01 + n10) AS chi2 FROM n)
SELECT n00, n01, n10, n11, round(chi2, 6) AS chi2, round({chi2_sf_sql('chi2', '1')}, 6) AS p FROM s""",
    ("v_pred",),
)
def cmp1(spark, d):
    return r6(cm.mcnemar(_cls(spark, d), "label", "a", "b"))


@query(
    "cmp2_cochrans_q",
    f"""WITH {CLS},
r AS (SELECT CASE WHEN a = label THEN 1 ELSE 0 END AS r1, CASE WHEN b = label THEN 1 ELSE 0 END AS r2,
             CASE WHEN c = label THEN 1 ELSE 0 END AS r3 FROM t),
g AS (SELECT sum(r1)::DOUBLE AS g1, sum(r2)::DOUBLE AS g2, sum(r3)::DOUBLE AS g3,
             sum(pow(r1 + r2 + r3, 2))::DOUBLE AS sl2 FROM r),
q AS (SELECT 2 * (3 * (pow(g1, 2) + pow(g2, 2) + pow(g3, 2)) - pow(g1 + g2 + g3, 2)) / (3 * (g1 + g2 + g3) - sl2) AS q FROM g)
SELECT round(q, 6) AS q, round({chi2_sf_sql('q', '2')}, 6) AS p FROM q""",
    ("v_pred",),
)
def cmp2(spark, d):
    return r6(cm.cochrans_q(_cls(spark, d), "label", ["a", "b", "c"]))


ROUNDS_EXPR = (
    "CASE WHEN (((key * (r + 3) * 7919) % 1000) / 1e3) * 5e-1 + prob * 5e-1 >= 5e-1 THEN 1 ELSE 0 END"
)


@query(
    "cmp3_bias_variance",
    f"""WITH rr AS (SELECT key, label, range AS r, prob FROM v_pred, range(20)),
p AS (SELECT key, label, r, {ROUNDS_EXPR} AS pred FROM rr),
k AS (SELECT key, first(label) AS y, sum(pred) AS ones, count(*) AS n,
             sum(CASE WHEN pred <> label THEN 1 ELSE 0 END) AS wrong FROM p GROUP BY key),
m AS (SELECT *, CASE WHEN ones * 2 > n THEN 1 ELSE 0 END AS main FROM k)
SELECT round(sum(wrong) / sum(n), 6) AS expected_loss, round(avg(CASE WHEN main <> y THEN 1.0 ELSE 0.0 END), 6) AS bias,
       round(sum(CASE WHEN main = 1 THEN n - ones ELSE ones END) / sum(n), 6) AS variance FROM m""",
    ("v_pred",),
)
def cmp3(spark, d):
    p = views.v_pred(spark, d).select("key", "label", "prob", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("r"))
    p = p.withColumn("pred", F.expr(ROUNDS_EXPR))
    return r6(cm.bias_variance(p, "key", "label", "r", "pred"))


_POISSON_CDF = [sum(exp(-1.0) / factorial(j) for j in range(k + 1)) for k in range(POISSON_TERMS - 1)]


@query(
    "cmp3_bootstrap_weights",
    f"""WITH u AS (SELECT r, (('0x' || substr(md5(CAST(key AS VARCHAR) || '-' || CAST(r AS VARCHAR)), 1, 15))::BIGINT::DOUBLE + 0.5) / pow(2, 60) AS u
  FROM v_pred, (SELECT CAST(range AS INTEGER) AS r FROM range(20)))
SELECT r AS round, CAST({" + ".join(f"(u > {c!r}::DOUBLE)::INT" for c in _POISSON_CDF)} AS DOUBLE) AS weight, count(*) AS n FROM u GROUP BY ALL""",
    ("v_pred",),
)
def cmp3w(spark, d):
    """Rows by round and weight of the 20 bootstrap rounds."""
    p = views.v_pred(spark, d).select("key", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("round"))
    return p.groupBy("round", poisson_weight("key", F.col("round")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- encoders
SPARSE_CUT = 0.04


@query(
    "enc1_combine_sparse_levels",
    f"""WITH l AS ({_u("SELECT '{c}' AS f, {c} AS lv FROM v_obs WHERE {c} IS NOT NULL", CATS)}),
s AS (SELECT f, lv FROM (SELECT f, lv, count(*) AS c, sum(count(*)) OVER (PARTITION BY f) AS t FROM l GROUP BY f, lv)
      WHERE c / t <= {SPARSE_CUT}::DOUBLE)
SELECT key, {", ".join(f"CASE WHEN {c} IN (SELECT lv FROM s WHERE f = '{c}') THEN 'sparse_combined' ELSE {c} END AS {c}" for c in CATS)}
FROM v_obs""",
    ("v_obs",),
)
def enc1(spark, d):
    o = views.v_obs(spark, d).select("key", *CATS)
    return en.combine_sparse_levels(o, en.sparse_levels(o, CATS, SPARSE_CUT), CATS)


@query(
    "enc2_one_hot_long",
    _u("SELECT key, '{c}=' || {c} AS feature, 1.0::DOUBLE AS value FROM v_obs WHERE {c} IS NOT NULL", CATS)
    + " UNION ALL "
    + _u("SELECT key, '{c}' AS feature, {c} AS value FROM v_obs WHERE {c} IS NOT NULL", NUMS),
    ("v_obs",),
)
def enc2(spark, d):
    return en.one_hot_long(views.v_obs(spark, d), "key", CATS, NUMS)


@query(
    "enc3_dummies_long",
    _u("SELECT key, '{c}_' || coalesce({c}, 'nan') AS feature, 1 AS value FROM v_obs", CATS),
    ("v_obs",),
)
def enc3(spark, d):
    return dummies_long(views.v_obs(spark, d), "key", CATS)


@query(
    "enc4_impute_mean",
    "SELECT key, round(coalesce(num_c, (SELECT avg(num_c) FROM v_obs)), 6) AS num_c FROM v_obs",
    ("v_obs",),
)
def enc4(spark, d):
    return r6(en.impute_mean(views.v_obs(spark, d).select("key", "num_c"), ["num_c"]))


@query(
    "enc5_standard_scale",
    """WITH s AS (SELECT avg(num_a) AS ma, stddev_pop(num_a) AS sa, avg(num_b) AS mb, stddev_pop(num_b) AS sb,
                     avg(num_c) AS mc, stddev_pop(num_c) AS sc FROM v_obs)
SELECT key, round((num_a - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 6) AS num_a,
       round((num_b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END, 6) AS num_b,
       round((num_c - mc) / CASE WHEN sc = 0 THEN 1 ELSE sc END, 6) AS num_c FROM v_obs, s""",
    ("v_obs",),
)
def enc5(spark, d):
    return r6(en.standard_scale(views.v_obs(spark, d).select("key", *NUMS), NUMS))


def _select_sql(score_cte: str, pct: float) -> str:
    return f"""{score_cte},
th AS (SELECT count(*) AS nf, quantile_cont(score, {1.0 - pct / 100.0}) AS thr FROM sc),
gt AS (SELECT sum(CASE WHEN score > thr THEN 1 ELSE 0 END) AS ngt FROM sc, th),
rk AS (SELECT sc.*, thr, nf, ngt, sum(CASE WHEN score = thr THEN 1 ELSE 0 END)
              OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tr FROM sc, th, gt)"""


F_SCORES = f"""mm AS (SELECT avg(num_a) AS ma, avg(num_b) AS mb, avg(num_c) AS mc FROM v_obs),
x AS (SELECT target AS y, coalesce(num_a, ma) AS num_a, coalesce(num_b, mb) AS num_b, coalesce(num_c, mc) AS num_c FROM v_obs, mm),
l AS ({_u("SELECT y, '{c}' AS feature, {c} AS x FROM x", NUMS)}),
per AS (SELECT feature, y, count(*) AS nc, avg(x) AS mc, var_pop(x) AS vc FROM l GROUP BY 1, 2),
tot AS (SELECT feature, count(*) AS n, avg(x) AS m FROM l GROUP BY 1),
s AS (SELECT per.feature, sum(nc * pow(mc - m, 2)) AS ssb, sum(nc * vc) AS ssw, count(*) AS k, max(n) AS n
      FROM per JOIN tot ON per.feature = tot.feature GROUP BY per.feature),
sc AS (SELECT feature, (ssb / (k - 1)) / (ssw / (n - k)) AS score,
              CASE feature WHEN 'num_a' THEN 0 WHEN 'num_b' THEN 1 ELSE 2 END AS position FROM s)"""


@query(
    "enc6_f_classif_select",
    f"""WITH {_select_sql(F_SCORES, 10)}
SELECT feature, round(score, 4) AS score, position,
       (score > thr) OR (score = thr AND tr <= floor(nf * 10 / 100.0) - ngt) AS selected FROM rk""",
    ("v_obs",),
)
def enc6(spark, d):
    o = en.impute_mean(obs_once(spark, d).select("target", *NUMS), NUMS)
    return r6(en.f_classif_scores(o, "target", NUMS, 10), 4)


CHI_SCORES = f"""oh AS ({_u("SELECT key, '{c}=' || {c} AS feature FROM v_obs WHERE {c} IS NOT NULL", CATS)}),
yy AS (SELECT key, target AS y FROM v_obs),
ob AS (SELECT feature, y, count(*)::DOUBLE AS obs FROM oh JOIN yy ON oh.key = yy.key GROUP BY 1, 2),
cls AS (SELECT y, count(*) AS ny FROM yy GROUP BY 1),
nn AS (SELECT count(*) AS n FROM yy),
ft AS (SELECT feature, sum(obs) AS ft FROM ob GROUP BY 1),
g AS (SELECT ft.feature, cls.y, ny, n, ft, coalesce(ob.obs, 0.0) AS obs FROM ft CROSS JOIN cls CROSS JOIN nn
      LEFT JOIN ob ON ob.feature = ft.feature AND ob.y = cls.y),
sc AS (SELECT feature, sum(pow(obs - ny / n * ft, 2) / (ny / n * ft)) AS score, feature AS position FROM g GROUP BY 1)"""


@query(
    "enc7_chi2_select",
    f"""WITH {_select_sql(CHI_SCORES, 10)}
SELECT feature, round(score, 6) AS score,
       (score > thr) OR (score = thr AND tr <= floor(nf * 10 / 100.0) - ngt) AS selected FROM rk""",
    ("v_obs",),
)
def enc7(spark, d):
    o = obs_once(spark, d).select("key", "target", *CATS)
    return r6(en.chi2_scores(o, "target", "key", CATS, 10).select("feature", "score", "selected"))


@query(
    "enc8_variance_filter",
    f"""WITH nn AS (SELECT count(*) AS n FROM v_obs),
oh AS ({_u("SELECT '{c}=' || {c} AS feature FROM v_obs WHERE {c} IS NOT NULL", CATS)}),
v AS (SELECT feature, count(*) / n - pow(count(*) / n, 2) AS variance FROM oh, nn GROUP BY feature, n
      UNION ALL SELECT 'num_b', var_pop(num_b) FROM v_obs UNION ALL SELECT 'num_c', var_pop(num_c) FROM v_obs)
SELECT feature, round(variance, 4) AS variance, variance > 0 AS keep FROM v""",
    ("v_obs",),
)
def enc8(spark, d):
    o = obs_once(spark, d)
    return r6(en.variance_filter(o, "key", CATS, ["num_b", "num_c"]), 4)


@query(
    "enc10_non_dummy_columns",
    """WITH f AS (SELECT CASE WHEN target = 'yes' THEN 1 ELSE 0 END AS target_eq,
                     CASE WHEN cat_a IS NULL THEN 1 ELSE 0 END AS cat_a_nan, num_b, num_c,
                     CASE WHEN num_c > 100 THEN 1.0 END AS big_qty FROM v_obs)
SELECT 'target_eq' AS "column", max(CASE WHEN target_eq NOT IN (0, 1) THEN 1 ELSE 0 END) = 0 AS is_dummy FROM f
UNION ALL SELECT 'cat_a_nan', max(CASE WHEN cat_a_nan NOT IN (0, 1) THEN 1 ELSE 0 END) = 0 FROM f
UNION ALL SELECT 'num_b', max(CASE WHEN num_b NOT IN (0, 1) THEN 1 ELSE 0 END) = 0 FROM f
UNION ALL SELECT 'num_c', max(CASE WHEN num_c NOT IN (0, 1) THEN 1 ELSE 0 END) = 0 FROM f
UNION ALL SELECT 'big_qty', max(CASE WHEN big_qty NOT IN (0, 1) THEN 1 ELSE 0 END) = 0 FROM f""",
    ("v_obs",),
)
def enc10(spark, d):
    o = views.v_obs(spark, d).select(
        F.when(F.col("target") == "yes", 1).otherwise(0).alias("target_eq"),
        F.when(F.col("cat_a").isNull(), 1).otherwise(0).alias("cat_a_nan"),
        "num_b",
        "num_c",
        F.when(F.col("num_c") > 100, 1.0).alias("big_qty"),
    )
    return en.non_dummy_columns(o, ["target_eq", "cat_a_nan", "num_b", "num_c", "big_qty"])


# ---------------------------------------------------------------- feature matrix
MATRIX_SPEC = {
    "numeric": NUMS,
    "categorical": CATS,
    "date_col": "acquired_date",
    "clips": [("num_b", 0, 0, "lower")],
    "ratios": [("num_a", "num_c")],
    "log_cols": ["num_a"],
    "num_percentile": 60,
    "cat_percentile": 40,
    "combine_cutoff": SPARSE_CUT,
    "conform": {**{c: "double" for c in NUMS}, **{c: "string" for c in [*CATS, "acquired_date"]}},
}
_MATRIX_NUMS = ["num_a__log", "num_a_num_c_ratio", "num_b__clip", "num_c"]
_MATRIX_CATS = [*CATS, "month", "quarter", "year"]
MATRIX_SQL = f"""b AS (SELECT key, CASE WHEN target = 'yes' THEN 1 ELSE 0 END AS label,
  CASE WHEN num_a = 0 THEN 0 WHEN num_a > 0 THEN ln(num_a) END AS num_a__log, num_a / nullif(num_c, 0) AS num_a_num_c_ratio,
  CASE WHEN num_b < 0 THEN 0 ELSE num_b END AS num_b__clip, num_c::DOUBLE AS num_c,
  {", ".join(f"coalesce({c}, 'missing') AS {c}" for c in CATS)}, CAST(month(CAST(acquired_date AS DATE)) AS VARCHAR) AS month,
  'q' || quarter(CAST(acquired_date AS DATE)) AS quarter, CAST(year(CAST(acquired_date AS DATE)) AS VARCHAR) AS year FROM v_obs),
nl AS ({_u("SELECT key, label, '{c}' AS feature, {c}::DOUBLE AS x FROM b", _MATRIX_NUMS)}),
ms AS (SELECT feature, avg(x) AS mean FROM nl GROUP BY 1),
nf AS (SELECT key, label, feature, coalesce(x, mean) AS x, mean FROM nl JOIN ms USING (feature)),
sd AS (SELECT feature, stddev_pop(x) AS sigma, avg(x) AS m, count(*) AS n FROM nf GROUP BY 1),
pc AS (SELECT feature, label, count(*) AS nc, avg(x) AS mc, var_pop(x) AS vc FROM nf GROUP BY 1, 2),
fs AS (SELECT feature, (sum(nc * pow(mc - m, 2)) / (count(*) - 1)) / (sum(nc * vc) / (max(n) - count(*))) AS score FROM pc JOIN sd USING (feature) GROUP BY 1),
ft AS (SELECT quantile_cont(score, 0.4) AS thr, count(*) AS n FROM fs),
fr AS (SELECT feature, score > thr AS up, score = thr AS tie, n, sum((score > thr)::INT) OVER () AS ups,
  sum((score = thr)::INT) OVER (ORDER BY feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tr FROM fs, ft),
nk AS (SELECT feature, mean, sigma, row_number() OVER (ORDER BY feature) - 1 AS slot FROM fr JOIN ms USING (feature) JOIN sd USING (feature)
  WHERE (up OR (tie AND tr <= floor(fr.n * 0.6) - ups)) AND sigma > 0),
cl AS ({_u("SELECT key, label, '{c}' AS c, {c} AS lv FROM b", _MATRIX_CATS)}),
sp AS (SELECT c, lv FROM (SELECT c, lv, count(*) AS k, sum(count(*)) OVER (PARTITION BY c) AS t FROM cl GROUP BY 1, 2) WHERE k / t <= {SPARSE_CUT}::DOUBLE),
cc AS (SELECT key, label, cl.c, CASE WHEN sp.lv IS NULL THEN cl.lv ELSE 'sparse_combined' END AS lv FROM cl LEFT JOIN sp ON cl.c = sp.c AND cl.lv = sp.lv),
sh AS (SELECT label, count(*) / (SELECT count(*) FROM b) AS share FROM b GROUP BY 1),
ob AS (SELECT c, lv, label, count(*)::DOUBLE AS o FROM cc GROUP BY 1, 2, 3),
lt AS (SELECT c, lv, sum(o) AS n FROM ob GROUP BY 1, 2),
cs AS (SELECT lt.c, lt.lv, lt.n, sum(pow(coalesce(o, 0) - share * n, 2) / (share * n)) AS score FROM lt CROSS JOIN sh
  LEFT JOIN ob ON ob.c = lt.c AND ob.lv = lt.lv AND ob.label = sh.label GROUP BY 1, 2, 3),
ct AS (SELECT quantile_cont(score, 0.6) AS thr, count(*) AS nf FROM cs),
lk AS (SELECT c, lv, row_number() OVER (ORDER BY c, lv) - 1 + (SELECT count(*) FROM nk) AS slot FROM cs, ct
  WHERE score > thr AND n < (SELECT count(*) FROM b))"""


def _fitted_matrix(spark, d):
    o = obs_once(spark, d).withColumn("label", F.when(F.col("target") == "yes", 1).otherwise(0))
    return Pipeline(stages=sg.feature_stages(**MATRIX_SPEC)).fit(o), o


@query(
    "enc11_feature_matrix",
    f"""WITH {MATRIX_SQL}
SELECT key, feature, round((x - nk.mean) / sigma, 6) AS value FROM nf JOIN nk USING (feature) WHERE (x - nk.mean) / sigma <> 0
UNION ALL SELECT key, lk.c || '=' || lk.lv, 1.0::DOUBLE FROM cc JOIN lk ON cc.c = lk.c AND cc.lv = lk.lv""",
    ("v_obs",),
)
def enc11(spark, d):
    model, o = _fitted_matrix(spark, d)
    return r6(sg.feature_rows(model.transform(o), sg.feature_lineage(model)))


@query(
    "enc9_feature_lineage",
    f"""WITH {MATRIX_SQL}
SELECT CAST(slot AS BIGINT) AS slot, feature FROM nk UNION ALL SELECT CAST(slot AS BIGINT), c || '=' || lv FROM lk""",
    ("v_obs",),
)
def enc9(spark, d):
    return sg.feature_lineage(_fitted_matrix(spark, d)[0])


@query("trn5_extra_trees")
def trn5(spark, d):
    """Rows of a forest grown on the feature matrix: tree, node, feature, cut, cover, share of class 1 in its leaves."""
    model, o = _fitted_matrix(spark, d)
    grown = ExtraTreesClassifier(numTrees=10, maxDepth=4).fit(model.transform(o))
    return r6(grown.table.select("tree", "node", "feature", "cut", "left", "right", "cover", (F.col("value") * 10).alias("share")))


# ---------------------------------------------------------------- leaderboard
FOLD_SQL = """fs AS (SELECT trial, CAST(('0x' || substr(md5(CAST(key AS VARCHAR)), 1, 15))::BIGINT % 5 AS INTEGER) AS fold,
       label, p FROM (SELECT key, label, 'prob' AS trial, prob AS p FROM v_pred UNION ALL
                      SELECT key, label, 'prob_b', prob_b FROM v_pred UNION ALL SELECT key, label, 'prob_c', prob_c FROM v_pred)),
sc AS (SELECT trial, fold, avg(CASE WHEN label = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15))
                                    ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END) AS score FROM fs GROUP BY 1, 2),
w AS (SELECT trial, max(CASE WHEN fold = 0 THEN score END) AS fold_0, max(CASE WHEN fold = 1 THEN score END) AS fold_1,
             max(CASE WHEN fold = 2 THEN score END) AS fold_2, max(CASE WHEN fold = 3 THEN score END) AS fold_3,
             max(CASE WHEN fold = 4 THEN score END) AS fold_4 FROM sc GROUP BY trial)"""


def _fold_scores(spark, d):
    p = views.v_pred(spark, d)
    long = p.unpivot(["key", "label"], ["prob", "prob_b", "prob_c"], "trial", "p")
    long = long.withColumn("fold", fold_of("key"))
    # neg log loss per (trial, fold): the CV scorer of the reference
    return long.groupBy("trial", "fold").agg((-ev.log_loss_expr("label", "p")).alias("score"))


@query(
    "prj16_pivot_folds",
    f"""WITH {FOLD_SQL} SELECT trial, round(fold_0, 6) AS fold_0, round(fold_1, 6) AS fold_1, round(fold_2, 6) AS fold_2,
       round(fold_3, 6) AS fold_3, round(fold_4, 6) AS fold_4 FROM w""",
    ("v_pred",),
)
def prj16(spark, d):
    return r6(pivot_folds(_fold_scores(spark, d), ["trial"], "fold", "score", 5))


@query(
    "trn3_cv_leaderboard",
    f"""WITH {FOLD_SQL},
m AS (SELECT *, (fold_0 + fold_1 + fold_2 + fold_3 + fold_4) / 5 AS mean FROM w),
s AS (SELECT *, sqrt((pow(fold_0 - mean, 2) + pow(fold_1 - mean, 2) + pow(fold_2 - mean, 2) + pow(fold_3 - mean, 2)
                      + pow(fold_4 - mean, 2)) / 4) AS std FROM m)
SELECT trial, round(fold_0, 6) AS fold_0, round(fold_1, 6) AS fold_1, round(fold_2, 6) AS fold_2, round(fold_3, 6) AS fold_3,
       round(fold_4, 6) AS fold_4, round(mean, 6) AS mean, round(std, 6) AS std,
       CAST(row_number() OVER (ORDER BY mean DESC, trial) - 1 AS INTEGER) AS ranking FROM s""",
    ("v_pred",),
)
def trn3(spark, d):
    return r6(cv_leaderboard(_fold_scores(spark, d), ["trial"]))
