"""Drift queries (survey section 2.15) on v_drift (train = before 2024-01-16)."""

from __future__ import annotations

from attrix.functions.stats import chi2_sf_sql, kolmogorov_sf_sql
from attrix.operators import drift as dr
from attrix.plans import views
from attrix.plans.common import r6
from attrix.plans.q_explore import LEVEL_FREQ_SQL
from attrix.plans.registry import query

CAT = ["event_type", "user_group"]
NUM = ["value"]

CHI_SQL = f"""{LEVEL_FREQ_SQL},
chi AS (SELECT feature, sum(CASE WHEN train_count = 0 THEN 'inf'::DOUBLE
                                 ELSE pow(prod_count - train_count, 2) / train_count END) AS chi2,
               count(*) AS levels FROM lf GROUP BY feature),
chip AS (SELECT feature, chi2, {chi2_sf_sql('chi2', 'levels - 1')} AS p_value FROM chi)"""

KS_SQL = f"""
kk AS (SELECT value AS v, SUM(CASE WHEN side = 'train' THEN 1 ELSE 0 END)::DOUBLE AS a,
              SUM(CASE WHEN side = 'prod' THEN 1 ELSE 0 END)::DOUBLE AS b FROM v_drift WHERE value IS NOT NULL GROUP BY value),
kc AS (SELECT v, SUM(a) OVER (ORDER BY v) AS ca, SUM(b) OVER (ORDER BY v) AS cb, SUM(a) OVER () AS ta,
              SUM(b) OVER () AS tb FROM kk),
ks AS (SELECT 'value' AS feature, max(abs(ca / ta - cb / tb)) AS d, max(ta) AS n1, max(tb) AS n2 FROM kc),
ksp AS (SELECT feature, d AS ks_statistic, {kolmogorov_sf_sql('d * sqrt(n1 * n2 / (n1 + n2))')} AS p_value FROM ks)"""


def _sides(spark, d):
    v = views.v_drift(spark, d)
    return v.where("side = 'train'"), v.where("side = 'prod'")


@query(
    "drf1_chi_square_shift",
    f"WITH {CHI_SQL} SELECT feature, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value FROM chip",
    ("v_drift",),
)
def drf1(spark, d):
    t, p = _sides(spark, d)
    return r6(dr.chi_square_shift(t, p, CAT))


@query(
    "drf2_ks_shift",
    f"WITH {KS_SQL} SELECT feature, round(ks_statistic, 6) AS ks_statistic, round(p_value, 6) AS p_value FROM ksp",
    ("v_drift",),
)
def drf2(spark, d):
    t, p = _sides(spark, d)
    return r6(dr.ks_shift(t, p, NUM))


@query(
    "drf3_dataset_shift_report",
    f"""WITH {CHI_SQL}, {KS_SQL},
u AS (SELECT feature, p_value FROM chip UNION ALL SELECT feature, p_value FROM ksp)
SELECT feature, round(p_value, 6) AS p_value, p_value <= 0.05 AS shift_occurred, 0.05::DOUBLE AS p_value_cutoff FROM u""",
    ("v_drift",),
)
def drf3(spark, d):
    t, p = _sides(spark, d)
    return r6(dr.dataset_shift_report(t, p, CAT, NUM))
