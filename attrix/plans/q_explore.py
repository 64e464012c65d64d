"""Aggregation and exploration queries (survey sections 2.7 and 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrix.functions.stats import digamma_sql
from attrix.operators import aggregates as ag
from attrix.operators import explore as ex
from attrix.operators.neighbours import FAR
from attrix.plans import views
from attrix.plans.common import obs_once, preds, r6
from attrix.plans.registry import query

CATS = ["cat_a", "cat_b", "cat_c"]
NUMS = ["num_a", "num_b", "num_c"]
DECILES = "[" + ", ".join(repr(i / 10) for i in range(1, 10)) + "]"


def _union(tmpl: str, cols) -> str:
    return " UNION ALL ".join(tmpl.format(c=c) for c in cols)


@query(
    "agg1_target_balance",
    "SELECT target AS level, count(*) AS count, round(count(*) / (SELECT count(*) FROM v_obs), 6) AS percentage "
    "FROM v_obs GROUP BY target",
    ("v_obs",),
)
def agg1(spark, d):
    return r6(ag.target_balance(views.v_obs(spark, d), "target"))


@query(
    "agg2_category_dispersion",
    f"""WITH l AS ({_union("SELECT '{c}' AS category, coalesce({c}, 'unknown') AS level FROM v_obs", CATS)})
SELECT category || '_' || level AS feature, count(*) AS total_count,
       round(count(*) / (SELECT count(*) FROM v_obs), 6) AS percentage_of_category_level, category
FROM l GROUP BY category, level""",
    ("v_obs",),
)
def agg2(spark, d):
    return r6(ag.category_dispersion(views.v_obs(spark, d), CATS))


CONN_SQL = f"""l AS ({_union("SELECT target, '{c}' AS category, coalesce({c}, 'unknown') AS level FROM v_obs", CATS)}),
bs AS (SELECT avg(CASE WHEN target = 'yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p1 FROM v_obs),
g AS (SELECT category, level, SUM(CASE WHEN target = 'yes' THEN 1 ELSE 0 END) AS pc, count(*) AS fc FROM l GROUP BY 1, 2),
conn AS (SELECT category || '_' || level AS feature, CAST(pc AS BIGINT) AS positive_count, pc / fc - p1 AS diff_from_expectation
         FROM g, bs WHERE pc > 0)"""


@query(
    "agg3_category_target_connection",
    f"WITH {CONN_SQL} SELECT feature, positive_count, round(diff_from_expectation, 6) AS diff_from_expectation FROM conn",
    ("v_obs",),
)
def agg3(spark, d):
    return r6(ag.category_target_connection(views.v_obs(spark, d), CATS, "target"))


@query(
    "agg4_summary_statistics",
    f"""WITH nl AS ({_union("SELECT target AS level, '{c}' AS feature, {c} AS x FROM v_obs", NUMS)}),
nl2 AS (SELECT * FROM nl UNION ALL SELECT 'total', feature, x FROM nl),
num AS (SELECT level, feature, count(x) AS "count", NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
               avg(x) AS mean, stddev_samp(x) AS std, min(x) AS "min", quantile_cont(x, 0.25) AS p25,
               quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS "max"
        FROM nl2 GROUP BY level, feature),
cl AS ({_union("SELECT target AS level, '{c}' AS feature, {c} AS v FROM v_obs", CATS)}),
cl2 AS (SELECT * FROM cl UNION ALL SELECT 'total', feature, v FROM cl),
vc AS (SELECT level, feature, v, count(*) AS c FROM cl2 WHERE v IS NOT NULL GROUP BY ALL),
tp AS (SELECT level, feature, sum(c)::BIGINT AS cnt, count(*)::BIGINT AS uq,
              (array_agg(v ORDER BY c DESC, v ASC))[1] AS top, max(c)::BIGINT AS freq FROM vc GROUP BY level, feature),
cat AS (SELECT pr.level, pr.feature, coalesce(cnt, 0)::BIGINT AS "count", coalesce(uq, 0)::BIGINT AS "unique", top, freq,
               NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS "min", NULL::DOUBLE AS p25, NULL::DOUBLE AS p50,
               NULL::DOUBLE AS p75, NULL::DOUBLE AS "max"
        FROM (SELECT DISTINCT level, feature FROM cl2) pr LEFT JOIN tp ON pr.level = tp.level AND pr.feature = tp.feature),
al AS (SELECT * FROM num UNION ALL SELECT * FROM cat)
SELECT level, feature, "count", "unique", top, freq, round(mean, 4) AS mean, round(std, 4) AS std, round("min", 4) AS "min",
       round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round("max", 4) AS "max" FROM al""",
    ("v_obs",),
)
def agg4(spark, d):
    return r6(ag.summary_statistics(obs_once(spark, d), "target", NUMS, CATS), 4)


@query(
    "agg5_cluster_summary",
    f"""WITH l AS ({_union("SELECT cat_b, '{c}' AS variable, {c} AS value FROM v_obs", NUMS)})
SELECT cat_b, variable, round(avg(value), 4) AS mean, round(coalesce(sum(value), 0), 2) AS sum, count(value) AS count
FROM l GROUP BY cat_b, variable""",
    ("v_obs",),
)
def agg5(spark, d):
    return r6(ag.cluster_summary(views.v_obs(spark, d), "cat_b", NUMS), 4, sum=2)


LEVEL_FREQ_SQL = """
lt AS (SELECT 'event_type' AS feature, event_type AS level FROM v_drift WHERE side = 'train'
       UNION ALL SELECT 'user_group', user_group FROM v_drift WHERE side = 'train'),
lp AS (SELECT 'event_type' AS feature, event_type AS level FROM v_drift WHERE side = 'prod'
       UNION ALL SELECT 'user_group', user_group FROM v_drift WHERE side = 'prod'),
ct AS (SELECT feature, level, count(*) / sum(count(*)) OVER (PARTITION BY feature) * 1000 + 1 AS tc FROM lt GROUP BY 1, 2),
cp AS (SELECT feature, level, count(*) / sum(count(*)) OVER (PARTITION BY feature) * 1000 + 1 AS pc FROM lp GROUP BY 1, 2),
lf AS (SELECT coalesce(ct.feature, cp.feature) AS feature, coalesce(ct.level, cp.level) AS level,
              CAST(trunc(coalesce(tc, 0)) AS INTEGER) AS train_count, CAST(trunc(coalesce(pc, 0)) AS INTEGER) AS prod_count
       FROM ct FULL OUTER JOIN cp ON ct.feature = cp.feature AND ct.level = cp.level)"""


@query("agg6_level_frequency", f"WITH {LEVEL_FREQ_SQL} SELECT * FROM lf", ("v_drift",))
def agg6(spark, d):
    v = views.v_drift(spark, d)
    return ag.level_frequency(v.where("side = 'train'"), v.where("side = 'prod'"), ["event_type", "user_group"])


@query(
    "agg9_normalized_value_counts",
    f"""WITH l AS ({_union("SELECT '{c}' AS feature, {c} AS level FROM v_obs WHERE {c} IS NOT NULL", CATS)})
SELECT feature, level, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6) AS share
FROM l GROUP BY feature, level""",
    ("v_obs",),
)
def agg9(spark, d):
    return r6(ag.normalized_value_counts(views.v_obs(spark, d), CATS))


def _dummy_long_sql() -> str:
    lv = _union("SELECT '{c}' AS col, {c} AS lvl FROM v_obs WHERE {c} IS NOT NULL GROUP BY 1, 2", CATS)
    match = " OR ".join(f"(lv.col = '{c}' AND o.{c} = lv.lvl)" for c in CATS)
    nan = _union(
        "SELECT key, '{c}_nan' AS f, CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END AS x FROM v_obs "
        "WHERE (SELECT count(*) FROM v_obs WHERE {c} IS NULL) > 0",
        CATS,
    )
    nums = _union("SELECT key, '{c}' AS f, {c} AS x FROM v_obs", NUMS)
    return f"""lv AS ({lv}),
dum AS (SELECT o.key, lv.col || '_' || lv.lvl AS f, CASE WHEN {match} THEN 1.0 ELSE 0.0 END AS x
        FROM v_obs o CROSS JOIN lv
        UNION ALL {nan} UNION ALL {nums})"""


@query(
    "exp2_correlated_features",
    f"""WITH {_dummy_long_sql()}
SELECT a.f AS feature1, b.f AS feature2, round(abs(corr(a.x, b.x)), 6) AS correlation,
       CASE WHEN abs(corr(a.x, b.x)) >= 0.98 THEN 'yes' ELSE 'no' END AS high_correlation
FROM dum a JOIN dum b ON a.key = b.key AND a.f < b.f GROUP BY a.f, b.f""",
    ("v_obs",),
)
def exp2(spark, d):
    return r6(ex.correlated_features(obs_once(spark, d), CATS, NUMS))


MI_SQL = f"""
l AS ({_union("SELECT target AS y, '{c}_' || coalesce({c}, 'nan') AS attribute FROM v_obs", CATS)}),
ly AS (SELECT attribute, y, count(*) AS n1 FROM l GROUP BY 1, 2),
cy AS (SELECT target AS y, count(*) AS ny FROM v_obs GROUP BY 1),
fl AS (SELECT a.attribute, cy.y, cy.ny, coalesce(ly.n1, 0) AS n1
       FROM (SELECT DISTINCT attribute FROM ly) a CROSS JOIN cy
       LEFT JOIN ly ON ly.attribute = a.attribute AND ly.y = cy.y),
mm AS (SELECT avg(num_a) AS ma, avg(num_b) AS mb, avg(num_c) AS mc FROM v_obs),
nl AS (SELECT key, target AS y, 'num_a' AS attribute, coalesce(num_a, ma)::DOUBLE AS x FROM v_obs, mm
       UNION ALL SELECT key, target, 'num_b', coalesce(num_b, mb) FROM v_obs, mm
       UNION ALL SELECT key, target, 'num_c', coalesce(num_c, mc) FROM v_obs, mm),
bd AS (SELECT attribute, min(x) AS lo, CASE WHEN max(x) > min(x) THEN pow(2, ceil(log2((max(x) - min(x)) / pow(2, 61)))) ELSE 1 END AS u FROM nl GROUP BY 1),
pt AS (SELECT attribute, key, y, CAST(round((x - lo) / u) AS BIGINT)
         + (('0x' || substr(md5(CAST(key AS VARCHAR) || '-' || attribute), 1, 15))::BIGINT >> 30) AS p FROM nl JOIN bd USING (attribute)),
nn AS (SELECT *, count(*) OVER (PARTITION BY attribute, y) AS sz,
         {", ".join(f"coalesce(p - lag(p, {j}) OVER w, {FAR}) AS l{j}, coalesce(lead(p, {j}) OVER w - p, {FAR}) AS r{j}" for j in (1, 2, 3))}
       FROM pt WINDOW w AS (PARTITION BY attribute, y ORDER BY p, key)),
rd AS (SELECT attribute, key, p, sz, greatest(least(l3, greatest(l2, r1), greatest(l1, r2), r3) - 1, 0) AS r FROM nn WHERE sz > 3),
wn AS (SELECT attribute, sz, count(*) OVER (PARTITION BY attribute ORDER BY p RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS m FROM rd),
ks AS (SELECT attribute, greatest({digamma_sql('count(*)')} + avg({digamma_sql('3')} - {digamma_sql('sz')} - {digamma_sql('m')}), 0.0) AS score
       FROM wn GROUP BY attribute),
cells AS (SELECT attribute, 1 AS x, y, n1::DOUBLE AS n FROM fl
          UNION ALL SELECT attribute, 0, y, (ny - n1)::DOUBLE FROM fl),
px AS (SELECT attribute, x, sum(n) AS nx FROM cells GROUP BY 1, 2),
py AS (SELECT attribute, y, sum(n) AS nyy FROM cells GROUP BY 1, 2),
tt AS (SELECT attribute, sum(n) AS nt FROM cells GROUP BY 1),
mi AS (SELECT c.attribute, greatest(sum(c.n / tt.nt * ln(c.n * tt.nt / (px.nx * py.nyy))), 0.0) AS score
       FROM cells c JOIN px ON c.attribute = px.attribute AND c.x = px.x
       JOIN py ON c.attribute = py.attribute AND c.y = py.y JOIN tt ON c.attribute = tt.attribute
       WHERE c.n > 0 GROUP BY c.attribute)"""


@query("exp3_mutual_information", f"WITH {MI_SQL} SELECT attribute, round(score, 6) AS score FROM mi UNION ALL SELECT attribute, round(score, 6) FROM ks", ("v_obs",))
def exp3(spark, d):
    return r6(ex.mutual_information(obs_once(spark, d), "target", CATS, NUMS))


def _rules_sql(min_support: float, min_lift: float) -> str:
    return f"""bk AS (SELECT DISTINCT key, item FROM v_basket),
nb AS (SELECT count(DISTINCT key) AS n FROM bk),
s1 AS (SELECT [item] AS items, count(*) AS f FROM bk GROUP BY item),
s2 AS (SELECT [a.item, b.item] AS items, count(*) AS f FROM bk a JOIN bk b ON a.key = b.key AND a.item < b.item
       GROUP BY a.item, b.item),
s3 AS (SELECT [a.item, b.item, c.item] AS items, count(*) AS f FROM bk a
       JOIN bk b ON a.key = b.key AND a.item < b.item JOIN bk c ON a.key = c.key AND b.item < c.item
       GROUP BY a.item, b.item, c.item),
s4 AS (SELECT [a.item, b.item, c.item, e.item] AS items, count(*) AS f FROM bk a
       JOIN bk b ON a.key = b.key AND a.item < b.item JOIN bk c ON a.key = c.key AND b.item < c.item
       JOIN bk e ON a.key = e.key AND c.item < e.item GROUP BY a.item, b.item, c.item, e.item),
fr AS (SELECT items, f / n AS support FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3
       UNION ALL SELECT * FROM s4), nb WHERE f >= ceil({min_support} * n)),
sb AS (SELECT items, support, m FROM fr, range(1, (1 << len(items)) - 1) r(m) WHERE len(items) >= 2),
ru AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS ant,
              list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS con, support FROM sb),
rl AS (SELECT ant, con, a.support AS antecedent_support, c.support AS consequent_support, ru.support,
              ru.support / a.support AS confidence
       FROM ru JOIN fr a ON a.items = ru.ant JOIN fr c ON c.items = ru.con),
rules AS (SELECT ant, con, antecedent_support, consequent_support, support, confidence,
                 confidence / consequent_support AS lift,
                 support - antecedent_support * consequent_support AS leverage,
                 CASE WHEN confidence < 1 THEN (1 - consequent_support) / (1 - confidence) END AS conviction
          FROM rl WHERE confidence / consequent_support >= {min_lift})"""


RULE_SUPPORT, RULE_LIFT = 0.1, 1.0


@query(
    "exp6_association_rules",
    f"""WITH {_rules_sql(RULE_SUPPORT, RULE_LIFT)}
SELECT array_to_string(ant, ',') AS antecedents, array_to_string(con, ',') AS consequents,
       round(antecedent_support, 6) AS antecedent_support, round(consequent_support, 6) AS consequent_support,
       round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
       round(leverage, 6) AS leverage, round(conviction, 6) AS conviction FROM rules""",
    ("v_basket",),
)
def exp6(spark, d):
    r = ex.association_rules(views.v_basket(spark, d), min_support=RULE_SUPPORT, min_lift=RULE_LIFT)
    return r6(
        r.withColumn("antecedents", F.array_join("antecedents", ",")).withColumn(
            "consequents", F.array_join("consequents", ",")
        )
    )


@query(
    "exp7_rule_outcomes",
    f"""WITH {_rules_sql(RULE_SUPPORT, RULE_LIFT)},
rr AS (SELECT array_to_string(ant, ',') || ' -> ' || array_to_string(con, ',') AS rules,
              list_distinct(list_concat(ant, con)) AS its FROM rules),
ei AS (SELECT rules, len(its) AS k, unnest(its) AS item FROM rr),
hit AS (SELECT rules, k, bk.key, count(*) AS mm FROM ei JOIN bk ON ei.item = bk.item GROUP BY rules, k, bk.key),
rows_ AS (SELECT rules, key FROM hit WHERE mm = k)
SELECT rules, round(avg(label::DOUBLE), 6) AS outcome, count(*) AS outcome_count
FROM rows_ JOIN v_pred ON rows_.key = v_pred.key GROUP BY rules""",
    ("v_basket", "v_pred"),
)
def exp7(spark, d):
    t = views.v_basket(spark, d)
    r = ex.association_rules(t, min_support=RULE_SUPPORT, min_lift=RULE_LIFT)
    return r6(ex.rule_outcomes(r, t, preds(spark, d), "key", "item", "label"))


@query(
    "exp8_category_connection",
    f"""WITH {CONN_SQL},
l2 AS ({_union("SELECT '{c}' AS category, coalesce({c}, 'unknown') AS level FROM v_obs", CATS)}),
disp AS (SELECT category || '_' || level AS feature, count(*) / (SELECT count(*) FROM v_obs) AS pct, category
         FROM l2 GROUP BY category, level),
j AS (SELECT disp.feature, category, pct, coalesce(conn.diff_from_expectation, 0.0) AS dfe
      FROM disp LEFT JOIN conn ON disp.feature = conn.feature)
SELECT feature, category, 'percentage_of_category_level' AS variable, round(pct, 6) AS value FROM j
UNION ALL SELECT feature, category, 'diff_from_expectation', round(dfe, 6) FROM j""",
    ("v_obs",),
)
def exp8(spark, d):
    return r6(ex.category_connection(obs_once(spark, d), CATS, "target"))


@query(
    "exp9_density_by_target",
    """WITH mm AS (SELECT avg(num_c) AS m FROM v_obs),
x AS (SELECT target AS level, coalesce(num_c, m) AS x FROM v_obs, mm),
st AS (SELECT level, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS bw, min(x) AS lo, max(x) AS hi FROM x GROUP BY level),
dv AS (SELECT level, x AS v, count(*) AS c FROM x GROUP BY level, x),
g AS (SELECT level, CAST(range AS INTEGER) AS point,
             (lo - 3.0 * bw) + range * ((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199 AS gx, n, bw FROM st, range(200))
SELECT g.level, point, round(gx, 6) AS x,
       round(sum(c * exp(-0.5 * pow((gx - v) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM g JOIN dv ON g.level = dv.level GROUP BY g.level, point, gx, n, bw""",
    ("v_obs",),
)
def exp9(spark, d):
    return r6(ex.density_by_target(obs_once(spark, d), "num_c", "target"))


PPS_SQL = f"""WITH b AS (SELECT CAST(('0x' || substr(md5(CAST(key AS VARCHAR)), 1, 15))::BIGINT % 4 AS INTEGER) AS fold,
                     target AS y, cat_a, cat_b, cat_c, num_a, num_b, num_c FROM v_obs),
l AS ({_union("SELECT fold, y, '{c}_' || coalesce({c}, 'nan') AS attribute FROM b", CATS)}),
n1 AS (SELECT attribute, fold, y, count(*) AS n1 FROM l GROUP BY 1, 2, 3),
nt AS (SELECT fold, y, count(*) AS nt FROM b GROUP BY 1, 2),
gr AS (SELECT a.attribute, nt.fold, nt.y, nt.nt, coalesce(n1.n1, 0) AS n1 FROM (SELECT DISTINCT attribute FROM n1) a
       CROSS JOIN nt LEFT JOIN n1 ON n1.attribute = a.attribute AND n1.fold = nt.fold AND n1.y = nt.y),
nl AS ({_union("SELECT fold, y, '{c}' AS attribute, {c} AS x FROM b WHERE {c} IS NOT NULL", NUMS)}),
ed AS (SELECT attribute, list_sort(list_distinct(quantile_cont(x, {DECILES}))) AS e FROM nl GROUP BY 1),
cells0 AS (SELECT attribute, fold, 1 AS v, y, n1 AS n FROM gr UNION ALL SELECT attribute, fold, 0, y, nt - n1 FROM gr
           UNION ALL SELECT nl.attribute, fold, CAST(1 + len(list_filter(e, lambda t: x > t)) AS INTEGER), y, count(*)
           FROM nl JOIN ed ON nl.attribute = ed.attribute GROUP BY ALL),
cells AS (SELECT * FROM cells0 WHERE n > 0),
allc AS (SELECT attribute, v, y, sum(n) AS na FROM cells GROUP BY 1, 2, 3),
fk AS (SELECT DISTINCT fold FROM cells),
tr AS (SELECT a.attribute, fk.fold, a.v, a.y, a.na - coalesce(c.n, 0) AS t FROM allc a CROSS JOIN fk
       LEFT JOIN cells c ON c.attribute = a.attribute AND c.fold = fk.fold AND c.v = a.v AND c.y = a.y),
pred AS (SELECT attribute, fold, v, first(y ORDER BY t DESC, y ASC) AS yhat FROM tr WHERE t > 0 GROUP BY 1, 2, 3),
dfl AS (SELECT attribute, fold, first(y ORDER BY tc DESC, y ASC) AS ydef
        FROM (SELECT attribute, fold, y, sum(t) AS tc FROM tr GROUP BY 1, 2, 3) WHERE tc > 0 GROUP BY 1, 2),
held AS (SELECT c.attribute, c.fold, c.y, coalesce(p.yhat, d.ydef) AS yp, c.n FROM cells c
         LEFT JOIN pred p ON p.attribute = c.attribute AND p.fold = c.fold AND p.v = c.v
         LEFT JOIN dfl d ON d.attribute = c.attribute AND d.fold = c.fold),
conf AS (SELECT attribute, fold, y, yp, sum(n) AS c FROM held GROUP BY 1, 2, 3, 4),
pc AS (SELECT attribute, fold, cls, sum(sup) AS sup, sum(tp) AS tp, sum(pcn) AS pcn FROM (
         SELECT attribute, fold, y AS cls, c AS sup, CASE WHEN y = yp THEN c ELSE 0 END AS tp, 0 AS pcn FROM conf
         UNION ALL SELECT attribute, fold, yp, 0, 0, c FROM conf) GROUP BY 1, 2, 3),
wf AS (SELECT attribute, fold, sum(sup * CASE WHEN 2 * tp + (pcn - tp) + (sup - tp) > 0
                                            THEN 2.0 * tp / (2 * tp + (pcn - tp) + (sup - tp)) ELSE 0.0 END) / sum(sup) AS wf1
       FROM pc GROUP BY 1, 2),
md AS (SELECT attribute, avg(wf1) AS model_score FROM wf GROUP BY 1),
ct AS (SELECT attribute, y, sum(n) AS nc FROM cells GROUP BY 1, 2),
bl AS (SELECT attribute, (max(nc) / sum(nc)) * (2.0 * max(nc) / (2.0 * max(nc) + (sum(nc) - max(nc)))) AS baseline_score
       FROM ct GROUP BY 1)
SELECT md.attribute AS feature,
       round(CASE WHEN model_score <= baseline_score THEN 0.0 ELSE (model_score - baseline_score) / (1 - baseline_score) END, 6) AS pps,
       round(model_score, 6) AS model_score, round(baseline_score, 6) AS baseline_score
FROM md JOIN bl ON md.attribute = bl.attribute"""


@query("exp4_predictive_power", PPS_SQL, ("v_obs",))
def exp4(spark, d):
    return r6(ex.predictive_power(obs_once(spark, d), "key", "target", CATS, NUMS))
