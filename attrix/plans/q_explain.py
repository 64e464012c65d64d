"""Explanation queries (survey section 2.13) with a closed-form logistic scorer
on the mean-imputed numeric features of v_obs, so every value has an exact
SQL oracle.  Model-based variants (MLlib models) are tested in tests/."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from attrix.operators import encoders as en
from attrix.operators import explain as xp
from attrix.operators import trees as tt
from attrix.operators.serve import linear_scorer
from attrix.operators.windows import head_hash_ordered
from attrix.plans import views
from attrix.plans.common import obs_once, r6, r6_many
from attrix.plans.registry import query

NUMS = ["num_a", "num_b", "num_c"]
COEFS = {"num_a": 4e-6, "num_b": 1e-4, "num_c": 1e-2}
INTERCEPT = -1.0
SCORE = xp.expr_scorer(lambda: linear_scorer(COEFS, INTERCEPT))

X_SQL = """mm AS (SELECT avg(num_a) AS ma, avg(num_b) AS mb, avg(num_c) AS mc FROM v_obs),
x AS (SELECT key, CASE WHEN target = 'yes' THEN 1 ELSE 0 END AS label, num_a AS ra, num_b AS rb, num_c AS rc,
             coalesce(num_a, ma) AS num_a, coalesce(num_b, mb) AS num_b, coalesce(num_c, mc) AS num_c FROM v_obs, mm)"""


def sig(a: str = "num_a", b: str = "num_b", c: str = "num_c") -> str:
    return f"(1 / (1 + exp(-(((-1.0 + 4e-6 * {a}) + 1e-4 * {b}) + 1e-2 * {c}))))"


def nll(p: str) -> str:
    clip = f"least(greatest({p}, 1e-15), 1 - 1e-15)"
    return f"avg(CASE WHEN label = 1 THEN ln({clip}) ELSE ln(1 - {clip}) END)"


def xframe(spark, d):
    o = obs_once(spark, d, ["key", "target", *NUMS]).select(
        "key", F.when(F.col("target") == "yes", 1).otherwise(0).alias("label"), *NUMS
    )
    return en.impute_mean(o, NUMS)


SHAP_SQL = f"""{X_SQL},
sh AS (SELECT key, 'num_a' AS feature, 4e-6 * (num_a - ma) AS shap FROM x, mm
       UNION ALL SELECT key, 'num_b', 1e-4 * (num_b - mb) FROM x, mm
       UNION ALL SELECT key, 'num_c', 1e-2 * (num_c - mc) FROM x, mm),
ev AS (SELECT ((-1.0 + 4e-6 * ma) + 1e-4 * mb) + 1e-2 * mc AS expected_value FROM mm)"""


@query(
    "xpl1_linear_shapley",
    f"WITH {SHAP_SQL} SELECT key, feature, round(shap, 6) AS shap, round(expected_value, 6) AS expected_value FROM sh, ev",
    ("v_obs",),
)
def xpl1(spark, d):
    return r6(xp.linear_shapley(views.v_obs(spark, d), "key", COEFS, INTERCEPT))


def _h(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


_KP = "CAST(key AS VARCHAR) || '-' || CAST(perm AS VARCHAR)"
_PLACES = ", ".join(
    "1 + " + " + ".join(f"CASE WHEN h_{o} < h_{f} THEN 1 ELSE 0 END" for o in "abc" if o != f) + f" AS p_{f}" for f in "abc"
)
_HYBRID = sig(*[f"(CASE WHEN p_{f} <= step THEN num_{f} ELSE z_{f} END)" for f in "abc"])
SAMPLED_SQL = f"""WITH {X_SQL},
bg AS (SELECT num_a AS z_a, num_b AS z_b, num_c AS z_c, row_number() OVER (ORDER BY num_a, num_b, num_c) AS bid
       FROM (SELECT * FROM x ORDER BY {_h("CAST(key AS VARCHAR)")}, key LIMIT 100)),
r AS (SELECT key, num_a, num_b, num_c, p.range AS perm FROM x CROSS JOIN range(10) p),
o AS (SELECT *, {_h(_KP)} % (SELECT count(*) FROM bg) + 1 AS bid,
             {", ".join(f"{_h(_KP + f" || '-num_{f}'")} AS h_{f}" for f in "abc")} FROM r),
q AS (SELECT o.*, z_a, z_b, z_c, {_PLACES} FROM o JOIN bg ON o.bid = bg.bid),
s AS (SELECT key, perm, p_a, p_b, p_c, step, {_HYBRID} AS score
      FROM q CROSS JOIN (SELECT range AS step FROM range(4)) st),
c AS ({" UNION ALL ".join(f"SELECT key, 'num_{f}' AS feature, CASE WHEN step = p_{f} THEN score ELSE -score END AS d FROM s WHERE step IN (p_{f}, p_{f} - 1)" for f in "abc")})
SELECT key, feature, round(sum(d) / 10, 6) AS shap FROM c GROUP BY key, feature"""


@query("xpl1_sampled_shapley", SAMPLED_SQL, ("v_obs",))
def xpl1s(spark, d):
    x = xframe(spark, d)
    background = head_hash_ordered(x, "key", 100)
    return r6(xp.sampled_shapley(x, "key", NUMS, SCORE, background, permutations=10))


#: A forest of two trees on (num_a, num_b, num_c): tree, node, feature, cut, left, right, value; covers come from the rows.
FOREST = [
    (0, 0, 0, 150000.0, 1, 2, None), (0, 1, 1, 4000.0, 3, 4, None), (0, 2, 2, 150.0, 5, 6, None), (0, 3, -1, None, -1, -1, 0.1),
    (0, 4, 0, 60000.0, 7, 8, None), (0, 5, -1, None, -1, -1, 0.5), (0, 6, 1, 2000.0, 9, 10, None), (0, 7, -1, None, -1, -1, 0.25),
    (0, 8, -1, None, -1, -1, 0.4), (0, 9, -1, None, -1, -1, 0.7), (0, 10, -1, None, -1, -1, 0.9),
    (1, 0, 2, 120.0, 1, 2, None), (1, 1, 0, 100000.0, 3, 4, None), (1, 2, 1, 5000.0, 5, 6, None), (1, 3, -1, None, -1, -1, -0.2),
    (1, 4, -1, None, -1, -1, 0.3), (1, 5, 2, 200.0, 7, 8, None), (1, 6, -1, None, -1, -1, 0.35), (1, 7, -1, None, -1, -1, 0.15),
    (1, 8, -1, None, -1, -1, -0.1),
]


def _forest_sql() -> str:
    """Sums over all subsets of each path's features, spelled out."""
    by, covers, terms, expected = {(n[0], n[1]): n for n in FOREST}, [], {c: [] for c in NUMS}, []

    def walk(tree, node, conditions, path):
        _, _, f, cut, left, right, value = by[tree, node]
        covers.append(f"sum(CASE WHEN {' AND '.join(conditions) or 'true'} THEN 1 ELSE 0 END)::DOUBLE AS c{tree}_{node}")
        if f >= 0:
            for child, sign in ((left, "<="), (right, ">")):
                here, part = f"{NUMS[f]} {sign} {cut}", f"c{tree}_{child} / c{tree}_{node}"
                old = path.get(NUMS[f], ([], []))
                walk(tree, child, [*conditions, here], {**path, NUMS[f]: ([*old[0], here], [*old[1], part])})
            return
        fits = {c: f"(CASE WHEN {' AND '.join(k)} THEN 1.0 ELSE 0.0 END)" for c, (k, _) in path.items()}
        share = {c: f"({' * '.join(z)})" for c, (_, z) in path.items()}
        expected.append(f"{value}::DOUBLE * {' * '.join(share.values())}")
        for c in path:
            others = [o for o in path if o != c]
            for size in range(len(others) + 1):
                weight = factorial(size) * factorial(len(others) - size) / factorial(len(path))
                for s in combinations(others, size):
                    product = " * ".join([f"{value}::DOUBLE * {weight}::DOUBLE", *[fits[o] if o in s else share[o] for o in others]])
                    terms[c].append(f"{product} * ({fits[c]} - {share[c]})")

    for tree in sorted({n[0] for n in FOREST}):
        walk(tree, 0, [], {})
    ev = " + ".join(expected)
    parts = [f"SELECT key, '{c}' AS feature, round({' + '.join(terms[c])}, 6) AS shap, round({ev}, 6) AS expected_value FROM x, cv" for c in NUMS]
    return f"WITH {X_SQL},\ncv AS (SELECT {', '.join(covers)} FROM x)\n" + " UNION ALL ".join(parts)


@query("xpl1_tree_shapley", _forest_sql(), ("v_obs",))
def xpl1t(spark, d):
    x = VectorAssembler(inputCols=NUMS, outputCol="features").transform(xframe(spark, d))
    nodes = spark.createDataFrame(tt.node_covers(x, FOREST, NUMS), tt.NODES)
    names = spark.createDataFrame(list(enumerate(NUMS)), "slot int, feature string")
    return r6(tt.tree_shapley(x, "key", tt.tree_paths(nodes), names))


@query(
    "xpl2_global_importance",
    f"""WITH {SHAP_SQL}
SELECT 'model_v' AS model_uid, feature, round(avg(abs(shap)), 6) AS importance_score,
       'mean_abs_shap' AS importance_metric FROM sh GROUP BY feature""",
    ("v_obs",),
)
def xpl2(spark, d):
    return r6(xp.global_importance(xp.linear_shapley(views.v_obs(spark, d), "key", COEFS, INTERCEPT), "model_v"))


@query(
    "xpl4_permutation_importance",
    f"""WITH {X_SQL},
r AS (SELECT key, row_number() OVER (ORDER BY key) AS slot, num_a, num_b, num_c FROM x),
don AS (SELECT slot, 'num_a' AS feature, num_a AS donor FROM r UNION ALL SELECT slot, 'num_b', num_b FROM r
        UNION ALL SELECT slot, 'num_c', num_c FROM r),
g AS (SELECT x.key, f.feature, rp.range AS rep FROM x CROSS JOIN (VALUES ('num_a'), ('num_b'), ('num_c')) f(feature)
      CROSS JOIN range(10) rp),
pm AS (SELECT key, feature, rep, row_number() OVER (PARTITION BY feature, rep ORDER BY
          ('0x' || substr(md5(CAST(key AS VARCHAR) || '-' || feature || '-' || CAST(rep AS VARCHAR)), 1, 15))::BIGINT, key) AS slot
       FROM g),
j AS (SELECT pm.feature, pm.rep, x.label,
             CASE WHEN pm.feature = 'num_a' THEN don.donor ELSE x.num_a END AS a,
             CASE WHEN pm.feature = 'num_b' THEN don.donor ELSE x.num_b END AS b,
             CASE WHEN pm.feature = 'num_c' THEN don.donor ELSE x.num_c END AS c
      FROM pm JOIN don ON pm.feature = don.feature AND pm.slot = don.slot JOIN x ON x.key = pm.key),
sc AS (SELECT feature, rep, {nll(sig('a', 'b', 'c'))} AS s FROM j GROUP BY feature, rep),
base AS (SELECT {nll(sig())} AS base FROM x)
SELECT feature, round(avg(base - s), 6) AS importance_mean, round(stddev_pop(base - s), 6) AS importance_std
FROM sc, base GROUP BY feature""",
    ("v_obs",),
)
def xpl4(spark, d):
    return r6(xp.permutation_importance(xframe(spark, d), "key", "label", NUMS, SCORE, repeats=10, shuffle="hash"))


def _mq_pos(p: float, tag: str) -> str:
    """scipy mquantiles (alphap = betap = 0.4) positions: k (1-based upper index) and gamma."""
    aleph = f"(n * {p}::DOUBLE + (0.4::DOUBLE + {p}::DOUBLE * 0.2::DOUBLE))"
    k = f"floor(least(greatest({aleph}, 1.0), n - 1))"
    return f"{k} AS k{tag}, least(greatest({aleph} - {k}, 0.0), 1.0) AS g{tag}"


PDP_SQL = f"""{X_SQL},
s AS (SELECT num_b AS v, row_number() OVER (ORDER BY num_b) - 1 AS i FROM x),
nn AS (SELECT count(*) AS n FROM x),
kk AS (SELECT {_mq_pos(0.05, "a")}, {_mq_pos(0.95, "b")} FROM nn),
ab AS (SELECT (1 - ga) * max(CASE WHEN i = ka - 1 THEN v END) + ga * max(CASE WHEN i = ka THEN v END) AS a,
              (1 - gb) * max(CASE WHEN i = kb - 1 THEN v END) + gb * max(CASE WHEN i = kb THEN v END) AS b
       FROM s, kk GROUP BY ka, ga, kb, gb),
gr AS (SELECT CAST(range AS INTEGER) AS point,
              CASE WHEN range = 99 THEN b ELSE range * ((b - a) / 99) + a END AS grid_value FROM ab, range(100))"""


@query(
    "xpl6_partial_dependence",
    f"""WITH {PDP_SQL}
SELECT 'num_b' AS feature, point, round(grid_value, 6) AS grid_value, round(avg({sig('num_a', 'grid_value', 'num_c')}), 6) AS average
FROM x, gr GROUP BY point, grid_value""",
    ("v_obs",),
)
def xpl6(spark, d):
    return r6(xp.partial_dependence(xframe(spark, d), "num_b", SCORE))


@query(
    "xpl7_ice_curves",
    f"""WITH {PDP_SQL}
SELECT key, point, round(grid_value, 6) AS grid_value, round({sig('num_a', 'grid_value', 'num_c')}, 6) AS prediction
FROM x, gr""",
    ("v_obs",),
)
def xpl7(spark, d):
    return r6_many(xp.ice_curves(xframe(spark, d), "key", "num_b", SCORE))


@query(
    "xpl8_ale",
    f"""WITH {X_SQL},
nn AS (SELECT count(*) AS n FROM x),
s AS (SELECT num_b AS v, row_number() OVER (ORDER BY num_b) - 1 AS i FROM x),
qi AS (SELECT DISTINCT CAST(floor((n - 1) * (range / 20)) AS BIGINT) AS i FROM nn, range(21)),
e AS (SELECT list_sort(list_distinct(list(v))) AS e FROM s WHERE i IN (SELECT i FROM qi)),
b AS (SELECT x.*, greatest(1, len(list_filter(e, lambda t: t < num_b))) AS bin, e FROM x, e),
dl AS (SELECT bin, {sig('num_a', 'e[bin + 1]', 'num_c')} - {sig('num_a', 'e[bin]', 'num_c')} AS delta FROM b),
pb AS (SELECT bin, avg(delta) AS eff, count(*) AS size FROM dl GROUP BY bin),
ac AS (SELECT bin, size, sum(eff) OVER (ORDER BY bin) AS ale FROM pb),
ac2 AS (SELECT *, coalesce(lag(ale) OVER (ORDER BY bin), 0.0) AS ale_prev FROM ac),
cc AS (SELECT sum((ale_prev + ale) / 2 * size) / sum(size) AS c FROM ac2),
pts AS (SELECT bin AS point, ale, size FROM ac UNION ALL SELECT 0, 0.0, 0)
SELECT 'num_b' AS feature, CAST(point AS INTEGER) AS point, round(e[point + 1], 6) AS edge, round(ale - c, 6) AS ale,
       CAST(size AS BIGINT) AS size FROM pts, e, cc""",
    ("v_obs",),
)
def xpl8(spark, d):
    return r6(xp.ale(xframe(spark, d), "num_b", SCORE))
