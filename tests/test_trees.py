"""Tree Shapley values against subset enumeration; extremely randomised trees."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from attrix.operators import evaluate as ev
from attrix.operators import explain as xp
from attrix.operators import train as tr
from attrix.operators import trees as tt
from attrix.operators.extra_trees import ExtraTreesClassifier, bin_edges
from attrix.sinks.writers import save_pipeline


def random_tree(rng, tree, features, depth, levels=False):
    """Rows of a node table; covers add up, some are 0."""
    rows = []

    def grow(node, cover, depth):
        if depth == 0 or rng.random() < 0.15:
            rows.append((tree, node, -1, None, None, -1, -1, rng.uniform(-1, 1), float(cover)))
            return
        left, right = 2 * node + 1, 2 * node + 2
        mine = rng.randint(0, cover) if rng.random() < 0.9 else 0
        known = [float(v) for v in rng.sample(range(4), rng.randint(1, 3))] if levels and rng.random() < 0.5 else None
        rows.append((tree, node, rng.randrange(features), None if known else rng.uniform(0, 3), known, left, right, None, float(cover)))
        grow(left, mine, depth - 1)
        grow(right, cover - mine, depth - 1)

    grow(0, 1000, depth)
    return rows


def value_knowing(rows, x, known):
    """Score when only ``known`` features are known; others follow the covers."""
    by = {(r[0], r[1]): r for r in rows}

    def down(t, n):
        _, _, f, cut, levels, left, right, value, cover = by[t, n]
        if f < 0:
            return value
        if f in known:
            under = x[f] in levels if levels else x[f] <= cut
            return down(t, left if under else right)
        shares = [by[t, c][8] / cover if cover else 0.5 for c in (left, right)]
        return shares[0] * down(t, left) + shares[1] * down(t, right)

    return sum(down(t, 0) for t in {r[0] for r in rows})


def enumerated(rows, x, features):
    out = []
    for i in range(features):
        others = [f for f in range(features) if f != i]
        total = 0.0
        for size in range(features):
            weight = math.factorial(size) * math.factorial(features - size - 1) / math.factorial(features)
            for s in itertools.combinations(others, size):
                total += weight * (value_knowing(rows, x, {*s, i}) - value_knowing(rows, x, set(s)))
        out.append(total)
    return out


@pytest.mark.parametrize("features,depth,levels", [(1, 3, False), (3, 4, True), (6, 6, False), (8, 8, True)])
def test_values_equal_subset_enumeration(spark, features, depth, levels):
    rng = random.Random(features)
    rows = [r for t in range(3) for r in random_tree(rng, t, features, depth if t else 2, levels)]
    paths = tt.tree_paths(spark.createDataFrame(rows, tt.NODES))
    x = np.array([[rng.choice([rng.uniform(0, 3), float(rng.randrange(4))]) for _ in range(features)] for _ in range(6)])
    got = paths.shapley(x[:, paths.features])
    for row, values in zip(x, got):
        want = enumerated(rows, row, features)
        full = np.zeros(features)
        full[paths.features] = values
        assert np.allclose(full, want, atol=1e-9)
    assert np.allclose(got.sum(axis=1) + paths.expected, paths.scores(x[:, paths.features]))
    assert paths.expected == pytest.approx(value_knowing(rows, x[0], set()))


def test_small_blocks_and_lone_leaves(spark, monkeypatch):
    rows = random_tree(random.Random(9), 0, 4, 5) + [(1, 0, -1, None, None, -1, -1, 0.25, 10.0)]
    paths = tt.tree_paths(spark.createDataFrame(rows, tt.NODES))
    x = np.random.default_rng(1).uniform(0, 3, (50, len(paths.features)))
    whole = paths.shapley(x)
    monkeypatch.setattr(tt, "CELLS", 1)
    assert np.allclose(paths.shapley(x), whole)
    alone = tt.tree_paths(spark.createDataFrame(rows[-1:], tt.NODES))
    assert alone.expected == 0.25 and alone.shapley(np.zeros((2, 0))).shape == (2, 0)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        a, b, c, d = rng.random(), rng.random(), rng.gauss(0, 1), rng.choice("uvwxyz")
        p = 1 / (1 + math.exp(-(4 * a - 2 + 2 * (b > 0.5) * c + (d in "uv"))))
        rows.append((i, a, b, c, d, int(rng.random() < p)))
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d string, label int")
    coded = StringIndexer(inputCol="d", outputCol="d_at").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "c", "d_at"], outputCol="features").transform(coded)


@pytest.mark.parametrize(
    "maker,options",
    [(DecisionTreeClassifier, {"maxDepth": 5}), (RandomForestClassifier, {"numTrees": 6, "maxDepth": 5, "seed": 1}), (GBTClassifier, {"maxIter": 5, "maxDepth": 3, "seed": 1})],
    ids=["tree", "forest", "boosting"],
)
def test_values_add_up_to_the_models_score(table, maker, options):
    fitted = maker(**options).fit(table)
    paths = tt.tree_paths(tt.tree_nodes(fitted))
    assert paths.levels  # the coded column is split by levels
    scored = {r["key"]: r["p"] for r in fitted.transform(table).select("key", vector_to_array("probability")[1].alias("p")).collect()}
    rows = tt.tree_shapley(table, "key", paths).groupBy("key").agg((F.sum("shap") + F.first("expected_value")).alias("s")).collect()
    assert len(rows) == 900
    for r in rows:
        s = 1 / (1 + math.exp(-r["s"])) if maker is GBTClassifier else r["s"]
        assert s == pytest.approx(scored[r["key"]], abs=1e-9)


def _pipe(model, **more):
    return tr.build_pipeline(model, numeric=["a", "b", "c"], categorical=["d"], num_percentile=100, cat_percentile=100, **more)


def test_folds_are_averaged_by_feature_name(table):
    rows = table.drop("features", "d_at")
    models = [_pipe(RandomForestClassifier(numTrees=3, maxDepth=3, seed=s)).fit(rows.where(f"key % 3 <> {s}")) for s in range(2)]
    got = {(r["key"], r["feature"]): (r["shap"], r["expected_value"]) for r in tt.fold_shapley(rows, "key", models).where("key < 20").collect()}
    each = [{(r["key"], r["feature"]): (r["shap"], r["expected_value"]) for r in tt.model_shapley(rows, "key", m).where("key < 20").collect()} for m in models]
    assert set(got) == set(each[0]) | set(each[1]) and {f for _, f in got} <= {"a", "b", "c", *(f"d={v}" for v in "uvwxyz")}
    expected = sum(next(iter(e.values()))[1] for e in each) / 2
    for k, (shap, base) in got.items():
        assert shap == pytest.approx(sum(e.get(k, (0.0,))[0] for e in each) / 2) and base == pytest.approx(expected)


def test_explanations_of_a_fitted_pipeline(table):
    rows = table.drop("features", "d_at")
    model = _pipe(ExtraTreesClassifier(numTrees=5, maxDepth=4)).fit(rows)
    shap = tt.model_shapley(rows, "key", model)
    scored = {r["key"]: r["p"] for r in model.transform(rows).select("key", vector_to_array("probability")[1].alias("p")).collect()}
    for r in shap.groupBy("key").agg((F.sum("shap") + F.first("expected_value")).alias("s")).collect():
        assert r["s"] == pytest.approx(scored[r["key"]], abs=1e-9)
    assert xp.global_importance(shap).count() == shap.select("feature").distinct().count()
    names = [r["feature"] for r in tr.feature_lineage(model).orderBy("slot").collect()]
    assert sum(v for _, v in xp.embedded_scores(model.stages[-1], names)) == pytest.approx(1.0)


# ---------------------------------------------------------------- extra trees
def nodes_of(model):
    return sorted(tuple(r) for r in model.table.drop("levels").collect())


def test_extra_trees_repeat_however_the_rows_lie(table):
    maker = ExtraTreesClassifier(numTrees=4, maxDepth=4)
    first = nodes_of(maker.fit(table))
    assert nodes_of(maker.fit(table.repartition(5, "a"))) == first
    assert nodes_of(ExtraTreesClassifier(numTrees=4, maxDepth=4, seed=20).fit(table)) != first


def test_cells_are_counted_in_passes(table, monkeypatch):
    from attrix.operators import extra_trees

    first = nodes_of(ExtraTreesClassifier(numTrees=3, maxDepth=3).fit(table))
    monkeypatch.setattr(extra_trees, "CELLS", 300)
    assert nodes_of(ExtraTreesClassifier(numTrees=3, maxDepth=3).fit(table)) == first


def test_cuts_lie_within_the_nodes_range_and_vary(table):
    model = ExtraTreesClassifier(numTrees=12, maxDepth=4, featureSubsetStrategy="all").fit(table)
    x = {r["key"]: r["v"] for r in table.select("key", vector_to_array("features").alias("v")).collect()}
    by = {(r["tree"], r["node"]): r for r in model.table.collect()}

    def check(t, n, keys):
        r = by[t, n]
        assert r["cover"] == len(keys)
        if r["feature"] < 0:
            return
        values = [x[k][r["feature"]] for k in keys]
        assert min(values) <= r["cut"] < max(values)
        check(t, r["left"], [k for k in keys if x[k][r["feature"]] <= r["cut"]])
        check(t, r["right"], [k for k in keys if x[k][r["feature"]] > r["cut"]])

    for t in range(12):
        check(t, 0, list(x))
    assert len({(by[t, 0]["feature"], by[t, 0]["cut"]) for t in range(12)}) > 6


def test_extra_trees_score_near_the_forest(table):
    train, test = table.where("key % 3 <> 0"), table.where("key % 3 = 0")
    aucs = []
    for model in (ExtraTreesClassifier(numTrees=30, maxDepth=6), RandomForestClassifier(numTrees=30, maxDepth=6, seed=1)):
        scored = model.fit(train).transform(test).withColumn("prob", vector_to_array("probability")[1])
        assert scored.where("prob < 0 OR prob > 1").count() == 0
        aucs.append(ev.roc_auc(scored, "label", "prob").first()["roc_auc"])
    assert aucs[0] > 0.7 and aucs[0] > aucs[1] - 0.03


def test_weights_count_like_repeated_rows(spark, table):
    weighted = table.withColumn("w", F.when(F.col("key") % 4 == 0, 3.0).when(F.col("key") % 4 == 1, 0.0).otherwise(1.0))
    repeated = weighted.where("w > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("i"))
    assert nodes_of(ExtraTreesClassifier(numTrees=3, maxDepth=3, weightCol="w").fit(weighted)) == nodes_of(ExtraTreesClassifier(numTrees=3, maxDepth=3).fit(repeated))


def test_limits_one_class_and_constant_features(spark, table):
    model = ExtraTreesClassifier(numTrees=2, maxDepth=6, minWeightFractionPerNode=0.1).fit(table)
    assert min(r["cover"] for r in model.table.collect()) >= 90
    one = ExtraTreesClassifier(numTrees=2).fit(table.where("label = 1"))
    assert {r["prediction"] for r in one.transform(table).select("prediction").distinct().collect()} == {1.0}
    flat = VectorAssembler(inputCols=["z"], outputCol="features").transform(spark.range(20).selectExpr("id AS key", "1.0D AS z", "CAST(id % 2 AS INT) AS label"))
    model = ExtraTreesClassifier(numTrees=2).fit(flat)
    assert {round(r["p"], 9) for r in model.transform(flat).select(vector_to_array("probability")[1].alias("p")).collect()} == {0.5}
    with pytest.raises(ValueError):
        ExtraTreesClassifier().fit(table.withColumn("label", F.lit(2)))


def test_extra_trees_are_saved_with_the_pipeline(spark, table, tmp_dir):
    rows = table.drop("features", "d_at")
    model = _pipe(tr.model_family("extra_trees", {"numTrees": 3, "maxDepth": 3})).fit(rows)
    path = os.path.join(tmp_dir, "trees")
    save_pipeline(model, path)

    def probs(m):
        return [r["probability"] for r in m.transform(rows).orderBy("key").select("probability").collect()]

    assert probs(PipelineModel.load(path)) == probs(model)
    assert isinstance(Pipeline(stages=[]), Pipeline)


def test_bin_edges_lie_between_values():
    x = np.array([[1.0, 5.0, i] for i in range(200)] + [[2.0, 5.0, 3.0]])
    one, none, many = bin_edges(x, 16)
    assert one.tolist() == [1.5] and none.tolist() == [] and len(many) == 15 and (np.diff(many) > 0).all()


def test_explanation_bundle_of_a_model(table):
    rows = table.drop("features", "d_at").where("key < 150")

    def make(cols):
        return tr.build_pipeline(ExtraTreesClassifier(numTrees=2, maxDepth=2), numeric=list(cols), categorical=[], num_percentile=100)

    model = make(["a", "c"]).fit(rows)
    found = xp.explain_all(rows, "key", "label", ["a", "c"], xp.model_scorer(model), model=model, make_pipeline=make)
    assert {"shap", "global_importance", "permutation_importance", "embedded_scores", "drop_column_importance", "pdp_a", "ice_a", "ale_a"} <= set(found)
    assert {r["feature"] for r in found["embedded_scores"].collect()} == {"a", "c"}
    assert {r["feature"] for r in found["drop_column_importance"].collect()} == {"a", "c"}
    exact = {(r["key"], r["feature"]): r["shap"] for r in found["shap"].collect()}
    assert exact == {(r["key"], r["feature"]): pytest.approx(r["shap"]) for r in tt.model_shapley(rows, "key", model).collect()}
