"""Model-fitting operators (rows/property checks: fits differ by engine)."""

import pytest
from pyspark.sql import functions as F

from attrix.operators import compare as cm
from attrix.operators import explain as xp
from attrix.operators import explore as ex
from attrix.operators import train as tr
from attrix.plans import views

SF = "/root/testdata/sf0.001"
NUMS = ["num_a", "num_b", "num_c"]
CATS = ["cat_a", "cat_b"]


@pytest.fixture(scope="module")
def frame(spark):
    o = views.v_obs(spark, SF)
    return tr.training_frame(o, "key", "target", drop=["client_id"]).cache()


def _pipe(params=None, cats=CATS, nums=NUMS):
    model = tr.model_family("random_forest", {"numTrees": 10, "maxDepth": 4, **(params or {})})
    return tr.build_pipeline(model, numeric=nums, categorical=cats, date_col="acquired_date",
                             clips=[("num_a", 300000.0, 300000.0, "upper")], ratios=[("num_a", "num_c")],
                             log_cols=["num_a"], num_percentile=100, cat_percentile=100)


def lineage(model):
    return [r["feature"] for r in tr.feature_lineage(model).orderBy("slot").collect()]


def test_pipeline_fit_transform_and_lineage(frame):
    train = frame.where("split = 'train'")
    m = _pipe().fit(train)
    out = m.transform(frame.where("split = 'test'"))
    assert out.select("probability").count() == frame.where("split = 'test'").count()
    names = lineage(m)
    assert len(names) > 0 and any(n.startswith("num_a") for n in names)
    enc = tr.transform_only(m).transform(train)
    assert all(r["features"].size == len(names) for r in enc.select("features").collect())
    # the log is of the clipped column, and every name is an input of the encoder
    assert "num_a__log" in names and "num_a__clip" not in names and "num_a_num_c_ratio" in names
    levels = {f"cat_b={r[0]}" for r in train.select("cat_b").distinct().collect()}
    assert levels <= set(names)


def test_tune_leaderboard(frame):
    train = frame.where("split = 'train'")
    space = {"maxDepth": ("int", 2, 4), "featureSubsetStrategy": ("choice", ["log2", "sqrt"])}
    model, board, params = tr.tune(train, "key", lambda p: _pipe(p), space, trials=2, folds=3)
    rows = board.orderBy("ranking").collect()
    assert [r["ranking"] for r in rows] == [0, 1]
    assert rows[0]["mean"] >= rows[1]["mean"]
    assert model.transform(train).count() == train.count()


def test_calibration_prefit_and_cv(frame):
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    m = _pipe().fit(train)
    for method in ("sigmoid", "isotonic"):
        cal = tr.calibrate_fitted(m, test, method)
        p = cal.transform(test)
        assert p.where((F.col("prob") < 0) | (F.col("prob") > 1)).count() == 0
    cv = tr.calibrated_cv(train, "key", _pipe(), folds=2)
    assert cv.transform(test).count() == test.count()


def test_concept_shift_row(spark):
    v = views.v_drift(spark, SF)
    t, p = v.where("side = 'train'"), v.where("side = 'prod'")
    small = {"maxDepth": [3], "minInstancesPerNode": [1], "featureSubsetStrategy": ["sqrt"]}
    r = tr.concept_shift_report(t, p, ["value"], ["event_type", "user_group"], "key", "m1", folds=2, grid=small).first()
    assert r["metric_used"] == "roc_auc" and 0 <= r["model_score"] <= 1
    assert r["shift_occurred"] == (r["model_score"] >= 0.55)


def test_concept_shift_scores_rows_it_was_not_fitted_on(spark, monkeypatch):
    """Both sides alike: the AUC is that of the test split, not the best of the grid's cross-validation."""
    v = views.v_drift(spark, SF)
    sizes, real = [], tr.ev.roc_auc
    monkeypatch.setattr(tr.ev, "roc_auc", lambda s, *a: (sizes.append(s.select("key", "split").distinct().groupBy("split").count().collect()), real(s, *a))[1])
    small = {"maxDepth": [2], "minInstancesPerNode": [1], "featureSubsetStrategy": ["sqrt"]}
    tr.concept_shift_report(v.where("side = 'train'"), v.where("side = 'prod'"), ["value"], ["event_type"], "key", "m1", folds=2, grid=small)
    assert [{r["split"] for r in rows} for rows in sizes] == [{"train"}, {"train"}, {"test"}]


def test_calibrated_cv_averages_its_folds(frame):
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    cv = tr.calibrated_cv(train, "key", _pipe(), folds=2)
    got = {r["key"]: r["prob"] for r in cv.transform(test).select("key", "prob").collect()}
    each = [{r["key"]: r["prob"] for r in m.transform(test).select("key", "prob").collect()} for m in cv.members]
    assert len(each) == 2 and any(abs(each[0][k] - each[1][k]) > 1e-6 for k in got)
    assert all(abs(p - (each[0][k] + each[1][k]) / 2) < 1e-9 for k, p in got.items())


def test_bias_variance_refits(frame):
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    preds = tr.bootstrap_predictions(train, test, "key", _pipe(), rounds=3)
    r = cm.bias_variance(preds, "key", "label", "round", "pred").first()
    assert 0 <= r["bias"] <= 1 and 0 <= r["variance"] <= 1 and 0 <= r["expected_loss"] <= 1


def test_embedded_and_drop_column(frame):
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    m = _pipe().fit(train)
    names = lineage(m)
    scores = xp.embedded_scores(m.stages[-1], names)
    assert len(names) == len(m.stages[-1].featureImportances.toArray()) == len(scores)
    res = xp.drop_column_importance(train, test, "label", ["num_a", "num_b"], lambda cols: _pipe(nums=list(cols) or ["num_c"]))
    assert {c for c, _ in res} == {"num_a", "num_b"}


def test_projection_and_kmeans(spark):
    o = views.v_obs(spark, SF)
    pr = ex.projection_2d(o, "key", "target", NUMS, sample=500)
    assert pr.count() == 500 and set(pr.columns) == {"key", "x", "y", "target"}
    clustered, sil = ex.kmeans_clusters(o, "key", CATS, NUMS, max_clusters=3, sample=500)
    assert set(sil) == {2, 3} and clustered.select("cluster").distinct().count() in (2, 3)


def test_model_scorer_permutation_importance(frame):
    train = frame.where("split = 'train'")
    m = _pipe().fit(train)
    score = xp.model_scorer(m)
    imp = xp.permutation_importance(train.limit(200), "key", "label", ["num_a", "num_b"], score, repeats=2)
    assert imp.count() == 2


def test_orchestrators(spark):
    from attrix.operators.evaluate import evaluate_all
    from attrix.operators.explain import explain_all

    p = views.v_pred(spark, SF)
    rep = evaluate_all(p, "m1", views.v_obs(spark, SF), categorical=["cat_b"], numeric=["num_a"])
    assert rep["metric_table"].count() == 5 and rep["by_partition"].count() > 0
    x = views.v_obs(spark, SF).select("key", F.when(F.col("target") == "yes", 1).otherwise(0).alias("label"), "num_a", "num_b")
    from attrix.operators.serve import linear_scorer

    xr = explain_all(x.na.fill(0.0), "key", "label", ["num_a", "num_b"],
                     xp.expr_scorer(lambda: linear_scorer({"num_a": 4e-6, "num_b": 1e-4}, -1.0)), background_n=20, sample_n=200)
    assert xr["global_importance"].count() == 2 and xr["ale_num_a"].count() > 1
