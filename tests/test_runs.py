"""Training runs: folders, manifests, a run that dies and goes on, user estimators and scorers."""

import json

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from attrix.operators import evaluate as ev
from attrix.operators import runs
from attrix.operators import train as tr
from attrix.plans import views

SF = "/root/testdata/sf0.001"
SPEC = {"numeric": ["num_a", "num_b", "num_c"], "categorical": ["cat_b"], "date_col": "acquired_date", "log_cols": ["num_a"], "keep": ("key", "label", "split", "_weight")}


@pytest.fixture(scope="module")
def rows(spark):
    return views.v_obs(spark, SF).drop("client_id").where("key % 4 = 1").cache()


def test_a_run_is_read_back_whole(spark, rows, tmp_path):
    place = str(tmp_path)
    families = [("extra_trees", {"maxDepth": ("int", 2, 3)}), ("mine", {"maxDepth": ("int", 2, 3)}, DecisionTreeClassifier())]
    uids = tr_run(rows, place, families)
    states = {r["family"]: r for r in runs.run_states(spark, place).collect()}
    assert set(states) == {"extra_trees", "mine"} and all(s["complete"] and set(s["parts"]) == set(runs.PARTS) for s in states.values())
    for family, uid in uids.items():
        assert uid == states[family]["uid"] and uid.startswith(family)
        read = lambda part, uid=uid: spark.read.parquet(f"{place}/{uid}/{part}")
        data, preds = read("data"), read("predictions")
        assert data.count() == rows.count() and preds.count() == data.where("split = 'test'").count()
        model = runs.CalibratedModel.load(f"{place}/{uid}/model")
        again = {r["key"]: r["prob"] for r in model.transform(data.where("split = 'test'")).select("key", "prob").collect()}
        assert {r["key"]: pytest.approx(r["prob"]) for r in preds.collect()} == again and len(model.members) == 2
        assert {r["scoring_metric"] for r in read("model_score").collect()} == set(ev.METRIC_NAMES)
        assert {r["model_uid"] for r in read("feature_score").collect()} <= {uid}
        board = read("leaderboard").collect()
        assert sorted(r["ranking"] for r in board) == [0, 1]
        assert all(set(json.loads(r["params"])) == {*tr.PIPELINE_SPACE, "maxDepth"} for r in board)
        log = {r["part"]: r for r in read("manifest").collect()}
        assert set(log) == {"started", *runs.PARTS} and log["data"]["rows"] == data.count() and log["model"]["seconds"] > 0


def tr_run(rows, place, families, trials=2, spec=SPEC):
    return runs.train_run(rows, "key", "target", spec, place, families=families, trials=trials, folds=2, calibration_folds=2, parallelism=4)


def test_a_run_that_died_is_visible_and_goes_on(spark, rows, tmp_path, monkeypatch):
    place, families = str(tmp_path), [("tree", {"maxDepth": ("int", 2, 3)}, DecisionTreeClassifier())]
    few = {"trials": 1, "spec": {"numeric": ["num_a", "num_b"], "categorical": []}}
    real, searches = runs.search, []
    monkeypatch.setattr(runs, "search", lambda *a: (searches.append(1), real(*a))[1])
    monkeypatch.setattr(runs.ev, "metric_table", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tr_run(rows, place, families, **few)
    (state,) = runs.run_states(spark, place).collect()
    assert not state["complete"] and state["parts"] == ["data", "leaderboard", "model", "predictions"]
    monkeypatch.undo()
    monkeypatch.setattr(runs, "search", lambda *a: searches.append(1))
    assert tr_run(rows, place, families, **few) == {"tree": state["uid"]}
    assert searches == [1] and [r["complete"] for r in runs.run_states(spark, place).collect()] == [True]
    monkeypatch.setattr(runs, "search", real)
    again = tr_run(rows, place, families, **few)  # a whole run is left alone: this is a new one
    assert again["tree"] != state["uid"] and runs.run_states(spark, place).count() == 2


def test_pipeline_parameters_change_the_stages():
    make = tr.pipeline_maker(SPEC, LogisticRegression())
    stages = make({"take_log": "no", "combine": "no", "cat_percentile": 30, "num_percentile": 70, "regParam": 0.5}).getStages()
    by = {type(s).__name__: s for s in stages}
    assert "num_a__log" not in by["NumericFeatures"].getOrDefault("inputCols")
    assert by["NumericFeatures"].getOrDefault("percentile") == 70.0 and by["CategoricalFeatures"].getOrDefault("percentile") == 30.0
    assert by["CombineSparseLevels"].getOrDefault("enabled") == "no" and by["LogisticRegression"].getRegParam() == 0.5
    logged = tr.pipeline_maker(SPEC, lambda p: LogisticRegression(**p))({"take_log": "yes"}).getStages()
    assert any("num_a__log" in s.getOrDefault("inputCols") for s in logged if type(s).__name__ == "NumericFeatures")


def test_scores_of_other_models(spark, rows, tmp_path):
    families = [("linear", {"regParam": ("float", 0.01, 0.1)}, lambda p: LogisticRegression(maxIter=3, **p))]
    uids = runs.train_run(rows, "key", "target", SPEC, str(tmp_path), families=families, trials=1, folds=2, calibration_folds=0)
    scores = spark.read.parquet(f"{tmp_path}/{uids['linear']}/feature_score").collect()
    assert {r["importance_metric"] for r in scores} <= {"embedded"} and all(abs(r["importance_score"]) <= 1 for r in scores)


def test_own_scorers_join_the_table(spark):
    p = ev.predictions_frame(views.v_pred(spark, SF))
    mine = {"mean_error": lambda y, prob, cls: F.avg(F.abs(F.col(y) - F.col(prob)))}
    got = {r["scoring_metric"]: r["holdout_score"] for r in ev.metric_table(p, "m", scorers=mine).collect()}
    assert set(got) == {*ev.METRIC_NAMES, "mean_error"}
    assert got["mean_error"] == pytest.approx(p.agg(F.avg(F.abs(F.col("label") - F.col("prob")))).first()[0])
