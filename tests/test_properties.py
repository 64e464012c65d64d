"""Invariants of the operators (survey section 5, 'properties')."""

import pytest
from pyspark.sql import functions as F

from attrix.operators import drift as dr
from attrix.operators import evaluate as ev
from attrix.operators import explain as xp
from attrix.operators.serve import linear_scorer
from attrix.operators.windows import head_hash_ordered
from attrix.plans import views

SF = "/root/testdata/sf0.001"
COEFS = {"num_a": 4e-6, "num_b": 1e-4, "num_c": 1e-2}


def _x(spark):
    from attrix.operators.encoders import impute_mean

    o = views.v_obs(spark, SF).select("key", F.when(F.col("target") == "yes", 1).otherwise(0).alias("label"), *COEFS)
    return impute_mean(o, list(COEFS))


def test_partition_observations_reaggregate(spark):
    p = views.v_pred(spark, SF).withColumn("predicted_class", F.when(F.col("prob") >= 0.5, 1).otherwise(0))
    o = views.v_obs(spark, SF)
    full = ev.metrics_by_partition(p, o, numeric=["num_a"], metrics=["log_loss"]).collect()
    # every row falls in exactly one bin (or 'nan'), and here all bins have both classes
    assert sum(r["observations"] for r in full) == p.count()
    assert all(r["partition"].startswith("num_a_") for r in full)


def test_linear_shapley_additivity(spark):
    x = _x(spark)
    sh = xp.linear_shapley(x, "key", COEFS, -1.0)
    tot = sh.groupBy("key").agg(F.sum("shap").alias("s"), F.first("expected_value").alias("ev"))
    j = tot.join(x, "key").withColumn("margin", -1.0 + 4e-6 * F.col("num_a") + 1e-4 * F.col("num_b") + 1e-2 * F.col("num_c"))
    bad = j.where(F.abs(F.col("s") + F.col("ev") - F.col("margin")) > 1e-9).count()
    assert bad == 0


def test_sampled_shapley_additivity(spark):
    x = _x(spark).limit(50)
    z = head_hash_ordered(_x(spark), "key", 1)  # one background row: the values add up to f(x) - f(z)
    score = xp.expr_scorer(lambda: linear_scorer(COEFS, -1.0))
    sh = xp.sampled_shapley(x, "key", list(COEFS), score, z, permutations=4)
    base = score(z).first()["_score"]
    want = {r["key"]: r["_score"] - base for r in score(x).collect()}
    got = {r["key"]: r["s"] for r in sh.groupBy("key").agg(F.sum("shap").alias("s"), F.count("shap").alias("n")).where("n = 3").collect()}
    assert len(got) == 50 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_drift_of_a_table_against_itself_is_zero(spark):
    v = views.v_drift(spark, SF)
    chi = dr.chi_square_shift(v, v, ["event_type", "user_group"]).collect()
    assert all(r["chi2"] == 0.0 and r["p_value"] == 1.0 for r in chi)
    ks = dr.ks_shift(v, v, ["value"]).first()
    assert ks["ks_statistic"] == 0.0 and ks["p_value"] == 1.0


def test_unseen_level_gives_zero_p(spark):
    t = spark.createDataFrame([("a",)] * 10 + [("b",)] * 10, "f string")
    p = spark.createDataFrame([("a",)] * 10 + [("c",)] * 10, "f string")
    r = dr.chi_square_shift(t, p, ["f"]).first()
    assert r["p_value"] == 0.0


def test_bootstrap_is_repeatable(spark):
    p = views.v_pred(spark, SF).withColumn("predicted_class", F.when(F.col("prob") >= 0.5, 1).otherwise(0))
    a = sorted(tuple(r) for r in ev.bootstrap_scores(p, samples=5, metrics=["roc_auc"]).collect())
    b = sorted(tuple(r) for r in ev.bootstrap_scores(p, samples=5, metrics=["roc_auc"]).collect())
    assert a == b and a[0][1] == 5


def test_split_is_about_twenty_percent(spark):
    from attrix.operators.windows import train_test_split

    s = train_test_split(views.v_obs(spark, SF), "key", 0.2)
    frac = s.where("split = 'test'").count() / s.count()
    assert 0.1 < frac < 0.3


def _preds(spark):
    return views.v_pred(spark, SF).withColumn("predicted_class", F.when(F.col("prob") >= 0.5, 1).otherwise(0))


def test_roc_curve_endpoints(spark):
    pts = ev.roc_points(_preds(spark)).orderBy(F.desc("threshold")).collect()
    assert (pts[0]["fpr"], pts[0]["tpr"]) == (0.0, 0.0)
    assert (pts[-1]["fpr"], pts[-1]["tpr"]) == (1.0, 1.0)
    assert all(a["tpr"] <= b["tpr"] and a["fpr"] <= b["fpr"] for a, b in zip(pts, pts[1:]))


def test_gains_reach_one_and_calibration_counts(spark):
    p = _preds(spark)
    g = ev.gains_points(p)
    for cls in (0, 1):
        last = g.where(F.col("class") == cls).orderBy("percentage", ascending=False).first()
        assert last["percentage"] == pytest.approx(1.0) and last["gain"] == pytest.approx(1.0)
    n = p.count()
    for strategy in ("uniform", "quantile"):
        c = ev.calibration_table(p, n_bins=10, strategy=strategy)
        assert c.agg(F.sum("count")).first()[0] == n


def test_ks_cdfs_end_at_one(spark):
    c = ev.ks_curve_points(_preds(spark)).orderBy(F.desc("threshold")).first()
    assert c["cdf_pos"] == pytest.approx(1.0) and c["cdf_neg"] == pytest.approx(1.0)
