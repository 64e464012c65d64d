"""The reference's own unit cases, re-expressed on Spark DataFrames."""

import json
import math

from pyspark.sql import functions as F

from attrix.functions.columns import run_id
from attrix.operators import encoders as en
from attrix.operators import projections as pj
from attrix.operators.serve import linear_scorer, score_requests
from attrix.sources.logs import parse_requests


def num_df(spark):
    return spark.createDataFrame([(10, 1), (15, 0), (15, 1), (20, 0)], "col_a int, dummied_col int")


def test_clip_upper_then_lower(spark):
    df = pj.clip_bounds(num_df(spark), "col_a", 17, 17, "upper")
    assert df.agg(F.max("col_a")).first()[0] == 17
    df = pj.clip_bounds(df, "col_a", 12, 12, "lower")
    assert df.agg(F.min("col_a")).first()[0] == 12


def test_clip_bad_type_raises(spark):
    import pytest

    with pytest.raises(ValueError):
        pj.clip_bounds(num_df(spark), "col_a", 1, 1, "sideways")


def test_non_dummy_columns(spark):
    rows = en.non_dummy_columns(num_df(spark), ["col_a", "dummied_col"]).collect()
    assert [r["column"] for r in rows if not r["is_dummy"]] == ["col_a"]


def test_run_id_longer_than_base(spark):
    v = spark.range(1).select(run_id("random_forest", F.current_timestamp()).alias("u")).first()["u"]
    assert v.startswith("random_forest_") and len(v) > len("random_forest")


def test_combine_sparse_levels_inclusive_cutoff(spark):
    df = spark.createDataFrame([("a",)] + [("b",)] * 9, "col_a string")
    sparse = en.sparse_levels(df, ["col_a"], 0.10)
    out = en.combine_sparse_levels(df, sparse, ["col_a"])
    assert {r[0] for r in out.distinct().collect()} == {"b", "sparse_combined"}


def test_combine_sparse_levels_estimator_unseen_pass_through(spark):
    df = spark.createDataFrame([("a",)] + [("b",)] * 9, "col_a string")
    m = en.CombineSparseLevels(inputCols=["col_a"], cutoff=0.10).fit(df)
    new = spark.createDataFrame([("a",), ("b",), ("z",)], "col_a string")
    assert [r[0] for r in m.transform(new).collect()] == ["sparse_combined", "b", "z"]


def test_take_log(spark):
    df = pj.take_log(num_df(spark), ["col_a"])
    assert round(df.first()["col_a"], 3) == 2.303


def test_take_log_zero_and_negative(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (math.e,)], "x double")
    assert [r[0] for r in pj.take_log(df, ["x"]).collect()] == [0.0, None, 1.0]


def test_simple_json_has_key_and_scoring_still_answers(spark):
    df = spark.createDataFrame([(json.dumps({"key": "value"}),)], "payload string")
    parsed = parse_requests(df, "payload", "key string")
    assert "key" in parsed.columns
    req = df.withColumn("uid", F.lit("u1"))
    out = score_requests(req, "payload", "activity_score double", linear_scorer({"activity_score": 1.0}))
    assert "prediction" in out.columns and out.count() == 1


def test_payload_scores_between_zero_and_one_with_ltv(spark):
    payload = {"client_id": "77", "activity_score": 0.25, "xp_points": 9.5, "propensity_score": 0.6, "note": "not in the schema"}
    req = spark.createDataFrame([("u1", json.dumps(payload))], "uid string, payload string")
    ltv = spark.createDataFrame([("77", 100.0)], "client_id string, ltv double")
    schema = "client_id string, activity_score double, propensity_score double, xp_points double"
    out = score_requests(req, "payload", schema, linear_scorer({"activity_score": 1.0, "xp_points": -0.05}), ltv=ltv).first()
    assert 0 < out["prediction"] < 1
    assert out["ltv"] == 100.0 and out["error"] is None


def test_client_ids_are_distinct_and_lookups_repeat(spark):
    from attrix.operators.serve import ltv_lookup, score_clients

    req = spark.createDataFrame([("r", "1, 1, 2 ,9")], "uid string, ids string")
    scores = spark.createDataFrame([("1", 0.5), ("2", 0.25)], "id string, p double")
    got = score_clients(req, "ids", scores, "id", "p", keep=("uid",)).collect()
    assert sorted((r["client_id"], r["prediction"]) for r in got) == [("1", "0.5"), ("2", "0.25"), ("9", "client_id_not_found")]
    dim = spark.createDataFrame([("1", 5.0, 1), ("1", 3.0, 2), ("000000", 8.0, 1)], "client_id string, ltv double, at int")
    who = spark.createDataFrame([("1",), (None,), ("x",)], "client_id string")
    assert sorted(r["ltv"] for r in ltv_lookup(who, dim, order="at").collect()) == [0.0, 3.0, 8.0]
    assert sorted(r["ltv"] for r in ltv_lookup(who, dim).collect()) == [0.0, 5.0, 8.0]


def test_repeated_config_key_takes_the_latest(spark):
    from attrix.sources.tables import snapshot_map

    rows = [("a", "old", 1), ("a", "new", 2), ("b", "only", 1)]
    conf = spark.createDataFrame(rows, "config_key string, config_value string, meta__inserted_at int")
    assert snapshot_map(conf).first()["config"] == {"a": "new", "b": "only"}


def test_constant_column_has_no_density(spark):
    from attrix.operators.evaluate import density_points

    rows = density_points(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", grid=5).collect()
    assert rows and all(r["density"] is None for r in rows)


def test_feature_of_one_class_has_no_f_score(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 2.0), (1, None, 3.0), (1, None, 5.0)], "y int, a double, b double")
    got = {r["feature"]: r["score"] for r in en.f_classif_scores(df, "y", ["a", "b"], 100).collect()}
    assert got["a"] is None and got["b"] > 0


def test_summary_keeps_a_level_that_is_called_total(spark):
    from attrix.operators.aggregates import summary_statistics

    df = spark.createDataFrame([("total", 1.0), ("total", 3.0), ("no", 5.0), (None, 7.0)], "y string, x double")
    got = sorted((r["level"], r["count"], r["p50"]) for r in summary_statistics(df, "y", ["x"], []).collect())
    assert got == [("no", 1, 5.0), ("total", 2, 2.0), ("total", 4, 4.0)]


def test_permutation_importance_of_a_string_key(spark):
    from attrix.operators import kernels as k

    df = spark.createDataFrame([(f"c-{i}",) for i in (3, 1, 2)], "key string")
    assert {r["key"]: r["rn"] for r in k.row_numbers(df, ["key"]).collect()} == {"c-1": 1, "c-2": 2, "c-3": 3}
