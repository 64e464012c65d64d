"""Correlations of dummies and numbers against pandas, and with many levels."""

import random

import pandas as pd
import pytest

from attrix.operators import explore as ex


def data(n):
    rng = random.Random(1)
    return [(rng.choice(["x", "y", None]), rng.choice("pqr"), "same", rng.gauss(0, 1), None if rng.random() < 0.2 else rng.random(), 3.0) for _ in range(n)]


COLS = ["a", "b", "c", "u", "v", "w"]


def test_pairs_match_pandas(spark):
    rows = data(400)
    df = spark.createDataFrame(rows, "a string, b string, c string, u double, v double, w double")
    got = {(r["feature1"], r["feature2"]): r["correlation"] for r in ex.correlated_features(df, ["a", "b", "c"], ["u", "v", "w"]).collect()}
    frame = pd.DataFrame(rows, columns=COLS)
    wide = pd.concat([pd.get_dummies(frame[["a"]], dummy_na=True), pd.get_dummies(frame[["b", "c"]]), frame[["u", "v", "w"]]], axis=1).astype(float)
    corr = wide.corr().abs()
    names = sorted(wide.columns)
    assert set(got) == {(f, g) for i, f in enumerate(names) for g in names[i + 1 :]}
    for (f, g), r in got.items():
        want = corr.loc[f, g]
        assert r is None if pd.isna(want) else r == pytest.approx(want, abs=1e-9)


def test_one_column_and_numbers_alone(spark):
    df = spark.createDataFrame(data(100), "a string, b string, c string, u double, v double, w double")
    assert {(r["feature1"], r["feature2"]) for r in ex.correlated_features(df, ["b"], []).collect()} == {("b_p", "b_q"), ("b_p", "b_r"), ("b_q", "b_r")}
    assert ex.correlated_features(df, [], ["u", "v"]).count() == 1


def test_five_thousand_levels(spark):
    df = spark.range(20_000).selectExpr("concat('l', id % 2500) AS a", "concat('m', (id * 7) % 2500) AS b", "CAST(id % 13 AS DOUBLE) AS u")
    out = ex.correlated_features(df, ["a", "b"], ["u"])
    levels = 5000
    assert out.count() == levels * (levels - 1) // 2 + levels
    same = out.where("feature1 = 'a_l0' AND feature2 IN ('b_m0', 'b_m7')").collect()
    by = {r["feature2"]: r["correlation"] for r in same}
    assert by["b_m0"] == pytest.approx(1.0) and by["b_m7"] < 0.01
