"""Feature matrix stages against brute force, saved and loaded."""

import math
import os
from collections import Counter

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from attrix.operators import stages as sg
from attrix.operators.encoders import select_percentile
from attrix.sinks.writers import save_pipeline


def percentile_rule(scores, percentile):
    """{name: selected} of scikit-learn's SelectPercentile, ties by name."""
    ranked, n = sorted(scores.values()), len(scores)
    h = (n - 1) * (1 - percentile / 100)
    lo = math.floor(h)
    cut = ranked[lo] + (h - lo) * (ranked[min(lo + 1, n - 1)] - ranked[lo])
    chosen = {k: v > cut for k, v in scores.items()}
    room = int(n * percentile / 100) - sum(chosen.values())
    for k in sorted(k for k, v in scores.items() if v == cut)[: max(room, 0)]:
        chosen[k] = True
    return chosen


@pytest.mark.parametrize("percentile", [10, 33, 50, 75, 90])
def test_percentile_rule_with_ties(spark, percentile):
    scores = {f"f{i:02d}": float([3, 1, 1, 1, 2, 5, 1, 2, 2, 9, 1, 1, 4][i]) for i in range(13)}
    df = spark.createDataFrame(list(scores.items()), "feature string, score double")
    got = {r["feature"]: r["selected"] for r in select_percentile(df, percentile, "feature").collect()}
    assert got == percentile_rule(scores, percentile)
    assert sg.chosen_features(scores, percentile) == {f for f, on in got.items() if on}


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(240):
        y = int(i % 3 == 0)
        data.append((i, y, None if i % 7 == 0 else float(i % 10 + 5 * y), float(i % 4), 2.0, None, "ab"[i % 2], None if i % 11 == 0 else f"l{i % 5 + 5 * y}", "same", float("nan") if i % 9 == 0 else float(i)))
    return spark.createDataFrame(data, "key long, label int, u double, v double, w double, n double, a string, b string, c string, z double")


def columns(rows):
    got = rows.collect()
    return {c: [r[c] for r in got] for c in rows.columns}


def test_numeric_features_match_brute_force(rows):
    cols = ["z", "u", "v", "w", "n"]
    model = sg.NumericFeatures(inputCols=cols, percentile=50.0).fit(rows)
    data, want, scores = columns(rows), {}, {}
    for c in cols:
        known = [x for x in data[c] if x is not None and x == x]
        if not known:
            continue  # a column without a value has no slot
        mean = sum(known) / len(known)
        x = [mean if v is None or v != v else v for v in data[c]]
        sigma = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        by = {y: [v for v, k in zip(x, data["label"]) if k == y] for y in (0, 1)}
        ssb = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in by.values())
        ssw = sum(sum((q - sum(v) / len(v)) ** 2 for q in v) for v in by.values())
        want[c] = (mean, sigma, [(v - mean) / sigma if sigma else 0.0 for v in x])
        scores[c] = ssb / (ssw / (len(x) - 2)) if ssw else None
    got = {r["feature"]: r for r in model.table.collect()}
    assert set(got) == set(want)
    for c, (mean, sigma, _) in want.items():
        assert got[c]["mean"] == pytest.approx(mean) and got[c]["sigma"] == pytest.approx(sigma, abs=1e-12)
        assert scores[c] is None or got[c]["score"] == pytest.approx(scores[c], rel=1e-9)
    chosen = percentile_rule({c: -1.7976931348623157e308 if s is None else s for c, s in scores.items()}, 50)
    kept = sorted(c for c, on in chosen.items() if on and want[c][1] > 0)
    assert [r["feature"] for r in model.kept()] == kept and kept
    out = {r["key"]: r["v"] for r in model.transform(rows).select("key", vector_to_array(sg.NUMERIC).alias("v")).collect()}
    for i, k in enumerate(data["key"]):
        assert out[k] == pytest.approx([want[c][2][i] for c in kept])


def test_categorical_features_match_brute_force(rows):
    filled = rows.fillna("missing", ["b"])
    model = sg.CategoricalFeatures(inputCols=["b", "a", "c"], percentile=60.0).fit(filled)
    data = columns(filled)
    share = {y: n / 240 for y, n in Counter(data["label"]).items()}
    scores, counts = {}, {}
    for c in ("a", "b", "c"):
        for level in set(data[c]):
            has = [k for v, k in zip(data[c], data["label"]) if v == level]
            counts[f"{c}={level}"] = len(has)
            scores[f"{c}={level}"] = sum((has.count(y) - share[y] * len(has)) ** 2 / (share[y] * len(has)) for y in share)
    got = {r["feature"]: r for r in model.table.collect()}
    assert {f: (r["n"], pytest.approx(r["score"], abs=1e-9)) for f, r in got.items()} == {f: (counts[f], scores[f]) for f in scores}
    kept = sorted(f for f, r in got.items() if r["kept"])
    assert "c=same" not in kept and all(got[f]["selected"] for f in kept)
    out = {r["key"]: r["v"] for r in model.transform(filled).select("key", vector_to_array(sg.CATEGORICAL).alias("v")).collect()}
    for i, k in enumerate(data["key"]):
        assert out[k] == [float(data[f[0]][i] == f[2:]) for f in kept]


def test_unseen_levels_and_null_columns_are_zero(spark, rows):
    model = Pipeline(stages=sg.feature_stages(["u", "v"], ["a", "b"], num_percentile=100, cat_percentile=100)).fit(rows)
    new = spark.createDataFrame([(1, None, None, "never", None)], "key long, u double, v double, a string, b string")
    (r,) = sg.feature_rows(model.transform(new), sg.feature_lineage(model)).collect()
    assert (r["feature"], r["value"]) == ("b=missing", 1.0)


def test_conform_drops_adds_and_casts(spark):
    stage = sg.ConformSchema(mapping='{"x": "double", "gone": "string"}', keep=["key", "label"])
    out = stage.transform(spark.createDataFrame([(1, "2.5", "bad"), (2, "no", "")], "key long, x string, other string"))
    assert out.columns == ["key", "x", "gone"] and [tuple(r) for r in out.collect()] == [(1, 2.5, None), (2, None, None)]


def test_pipeline_is_saved_as_tables_and_answers_the_same(spark, rows, tmp_dir):
    spec = {"numeric": ["u", "v", "z"], "categorical": ["a", "b", "c"], "conform": {"u": "double", "v": "double", "z": "double", "a": "string", "b": "string", "c": "string"}}
    model = Pipeline(stages=sg.feature_stages(**spec, num_percentile=70, cat_percentile=50, combine_cutoff=0.1)).fit(rows)
    path = os.path.join(tmp_dir, "features")
    save_pipeline(model, path)
    save_pipeline(model, path)  # over the first
    again = PipelineModel.load(path)
    assert any("table" in folders for _, folders, _ in os.walk(path))

    def entries(m):
        return sorted(map(tuple, sg.feature_rows(m.transform(rows), sg.feature_lineage(m)).collect()))

    assert entries(again) == entries(model) and len(entries(model)) > 240
    assert sg.transform_only(again).transform(rows).count() == 240


def test_no_level_is_kept_in_the_plan(rows):
    """The levels are joined: none of them is a literal of the plan."""
    model = sg.CombineSparseLevels(inputCols=["b"], cutoff=0.11).fit(rows)
    plan = model.transform(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "l7" not in plan
    got = {r["b"]: r["count"] for r in model.transform(rows).groupBy("b").count().collect()}
    levels = Counter(v for v in columns(rows)["b"] if v is not None)
    total = sum(levels.values())
    assert got["sparse_combined"] == sum(n for n in levels.values() if n / total <= 0.11)


def test_copy_keeps_the_table(rows):
    model = sg.CombineSparseLevels(inputCols=["b"], cutoff=0.11).fit(rows)
    assert model.copy().transform(rows).where(F.col("b") == "sparse_combined").count() > 0
