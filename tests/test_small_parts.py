"""Parts without a query of their own: result sinks, schema walks, frame stages, the exploration bundle."""

import math
import os

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from attrix.operators import aggregates as ag
from attrix.operators import explore as ex
from attrix.operators import projections as pj
from attrix.operators import windows as wi
from attrix.operators.encoders import FrameStage
from attrix.plans import views
from attrix.sinks.writers import append_results

SF = "/root/testdata/sf0.001"


def test_results_are_appended(spark, tmp_dir):
    path = os.path.join(tmp_dir, "scores")
    for run in ("a", "b"):
        append_results(spark.createDataFrame([(run, 0.5)], "model_uid string, score double"), path)
    assert sorted(r["model_uid"] for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_columns_by_type(spark):
    df = spark.createDataFrame([], "a int, b string, c double, d date, e decimal(5,2)")
    assert pj.columns_by_type(df, "numeric") == ["a", "c", "e"] and pj.columns_by_type(df, "non_numeric") == ["b", "d"]
    with pytest.raises(ValueError):
        pj.columns_by_type(df, "text")


def test_any_function_is_a_stage(spark):
    add = FrameStage(lambda df, by: df.withColumn("y", F.col("id") + by), by=3)
    out = Pipeline(stages=[add]).fit(spark.range(2)).transform(spark.range(2))
    assert [r["y"] for r in out.orderBy("id").collect()] == [3, 4]


def test_exploration_bundle(spark):
    o = views.v_obs(spark, SF).limit(400)
    found = ex.explore_all(o, "key", "target", ["cat_a", "cat_b"], ["num_a", "num_b"], max_clusters=2)
    assert {"projection", "summary", "correlation", "mutual_information", "predictive_power", "clusters", "rules", "rule_outcomes", "density_num_a"} <= set(found)
    assert found["projection"].count() == 400 and found["mutual_information"].where("attribute = 'num_a'").count() == 1


def test_summary_of_all_rows_from_levels(spark):
    import pandas as pd

    rows = [("a", 1.0, "x"), ("a", 4.0, None), ("b", None, "y"), ("b", 2.5, "x"), (None, 9.0, "y"), ("total", 3.0, "y"), ("c", None, None)]
    df = spark.createDataFrame(rows, "t string, v double, s string")
    got = {(r["level"], r["feature"], r["count"]): r for r in ag.summary_statistics(df, "t", ["v"], ["s"]).collect()}
    want = pd.Series([r[1] for r in rows]).describe()
    r = got["total", "v", 5]
    assert [r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]] == pytest.approx([want[k] for k in ("mean", "std", "min", "25%", "50%", "75%", "max")])
    assert got["total", "v", 1]["mean"] == 3.0 and got["c", "v", 0]["mean"] is None and got["c", "s", 0]["top"] is None
    assert (got["total", "s", 5]["top"], got["total", "s", 5]["freq"], got["total", "s", 5]["unique"]) == ("y", 3, 2)


def test_information_of_indicators_with_many_classes(spark):
    """More classes than a literal grid may have: the sum over absent ones is in closed form."""
    rows = [(i, f"y{i % 12_000}", "p" if i % 3 else "q") for i in range(24_000)]
    df = spark.createDataFrame(rows, "key long, target string, c string")
    got = {r["attribute"]: r["score"] for r in ex.mutual_information(df, "target", ["c"], []).collect()}
    joint, n = {}, len(rows)
    for _, y, c in rows:
        joint[y, c] = joint.get((y, c), 0) + 1
    side = {c: sum(v for (_, d), v in joint.items() if d == c) for c in "pq"}
    want = sum(k / n * math.log(k * n / (2 * side[c])) for (_, c), k in joint.items())
    assert got == {"c_p": pytest.approx(want), "c_q": pytest.approx(want)}


def test_first_rows_by_hash_in_a_band_or_all(spark):
    from attrix.operators.kernels import hash_order

    df = spark.range(5000).withColumnRenamed("id", "key")
    want = [r["key"] for r in df.orderBy(hash_order(F.col("key")), "key").limit(40).collect()]
    assert [r["key"] for r in wi.head_hash_ordered(df, "key", 40).collect()] == want
    one = spark.range(3000).select(F.lit(7).alias("key"))
    assert wi.head_hash_ordered(one, "key", 20).count() == 20
    assert wi.head_hash_ordered(df.limit(5), "key", 20).count() == 5


def test_rules_of_wide_itemsets(spark):
    rows = [(k, f"i{j}") for k in range(4) for j in range(9)] + [(9, "z")]
    out = ex.association_rules(spark.createDataFrame(rows, "key long, item string"), min_support=0.5, min_lift=0.0)
    n = sum(math.comb(9, k) * (2**k - 2) for k in range(2, 10))
    assert out.count() == n and out.where("size(array_intersect(antecedents, consequents)) > 0 OR size(antecedents) = 0 OR size(consequents) = 0").count() == 0

