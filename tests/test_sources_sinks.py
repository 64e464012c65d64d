"""Sources and sinks: round trips through files."""

import os

from pyspark.sql import functions as F

from attrix.plans import views
from attrix.sinks.writers import export_csv, save_pipeline
from attrix.sources.observations import read_csv_observations, read_observations
from attrix.sources.tables import save_dataset_snapshot, training_snapshot

SF = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_dir):
    o = views.v_obs(spark, SF)
    p = os.path.join(tmp_dir, "obs_csv")
    export_csv(o, p)
    back = read_csv_observations(spark, p, schema=o.schema)
    assert back.count() == o.count()
    assert back.where(F.col("cat_a").isNull()).count() == o.where(F.col("cat_a").isNull()).count()


def test_read_observations_normalises_nan(spark, tmp_dir):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "nan"), (None, "None")], "a double, b string")
    p = os.path.join(tmp_dir, "nan")
    df.write.parquet(p)
    r = read_observations(spark, p, ["a", "b"])
    assert r.where("a IS NULL").count() == 2 and r.where("b IS NULL").count() == 2


def test_snapshot_write_and_read_back(spark, tmp_dir):
    o = views.v_obs(spark, SF).select("key", "num_a", "cat_b")
    p = os.path.join(tmp_dir, "snap")
    save_dataset_snapshot(o, p, "m1", "train")
    save_dataset_snapshot(o.limit(10), p, "m2", "train")
    back = training_snapshot(spark, p, "m1", ["key", "num_a", "cat_b"])
    assert back.count() == o.count()


def test_pipeline_save_and_load(spark, tmp_dir):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from attrix.operators.encoders import CombineSparseLevels

    df = spark.createDataFrame([("a",)] + [("b",)] * 9, "c string")
    pipe = Pipeline(stages=[SQLTransformer(statement="SELECT * FROM __THIS__"), CombineSparseLevels(inputCols=["c"], cutoff=0.1)])
    m = pipe.fit(df)
    p = os.path.join(tmp_dir, "pipe")
    save_pipeline(m, p)
    again = PipelineModel.load(p)
    assert sorted(r[0] for r in again.transform(df).distinct().collect()) == ["b", "sparse_combined"]


def test_create_table_from_reads_back(spark, tmp_dir):
    from attrix.sinks.writers import create_table_from

    o = views.v_obs(spark, SF).select("key", "target", "num_a")
    t = create_table_from(o, "attrix_obs_snapshot", path=os.path.join(tmp_dir, "tbl"))
    assert t.count() == o.count() and t.columns == o.columns
    spark.sql("DROP TABLE IF EXISTS attrix_obs_snapshot")


def test_production_requests_by_key_name_with_commas(spark):
    import json

    from attrix.sources.logs import production_requests

    rows = [
        ("u1", "2024-01-20 10:00:00", json.dumps({"input": {"note": "a, b", "score": " 1.5", "uid": "x"}, "output": {"model_uid": "m1"}})),
        ("u2", "2024-01-20 11:00:00", json.dumps({"input": {"note": "c", "score": "2"}, "output": {"model_uid": "m1"}})),
        ("u3", "2024-01-21 11:00:00", json.dumps({"input": {"note": "d", "score": "3"}, "output": {"model_uid": "m2"}})),
    ]
    logs = spark.createDataFrame(rows, "uid string, ts string, input_output_payloads string").selectExpr(
        "uid", "CAST(ts AS TIMESTAMP_NTZ) AS logging_timestamp", "input_output_payloads"
    )
    out = production_requests(logs, "m1", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    assert out.columns == ["note", "score"]  # 'uid' dropped, keys by name
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("a, b", 1.5), ("c", 2.0)]
