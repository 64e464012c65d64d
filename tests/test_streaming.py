"""Structured Streaming forms equal their batch forms (availableNow runs)."""

import os

from pyspark.sql import functions as F

from attrix.operators.serve import linear_scorer, score_requests
from attrix.plans import views
from attrix.streaming.reports import start_report_stream, windowed_report
from attrix.streaming.scoring import start_scoring_stream

SF = "/root/testdata/sf0.001"


def test_windowed_report_stream_equals_batch(spark, tmp_dir):
    logs = views.v_logs(spark, SF)
    src = os.path.join(tmp_dir, "logs")
    logs.write.parquet(src)
    stream = spark.readStream.schema(logs.schema).parquet(src)
    q = start_report_stream(stream, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), watermark="0 seconds")
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(tmp_dir, "out"))
    want = windowed_report(logs)
    # append mode emits windows closed by the watermark: every emitted window equals the batch window
    g = {(r["window_start"], r["prediction_count"]) for r in got.collect()}
    w = {(r["window_start"], r["prediction_count"]) for r in want.collect()}
    assert g and g <= w and len(w) - len(g) <= 1


def test_scoring_stream_equals_batch(spark, tmp_dir):
    o = views.v_obs(spark, SF)
    req = o.select(F.col("key").cast("string").alias("uid"), F.to_json(F.struct("client_id", "num_a", "num_b")).alias("payload"))
    src = os.path.join(tmp_dir, "req")
    req.write.parquet(src)
    ltv = views.v_ltv(spark, SF)
    schema = "client_id long, num_a double, num_b double"
    scorer = linear_scorer({"num_a": 4e-6, "num_b": 1e-4}, -1.0)
    stream = spark.readStream.schema(req.schema).parquet(src)
    q = start_scoring_stream(stream, "payload", schema, scorer, ltv, ["client_id", "num_a", "num_b"],
                             os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(tmp_dir, "out"))
    pred = got.select("uid", F.get_json_object("input_output_payloads", "$.output.prediction").cast("double").alias("p"))
    want = score_requests(req, "payload", schema, scorer, ltv=ltv).select("uid", F.col("prediction").alias("p"))
    assert sorted(pred.collect()) == sorted(want.collect())


def test_streaming_drift_counts_against_baseline(spark, tmp_dir):
    from attrix.streaming.drift import start_drift_stream

    v = views.v_drift(spark, SF)
    prod = v.where("side = 'prod'").join(
        spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("key"), "ts"), "key"
    )
    src = os.path.join(tmp_dir, "prod")
    prod.write.parquet(src)
    base_long = v.where("side = 'train'").select("event_type", "user_group").unpivot([], ["event_type", "user_group"], "feature", "level")
    baseline = base_long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    stream = spark.readStream.schema(prod.schema).parquet(src)
    q = start_drift_stream(stream, baseline, ["event_type", "user_group"], "ts", os.path.join(tmp_dir, "out"),
                           os.path.join(tmp_dir, "ck"), window="7 days")
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    rows = out.collect()
    assert rows and all(0.0 <= r["p_value"] <= 1.0 for r in rows)
    assert {r["feature"] for r in rows} <= {"event_type", "user_group"}


def test_config_refresh_per_batch(spark, tmp_dir):
    from attrix.streaming.refresh import current_cutoff, start_refreshing_stream

    cfg_path = os.path.join(tmp_dir, "cfg")
    spark.createDataFrame(
        [("proba_cutoff", "0.6", "2024-01-01 00:00:00"), ("proba_cutoff", "0.9", "2024-01-02 00:00:00")],
        "config_key string, config_value string, meta__inserted_at string",
    ).selectExpr("config_key", "config_value", "CAST(meta__inserted_at AS TIMESTAMP_NTZ) AS meta__inserted_at").write.parquet(cfg_path)
    assert current_cutoff(spark.read.parquet(cfg_path)) == 0.9
    p = views.v_pred(spark, SF)
    src = os.path.join(tmp_dir, "pred")
    p.write.parquet(src)
    stream = spark.readStream.schema(p.schema).parquet(src)

    def process(batch, cutoff):
        return batch.withColumn("high_risk", F.when(F.col("prob") >= cutoff, "yes").otherwise("no"))

    q = start_refreshing_stream(spark, stream, lambda: spark.read.parquet(cfg_path), process,
                                os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    assert out.count() == p.count()
    assert out.where("high_risk = 'yes'").count() == p.where("prob >= 0.9").count()


def test_saved_pipeline_scores_a_stream_like_a_batch(spark, tmp_dir):
    """A fitted pipeline is the scorer; bad rows take the error branch in both."""
    from pyspark.ml import PipelineModel

    from attrix.operators import train as tr
    from attrix.operators.serve import ERROR_TEXT
    from attrix.sinks.writers import save_pipeline

    o = views.v_obs(spark, SF).withColumn("label", F.when(F.col("target") == "yes", 1).otherwise(0))
    types = {"num_a": "double", "num_b": "double", "cat_b": "string"}
    pipe = tr.build_pipeline(tr.model_family("extra_trees", {"numTrees": 4, "maxDepth": 3}), numeric=["num_a", "num_b"], categorical=["cat_b"],
                             num_percentile=100, cat_percentile=100, conform=types)
    path = os.path.join(tmp_dir, "model")
    save_pipeline(pipe.fit(o), path)
    model = PipelineModel.load(path)
    good = o.select(F.col("key").cast("string").alias("uid"), F.to_json(F.struct("client_id", *types)).alias("payload"))
    bad = spark.createDataFrame([("x1", "{broken"), ("x2", '{"client_id": 3, "num_a": "many"}'), ("x3", '{"client_id": 3}'), ("x4", None)], good.schema)
    src = os.path.join(tmp_dir, "req")
    good.unionByName(bad).write.parquet(src)
    ltv, schema = views.v_ltv(spark, SF), "client_id long, num_a double, num_b double, cat_b string"
    batch = score_requests(spark.read.parquet(src), "payload", schema, model, ltv=ltv)
    want = {r["uid"]: (r["prediction"], r["high_risk"], r["error"]) for r in batch.collect()}
    assert len(want) == good.count() + 4
    assert all(want[k] == (0.0, None, ERROR_TEXT) for k in ("x1", "x2", "x4")) and want["x3"][2] is None and 0 < want["x3"][0] < 1
    direct = model.transform(o.withColumn("uid", F.lit(""))).select("key", "probability").collect()
    assert all(want[str(r["key"])][0] == round(r["probability"][1], 2) for r in direct)
    stream = spark.readStream.schema(good.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_scoring_stream(stream, "payload", schema, model, ltv, ["client_id", *types], os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    out = "$.output."
    got = spark.read.parquet(os.path.join(tmp_dir, "out")).select(
        "uid", F.get_json_object("input_output_payloads", f"{out}prediction").cast("double").alias("p"),
        F.get_json_object("input_output_payloads", f"{out}high_risk").alias("h"), F.get_json_object("input_output_payloads", f"{out}error").alias("e"))
    assert {r["uid"]: (r["p"], r["h"], r["e"]) for r in got.collect()} == want
