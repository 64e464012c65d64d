"""Source, sink, set, window, join and serving queries (survey 2.1, 2.2, 2.6, 2.8, 2.9, 2.15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attrix.functions.columns import day_start_ntz
from attrix.operators import serve as sv
from attrix.operators import train as tr
from attrix.operators import windows as wn
from attrix.operators.kernels import qcut
from attrix.plans import views
from attrix.plans.common import preds, r6
from attrix.plans.registry import query
from attrix.session import ensure_checkpoint_dir
from attrix.sinks.writers import export_csv
from attrix.sources import logs as lg
from attrix.sources import tables as tb
from attrix.sources.observations import normalize_nulls, read_csv_observations

REQ_SCHEMA = "input struct<client_id:string,event_type:string>, output struct<prediction:double,model_uid:string>"
P = "input_output_payloads"


def ts(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def parsed_logs(spark, d):
    return lg.parse_requests(views.v_logs(spark, d), P, REQ_SCHEMA, keep=["uid", "logging_timestamp"]).select(
        "uid",
        "logging_timestamp",
        F.col("input.client_id").alias("client_id"),
        F.col("input.event_type").alias("event_type"),
        F.col("output.prediction").alias("prediction"),
        F.col("output.model_uid").alias("model_uid"),
    )


LOG_FIELDS_SQL = f"""SELECT uid, logging_timestamp,
       json_extract_string({P}, '$.input.client_id') AS client_id,
       json_extract_string({P}, '$.input.event_type') AS event_type,
       CAST(json_extract({P}, '$.output.prediction') AS DOUBLE) AS prediction,
       json_extract_string({P}, '$.output.model_uid') AS model_uid FROM v_logs"""


@query("src1_read_observations", "SELECT * FROM v_obs", ("v_obs",))
def src1(spark, d):
    return normalize_nulls(views.v_obs(spark, d))


@query("src3_parse_requests", LOG_FIELDS_SQL, ("v_logs",))
def src3(spark, d):
    return parsed_logs(spark, d)


@query(
    "src4_latest_snapshot",
    """WITH c AS (SELECT event_type AS config_key, CAST(user_id AS VARCHAR) AS config_value,
                     date_trunc('day', ts) AS meta__inserted_at FROM events)
SELECT * FROM c WHERE meta__inserted_at = (SELECT max(meta__inserted_at) FROM c)""",
)
def src4(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    cfg = e.select(
        F.col("event_type").alias("config_key"),
        F.col("user_id").cast("string").alias("config_value"),
        day_start_ntz("ts").alias("meta__inserted_at"),
    )
    return tb.latest_snapshot(cfg)


@query("src5_read_lookup", "SELECT client_id, ltv FROM v_ltv", ("v_ltv",))
def src5(spark, d):
    return tb.read_lookup(views.v_ltv(spark, d), "client_id", ["ltv"])


@query(
    "src6_model_start_time",
    "SELECT 'm1' AS model_uid, min(ts) AS training_timestamp FROM events WHERE 'm' || CAST(event_id % 2 AS VARCHAR) = 'm1'",
)
def src6(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    meta = e.select(
        F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model_uid"),
        F.col("ts").alias("training_timestamp"),
    )
    return tb.model_start_time(meta, "m1")


@query(
    "src7_production_requests",
    f"""SELECT TRY_CAST(trim(json_extract_string({P}, '$.input.client_id')) AS DOUBLE) AS client_id,
       json_extract_string({P}, '$.input.event_type') AS event_type FROM v_logs
WHERE json_extract_string({P}, '$.output.model_uid') = 'm1' AND logging_timestamp >= TIMESTAMP '2024-01-16 00:00:00'""",
    ("v_logs",),
)
def src7(spark, d):
    return lg.production_requests(views.v_logs(spark, d), "m1", ts("2024-01-16 00:00:00"))


@query(
    "src9_recent_predictions",
    f"SELECT logging_timestamp, CAST(json_extract({P}, '$.output.prediction') AS DOUBLE) AS prediction FROM v_logs "
    "WHERE logging_timestamp >= TIMESTAMP '2024-01-25 00:00:00'",
    ("v_logs",),
)
def src9(spark, d):
    return lg.recent_predictions(views.v_logs(spark, d), ts("2024-01-25 00:00:00"))


@query("snk2_log_requests_roundtrip", LOG_FIELDS_SQL, ("v_logs",))
def snk2(spark, d):
    packed = lg.pack_requests(
        parsed_logs(spark, d), "uid", "logging_timestamp", ["client_id", "event_type"], ["prediction", "model_uid"]
    )
    back = lg.parse_requests(packed, P, REQ_SCHEMA, keep=["uid", "logging_timestamp"])
    return back.select(
        "uid",
        "logging_timestamp",
        F.col("input.client_id").alias("client_id"),
        F.col("input.event_type").alias("event_type"),
        F.col("output.prediction").alias("prediction"),
        F.col("output.model_uid").alias("model_uid"),
    )


@query(
    "set1_union_distinct",
    f"""SELECT uid, logging_timestamp FROM v_logs
WHERE json_extract_string({P}, '$.output.model_uid') = 'm1' AND json_extract_string({P}, '$.input.event_type') = 'click'
UNION SELECT uid, logging_timestamp FROM v_logs
WHERE json_extract_string({P}, '$.output.model_uid') = 'm1' AND logging_timestamp >= TIMESTAMP '2024-01-20 00:00:00'""",
    ("v_logs",),
)
def set1(spark, d):
    pl = parsed_logs(spark, d).where(F.col("model_uid") == "m1")
    a = pl.where(F.col("event_type") == "click").select("uid", "logging_timestamp")
    b = pl.where(F.col("logging_timestamp") >= ts("2024-01-20 00:00:00")).select("uid", "logging_timestamp")
    return lg.union_distinct(a, b)


@query(
    "set2_union_by_name",
    """SELECT key, event_type, value, 0 AS target FROM v_drift WHERE side = 'train'
UNION ALL BY NAME SELECT key, event_type, value, user_group, 1 AS target FROM v_drift WHERE side = 'prod'""",
    ("v_drift",),
)
def set2(spark, d):
    v = views.v_drift(spark, d)
    a = v.where("side = 'train'").select("key", "event_type", "value", F.lit(1 - 1).alias("target"))
    b = v.where("side = 'prod'").select("key", "event_type", "value", "user_group", F.lit(1).alias("target"))
    return lg.union_by_name(a, b)


DECILES = "[" + ", ".join(repr(i / 10) for i in range(1, 10)) + "]"


@query(
    "win3_qcut",
    f"""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(num_a, {DECILES}))) AS e FROM v_obs)
SELECT key, 1 + len(list_filter(e, lambda v: num_a > v)) AS bin FROM v_obs, e""",
    ("v_obs",),
)
def win3(spark, d):
    return qcut(views.v_obs(spark, d).select("key", "num_a"), "num_a", 10).select("key", "bin")


@query(
    "win4_argmax_row",
    "SELECT cat_c, first(key ORDER BY num_a DESC, key DESC) AS key, max(num_a) AS num_a FROM v_obs GROUP BY cat_c",
    ("v_obs",),
)
def win4(spark, d):
    return wn.argmax_row(views.v_obs(spark, d), ["cat_c"], "num_a", ["key", "num_a"], tie="key")


@query(
    "win6_head_hash_ordered",
    "SELECT key, label, round(prob, 6) AS prob FROM v_pred "
    "ORDER BY ('0x' || substr(md5(CAST(key AS VARCHAR)), 1, 15))::BIGINT, key LIMIT 1000",
    ("v_pred",),
)
def win6(spark, d):
    return r6(wn.head_hash_ordered(views.v_pred(spark, d).select("key", "label", "prob"), "key", 1000))


SAMPLE_BAND = int(0.1 * (1 << 60))


@query(
    "win7_sample_fraction",
    f"SELECT key, label FROM v_pred WHERE ('0x' || substr(md5(CAST(key AS VARCHAR) || '-19'), 1, 15))::BIGINT < {SAMPLE_BAND}",
    ("v_pred",),
)
def win7(spark, d):
    return wn.sample_fraction(views.v_pred(spark, d).select("key", "label"), "key", 0.1, seed=19)


@query(
    "win8_drop_duplicates_first",
    f"""WITH f AS ({LOG_FIELDS_SQL}),
r AS (SELECT client_id, uid, logging_timestamp,
             row_number() OVER (PARTITION BY client_id ORDER BY logging_timestamp, uid) AS rn FROM f)
SELECT client_id, uid, logging_timestamp FROM r WHERE rn = 1""",
    ("v_logs",),
)
def win8(spark, d):
    f = parsed_logs(spark, d).select("client_id", "uid", "logging_timestamp")
    return wn.drop_duplicates_first(f, "client_id", ["logging_timestamp", "uid"])


@query(
    "win9_last_match",
    "SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id",
)
def win9(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return wn.last_match(e, "user_id", "event_type", "ts")


@query(
    "win10_train_test_split",
    "SELECT key, CASE WHEN substr(md5(CAST(key AS VARCHAR)), 1, 4) < '3333' THEN 'test' ELSE 'train' END AS split FROM v_obs",
    ("v_obs",),
)
def win10(spark, d):
    return wn.train_test_split(views.v_obs(spark, d).select("key"), "key", 0.2)


@query(
    "jn1_ltv_lookup",
    f"""WITH f AS ({LOG_FIELDS_SQL})
SELECT uid, f.client_id, coalesce(l.ltv, 0.0) AS ltv FROM f LEFT JOIN v_ltv l ON CAST(l.client_id AS VARCHAR) = f.client_id""",
    ("v_logs", "v_ltv"),
)
def jn1(spark, d):
    req = parsed_logs(spark, d).select("uid", "client_id")
    return sv.ltv_lookup(req, views.v_ltv(spark, d)).select("uid", "client_id", "ltv")


@query(
    "srv2_score_clients",
    """WITH r AS (SELECT CAST(event_id AS VARCHAR) AS uid,
                     CAST(user_id AS VARCHAR) || ', ' || CAST(user_id * 7 + 3 AS VARCHAR) AS ids FROM events),
i AS (SELECT uid, trim(unnest(string_split(ids, ','))) AS client_id FROM r)
SELECT uid, i.client_id, coalesce(CAST(round(p.prob, 2) AS VARCHAR), 'client_id_not_found') AS prediction
FROM i LEFT JOIN v_pred p ON CAST(p.key AS VARCHAR) = i.client_id""",
    ("v_pred",),
)
def srv2(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    req = e.select(
        F.col("event_id").cast("string").alias("uid"),
        F.concat(F.col("user_id").cast("string"), F.lit(", "), (F.col("user_id") * 7 + 3).cast("string")).alias("ids"),
    )
    scores = views.v_pred(spark, d).select("key", F.round("prob", 2).alias("prob"))
    return sv.score_clients(req, "ids", scores, "key", "prob", keep=("uid",))


COEFS = {"num_a": 4e-6, "num_b": 1e-4, "num_c": 1e-2}
INTERCEPT = -1.0


@query(
    "srv1_score_requests",
    """WITH s AS (SELECT CAST(key AS VARCHAR) AS uid, client_id, cat_a,
                     round(1 / (1 + exp(-(((-1.0 + 4e-6 * coalesce(num_a, 0)) + 1e-4 * coalesce(num_b, 0))
                                          + 1e-2 * coalesce(num_c, 0)))), 2) AS p FROM v_obs)
SELECT uid, CASE WHEN cat_a IS NULL THEN NULL ELSE s.client_id END AS client_id,
       CASE WHEN cat_a IS NULL THEN 0.0 ELSE p END AS prediction,
       CASE WHEN cat_a IS NULL THEN NULL WHEN p >= 0.75 THEN 'yes' ELSE 'no' END AS high_risk,
       CASE WHEN cat_a IS NULL THEN 'app was not able to process request' END AS error,
       CASE WHEN cat_a IS NULL THEN coalesce((SELECT max(ltv) FROM v_ltv WHERE CAST(client_id AS VARCHAR) = '000000'), 0.0) ELSE coalesce(l.ltv, 0.0) END AS ltv
FROM s LEFT JOIN v_ltv l ON l.client_id = s.client_id""",
    ("v_obs", "v_ltv"),
)
def srv1(spark, d):
    o = views.v_obs(spark, d)
    body = F.to_json(F.struct("client_id", "num_a", "num_b", "num_c", "cat_b"))
    # rows without a segment arrive as truncated JSON, exercising the error branch
    req = o.select(
        F.col("key").cast("string").alias("uid"),
        F.when(F.col("cat_a").isNull(), F.lit('{"num_a": ')).otherwise(body).alias("payload"),
    )
    out = sv.score_requests(
        req,
        "payload",
        "client_id long, num_a double, num_b double, num_c double, cat_b string",
        sv.linear_scorer(COEFS, INTERCEPT),
        ltv=views.v_ltv(spark, d),
    )
    return out.select("uid", "client_id", "prediction", "high_risk", "error", "ltv")


@query(
    "srv3_prediction_report",
    f"""WITH st AS (SELECT date_trunc('second', TIMESTAMP '2024-01-30 12:00:00') - INTERVAL 1440 MINUTE AS s)
SELECT s AS start_timestamp, count(*) AS prediction_count,
       round(avg(CAST(json_extract({P}, '$.output.prediction') AS DOUBLE)), 6) AS mean_prediction
FROM v_logs, st WHERE logging_timestamp >= s GROUP BY s HAVING count(*) >= 50""",
    ("v_logs",),
)
def srv3(spark, d):
    return r6(sv.prediction_report(views.v_logs(spark, d), ts("2024-01-30 12:00:00"), minutes=1440, min_count=50))


@query(
    "str2_windowed_report_batch",
    f"""SELECT time_bucket(INTERVAL 30 MINUTE, logging_timestamp) AS window_start,
       time_bucket(INTERVAL 30 MINUTE, logging_timestamp) + INTERVAL 30 MINUTE AS window_end,
       count(*) AS prediction_count,
       round(avg(CAST(json_extract({P}, '$.output.prediction') AS DOUBLE)), 6) AS mean_prediction
FROM v_logs GROUP BY 1, 2""",
    ("v_logs",),
)
def str2(spark, d):
    from attrix.streaming.reports import windowed_report

    return r6(windowed_report(views.v_logs(spark, d), "30 minutes"))


__all__ = ["preds"]


TRN1_SQL = """SELECT key, num_a, num_b, num_c, cat_a, cat_b, cat_c, acquired_date,
       CASE WHEN target = 'yes' THEN 1 ELSE 0 END AS label,
       CASE WHEN substr(md5(CAST(key AS VARCHAR)), 1, 4) < '3333' THEN 'test' ELSE 'train' END AS split
FROM v_obs"""


@query("trn1_training_frame", TRN1_SQL, ("v_obs",))
def trn1(spark, d):
    return tr.training_frame(views.v_obs(spark, d), "key", "target", drop=["client_id"])


def _snapshot_path(spark, d):
    """A run's train and test rows, written as the training run does."""
    frame = tr.training_frame(views.v_obs(spark, d), "key", "target", drop=["client_id"]).drop("split")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/attrix-snapshots/{uuid.uuid4().hex}"
    split = wn.train_test_split(frame, "key", 0.2)
    for name in ("train", "test"):
        tb.save_dataset_snapshot(split.where(F.col("split") == name).drop("split"), path, "m1", name)
    return path


@query("snk5_snapshot", f"SELECT *, 'm1' AS model_uid FROM ({TRN1_SQL})", ("v_obs",))
def snk5(spark, d):
    return spark.read.parquet(_snapshot_path(spark, d))


@query("src8_training_snapshot", "SELECT num_a, num_b, cat_b FROM v_obs", ("v_obs",))
def src8(spark, d):
    return tb.training_snapshot(spark, _snapshot_path(spark, d), "m1", ["num_a", "num_b", "cat_b"])


@query("src2_csv_observations", "SELECT key, target, num_a, num_c, cat_a FROM v_obs", ("v_obs",))
def src2(spark, d):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/attrix-csv/{uuid.uuid4().hex}"
    export_csv(views.v_obs(spark, d).select("key", "target", "num_a", "num_c", "cat_a"), path)
    return read_csv_observations(spark, path, "key long, target string, num_a double, num_c double, cat_a string")


@query(
    "src4_snapshot_map",
    """WITH c AS (SELECT event_type AS config_key, arg_max(CAST(user_id AS VARCHAR), (ts, CAST(user_id AS VARCHAR))) AS config_value
                  FROM events GROUP BY event_type)
SELECT config_key, config_value FROM c""",
)
def src4_map(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    cfg = e.select(F.col("event_type").alias("config_key"), F.col("user_id").cast("string").alias("config_value"), F.col("ts").alias("meta__inserted_at"))
    return tb.snapshot_map(cfg).select(F.explode("config").alias("config_key", "config_value"))
