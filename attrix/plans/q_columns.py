"""Projection, filter, schema and scalar-function queries (survey 2.3, 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrix.functions import columns as fc
from attrix.operators import projections as pj
from attrix.plans import views
from attrix.plans.common import preds, r6
from attrix.plans.registry import query


def obs(spark, d):
    return views.v_obs(spark, d)


@query(
    "prj1_conform_schema",
    "SELECT num_a, num_c, cat_b, cat_a, NULL::DOUBLE AS extra_score, acquired_date FROM v_obs",
    ("v_obs",),
)
def prj1(spark, d):
    mapping = {
        "num_a": "double",
        "num_c": "double",
        "cat_b": "string",
        "cat_a": "string",
        "extra_score": "double",
        "acquired_date": "string",
    }
    return pj.conform_schema(obs(spark, d), mapping)


@query(
    "prj2_drop_columns",
    "SELECT key, target, num_a, num_b, num_c, cat_a, cat_b, cat_c FROM v_obs",
    ("v_obs",),
)
def prj2(spark, d):
    return pj.drop_columns(obs(spark, d), ["client_id", "acquired_date"])


@query(
    "prj3_encode_target",
    "SELECT key, CASE WHEN target = 'yes' THEN 1 ELSE 0 END AS target_eq, "
    "CASE WHEN starts_with(target, 'y') THEN 1 ELSE 0 END AS target_sw FROM v_obs",
    ("v_obs",),
)
def prj3(spark, d):
    df = obs(spark, d).select("key", "target")
    df = pj.encode_target(df, "target", "equals", out="target_eq")
    df = pj.encode_target(df, "target", "startswith", out="target_sw")
    return df.select("key", "target_eq", "target_sw")


@query(
    "prj4_split_xy",
    "SELECT key, client_id, num_a, num_b, num_c, cat_a, cat_b, cat_c, acquired_date FROM v_obs",
    ("v_obs",),
)
def prj4(spark, d):
    x, _y = pj.split_xy(obs(spark, d), "target")
    return x


@query(
    "prj6_fill_missing",
    "SELECT key, coalesce(nullif(cat_a, 'nan'), 'missing') AS cat_a, coalesce(num_c, 0.0) AS num_c FROM v_obs",
    ("v_obs",),
)
def prj6(spark, d):
    df = obs(spark, d).select("key", "cat_a", "num_c")
    df = pj.fill_missing(df, pj.MISSING, ["cat_a"])
    return pj.fill_missing(df, 0.0, ["num_c"])


@query(
    "prj7_clip_bounds",
    "SELECT key, CASE WHEN num_a > 300000 THEN 300000.0 ELSE num_a END AS num_a, "
    "CASE WHEN num_b < 0 THEN 0.0 ELSE num_b END AS num_b FROM v_obs",
    ("v_obs",),
)
def prj7(spark, d):
    df = obs(spark, d).select("key", "num_a", "num_b")
    df = pj.clip_bounds(df, "num_a", 300000.0, 300000.0, "upper")
    return pj.clip_bounds(df, "num_b", 0.0, 0.0, "lower")


@query(
    "prj8_map_values",
    "SELECT key, CASE cat_b WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' END AS cat_b "
    "FROM v_obs",
    ("v_obs",),
)
def prj8(spark, d):
    df = obs(spark, d).select("key", "cat_b")
    return pj.map_values(df, "cat_b", {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "medium"})


@query(
    "prj9_ratio_column",
    "SELECT key, num_a, num_c, round(CASE WHEN num_c = 0 THEN NULL ELSE num_a / num_c END, 6) AS num_a_num_c_ratio FROM v_obs",
    ("v_obs",),
)
def prj9(spark, d):
    return r6(pj.ratio_column(obs(spark, d).select("key", "num_a", "num_c"), "num_a", "num_c"))


@query(
    "prj10_take_log",
    "SELECT key, round(CASE WHEN num_b = 0 THEN 0.0 WHEN num_b > 0 THEN ln(num_b) END, 6) AS num_b FROM v_obs",
    ("v_obs",),
)
def prj10(spark, d):
    return r6(pj.take_log(obs(spark, d).select("key", "num_b"), ["num_b"]))


@query(
    "prj11_threshold_class",
    "SELECT key, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS predicted_class, "
    "CASE WHEN prob >= 0.75 THEN 'yes' ELSE 'no' END AS high_risk FROM v_pred",
    ("v_pred",),
)
def prj11(spark, d):
    df = views.v_pred(spark, d).select("key", "prob")
    df = pj.threshold_class(df, "prob", 0.5)
    df = pj.threshold_class(df, "prob", 0.75, out="high_risk", labels=("yes", "no"))
    return df.select("key", "predicted_class", "high_risk")


@query(
    "prj12_filter_in",
    "SELECT key, cat_b, cat_c FROM v_obs WHERE cat_c IN ('NATION_1', 'NATION_7', 'NATION_19')",
    ("v_obs",),
)
def prj12(spark, d):
    return pj.filter_in(obs(spark, d).select("key", "cat_b", "cat_c"), "cat_c", ["NATION_1", "NATION_7", "NATION_19"])


@query("prj13_filter_eq", "SELECT key, num_a FROM v_obs WHERE target = 'yes'", ("v_obs",))
def prj13(spark, d):
    return pj.filter_eq(obs(spark, d), "target", "yes").select("key", "num_a")


@query(
    "prj14_tag_rows",
    "SELECT key, label, 'model_v' AS model_uid, 'test' AS holdout_type FROM v_pred",
    ("v_pred",),
)
def prj14(spark, d):
    return pj.tag_rows(views.v_pred(spark, d).select("key", "label"), model_uid="model_v", holdout_type="test")


@query(
    "prj15_unpivot_features",
    "SELECT key, 'num_a' AS variable, num_a AS value FROM v_obs UNION ALL SELECT key, 'num_b', num_b FROM v_obs "
    "UNION ALL SELECT key, 'num_c', num_c FROM v_obs",
    ("v_obs",),
)
def prj15(spark, d):
    return pj.unpivot_features(obs(spark, d), ["key"], ["num_a", "num_b", "num_c"])


@query(
    "prj17_one_key_record",
    "SELECT key, to_json({'cat_a': coalesce(cat_a, 'missing'), 'cat_b': cat_b, 'cat_c': cat_c}) AS record FROM v_obs",
    ("v_obs",),
)
def prj17(spark, d):
    df = pj.fill_missing(obs(spark, d).select("key", "cat_a", "cat_b", "cat_c"), pj.MISSING, ["cat_a"])
    return pj.one_key_record(df, ["cat_a", "cat_b", "cat_c"]).select("key", "record")


@query(
    "prj18_rename_reorder",
    "SELECT target AS churn, key AS id, num_a AS activity_score FROM v_obs",
    ("v_obs",),
)
def prj18(spark, d):
    return pj.rename_reorder(
        obs(spark, d), {"target": "churn", "key": "id", "num_a": "activity_score"}, ["churn", "id", "activity_score"]
    )


# ---------------------------------------------------------------- scalar functions
@query("scl1_to_date", "SELECT key, TRY_CAST(acquired_date AS DATE) AS acquired_on FROM v_obs", ("v_obs",))
def scl1(spark, d):
    return obs(spark, d).select("key", fc.to_date_safe("acquired_date").alias("acquired_on"))


@query(
    "scl2_month_text",
    "SELECT key, CAST(month(TRY_CAST(acquired_date AS DATE)) AS VARCHAR) AS month FROM v_obs",
    ("v_obs",),
)
def scl2(spark, d):
    return obs(spark, d).select("key", fc.month_text(fc.to_date_safe("acquired_date")).alias("month"))


@query(
    "scl3_quarter_text",
    "SELECT key, 'q' || CAST(quarter(TRY_CAST(acquired_date AS DATE)) AS VARCHAR) AS quarter FROM v_obs",
    ("v_obs",),
)
def scl3(spark, d):
    return obs(spark, d).select("key", fc.quarter_text(fc.to_date_safe("acquired_date")).alias("quarter"))


@query(
    "scl4_year_text",
    "SELECT key, CAST(year(TRY_CAST(acquired_date AS DATE)) AS VARCHAR) AS year FROM v_obs",
    ("v_obs",),
)
def scl4(spark, d):
    return obs(spark, d).select("key", fc.year_text(fc.to_date_safe("acquired_date")).alias("year"))


@query(
    "scl5_lookback_start",
    "SELECT event_id AS key, date_trunc('second', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago') "
    "- INTERVAL 30 MINUTE AS start_timestamp FROM events",
)
def scl5(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("key"), fc.lookback_start(F.col("ts"), 30).alias("start_timestamp"))


@query(
    "scl6_run_id",
    "SELECT event_id AS key, 'random_forest_' || strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago', "
    "'%Y%m%d%H%M%S%f') AS run_id FROM events",
)
def scl6(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("key"), fc.run_id("random_forest", F.col("ts")).alias("run_id"))


@query(
    "scl7_uid_from_path",
    "SELECT event_id AS key, split_part('modeling/m' || CAST(event_id AS VARCHAR) || '/model.pkl', '/', 2) AS model_uid "
    "FROM events",
)
def scl7(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    path = F.concat(F.lit("modeling/m"), F.col("event_id").cast("string"), F.lit("/model.pkl"))
    return e.select(F.col("event_id").alias("key"), fc.uid_from_path(path).alias("model_uid"))


@query(
    "scl8_strip_json_text",
    """SELECT uid, trim(regexp_replace(regexp_extract(input_output_payloads, '"client_id": ("[^"]*")', 1), '["\\[\\]]', '', 'g'))
       AS client_id FROM v_logs""",
    ("v_logs",),
)
def scl8(spark, d):
    lg = views.v_logs(spark, d)
    raw = F.regexp_extract("input_output_payloads", r'"client_id": ("[^"]*")', 1)
    return lg.select("uid", fc.strip_json_text(raw).alias("client_id"))


@query(
    "scl9_json_extract",
    "SELECT uid, json_extract_string(input_output_payloads, '$.output.prediction') AS prediction, "
    "array_to_string(json_keys(input_output_payloads, '$.input'), ',') AS input_keys FROM v_logs",
    ("v_logs",),
)
def scl9(spark, d):
    lg = views.v_logs(spark, d)
    return lg.select(
        "uid",
        fc.json_field(F.col("input_output_payloads"), "$.output.prediction").alias("prediction"),
        fc.json_keys_text(F.col("input_output_payloads"), "$.input").alias("input_keys"),
    )


@query(
    "scl10_math",
    "SELECT key, round(abs(num_b), 6) AS abs_b, round(exp(prob), 6) AS exp_p, round(ln(num_a), 6) AS ln_a, "
    "round(sqrt(num_a), 6) AS sqrt_a, round(num_a / 7, 3) AS r3 FROM v_obs JOIN v_pred USING (key)",
    ("v_obs", "v_pred"),
)
def scl10(spark, d):
    j = obs(spark, d).join(views.v_pred(spark, d), "key")
    return r6(
        j.select(
            "key",
            F.abs("num_b").alias("abs_b"),
            F.exp("prob").alias("exp_p"),
            F.log("num_a").alias("ln_a"),
            F.sqrt("num_a").alias("sqrt_a"),
            F.round(F.col("num_a") / 7, 3).alias("r3"),
        )
    )


@query(
    "scl11_logistic_squash",
    "SELECT key, round((1 / (1 + exp(-(num_b / 1000))) - 0.5) / 0.5, 6) AS squashed FROM v_obs",
    ("v_obs",),
)
def scl11(spark, d):
    return r6(obs(spark, d).select("key", fc.logistic_squash(F.col("num_b") / 1000).alias("squashed")))


@query("scl12_level_label", "SELECT key, 'cat_c_' || cat_c AS feature FROM v_obs", ("v_obs",))
def scl12(spark, d):
    return obs(spark, d).select("key", fc.level_label("cat_c", F.col("cat_c")).alias("feature"))


@query(
    "scl13_items_text",
    "SELECT key, string_agg(item, ', ' ORDER BY item) AS items FROM (SELECT DISTINCT key, item FROM v_basket) GROUP BY key",
    ("v_basket",),
)
def scl13(spark, d):
    b = views.v_basket(spark, d).groupBy("key").agg(F.collect_set("item").alias("items"))
    return b.select("key", fc.items_text("items").alias("items"))


@query(
    "scl14_numeric_parse",
    """WITH f AS (SELECT json_extract_string(input_output_payloads, '$.input.client_id') AS client_id,
                     json_extract_string(input_output_payloads, '$.input.event_type') AS event_type FROM v_logs)
SELECT 'client_id' AS field, bool_and(client_id IS NULL OR TRY_CAST(trim(client_id) AS DOUBLE) IS NOT NULL) AS all_numeric FROM f
UNION ALL SELECT 'event_type', bool_and(event_type IS NULL OR TRY_CAST(trim(event_type) AS DOUBLE) IS NOT NULL) FROM f""",
    ("v_logs",),
)
def scl14(spark, d):
    lg = views.v_logs(spark, d)
    f = lg.select(
        fc.json_field(F.col("input_output_payloads"), "$.input.client_id").alias("client_id"),
        fc.json_field(F.col("input_output_payloads"), "$.input.event_type").alias("event_type"),
    )
    a = f.agg(fc.all_parse_as_double("client_id").alias("client_id"), fc.all_parse_as_double("event_type").alias("event_type"))
    return a.unpivot([], ["client_id", "event_type"], "field", "all_numeric")


__all__ = ["preds"]
