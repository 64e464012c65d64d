"""Test views over the supplied TPC-H-ish tables, built with the DataFrame API.

The same definitions exist as SQL text in ``attrix.plans.sqlviews`` for the
DuckDB oracle.  Joins against ``nation`` (25 rows by the TPC-H spec) are the
only forced broadcasts; everything else is left to Catalyst/AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.session import read_table


def v_obs(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    qty = (
        read_table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("qty"))
    )
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(qty, o.o_orderkey == qty.l_orderkey, "left")
    )
    return j.select(
        F.col("o_orderkey").alias("key"),
        F.col("o_custkey").alias("client_id"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("target"),
        F.col("o_totalprice").alias("num_a"),
        F.col("c_acctbal").alias("num_b"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("qty")).alias("num_c"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("c_mktsegment"))
        .alias("cat_a"),
        F.col("o_orderpriority").alias("cat_b"),
        F.col("n_name").alias("cat_c"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("acquired_date"),
    )


def v_pred(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("key"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END").alias("label"),
        F.expr(
            "((o_orderkey * 7919) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 250 ELSE 0 END + 5e-1) / 1.25e3"
        ).alias("prob"),
        F.expr(
            "((o_orderkey * 6101) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END + 5e-1) / 1.1e3"
        ).alias("prob_b"),
        F.expr(
            "((o_orderkey * 4447) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 50 ELSE 0 END + 5e-1) / 1.05e3"
        ).alias("prob_c"),
    )


def v_docs(spark: SparkSession, d: str) -> DataFrame:
    lab = read_table(spark, d, "labels").select("doc_id", "quality")
    doc = read_table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    j = lab.join(doc, "doc_id")
    return j.select(
        F.col("doc_id").alias("key"),
        F.col("quality").alias("label"),
        (F.col("n_chars") / F.lit(2e4)).alias("score"),
        "lang",
        "source",
    )


def v_drift(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("key"),
        F.expr("CASE WHEN ts < TIMESTAMP_NTZ '2024-01-16 00:00:00' THEN 'train' ELSE 'prod' END").alias("side"),
        "event_type",
        "value",
        (F.col("user_id") % 7).cast("string").alias("user_group"),
    )


def v_logs(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    payload = F.concat(
        F.lit('{"input": {"client_id": "'),
        F.col("user_id").cast("string"),
        F.lit('", "event_type": "'),
        F.col("event_type"),
        F.lit('"}, "output": {"prediction": 0.'),
        F.lpad(((F.col("event_id") * 37) % 1000).cast("string"), 3, "0"),
        F.lit(', "model_uid": "m'),
        (F.col("event_id") % 2).cast("string"),
        F.lit('"}}'),
    )
    return e.select(
        F.col("event_id").cast("string").alias("uid"),
        F.col("ts").alias("logging_timestamp"),
        payload.alias("input_output_payloads"),
    )


def v_ltv(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("client_id"), F.col("c_acctbal").alias("ltv")
    )


def v_basket(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = read_table(spark, d, "part").select("p_partkey", "p_type")
    return (
        li.join(p, li.l_partkey == p.p_partkey)
        .select(F.col("l_orderkey").alias("key"), F.col("p_type").alias("item"))
        .distinct()
    )


def v_vec(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")
