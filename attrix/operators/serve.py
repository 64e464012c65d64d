"""Batch scoring, lookups and prediction reports (SRV-1..3, JN-1, JN-2).

The reference scores one HTTP request at a time; here a whole request log is
scored as one DataFrame job: parse -> conform -> score -> lookup join ->
cutoff.  Any fitted ``pyspark.ml`` model can score; ``linear_scorer`` is a
closed-form logistic scorer used where an exact oracle is wanted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.functions.columns import lookback_start, trunc_seconds_ntz
from attrix.operators.aggregates import with_scalar
from attrix.operators.stages import keeping

# Fixed values of the service contract: cut-off and reply texts.
PROBA_CUTOFF = 0.75
MISSING_CLIENT = "000000"
NOT_FOUND = "client_id_not_found"
ERROR_TEXT = "app was not able to process request"


def linear_scorer(coefs: Mapping[str, float], intercept: float = 0.0) -> Column:
    """sigmoid(intercept + sum b * x) with nulls treated as 0."""
    z = F.lit(float(intercept))
    for c, b in coefs.items():
        z = z + F.lit(float(b)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-z))


def latest_per_key(dim: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """Deduplicated lookup dimension: the last ``value`` per key by ``order``, of
    equals (and without an order) the largest, so a re-run gives the same."""
    if order is None:
        return dim.groupBy(key).agg(F.max(value).alias(value))
    return dim.groupBy(key).agg(F.max_by(F.col(value), F.struct(F.col(order), F.col(value))).alias(value))


def ltv_lookup(
    requests: DataFrame, ltv: DataFrame, client_col: str = "client_id", ltv_key: str = "client_id", order: str | None = None
) -> DataFrame:
    """JN-1: attach the client's lifetime value (last match), 0 when absent;
    a request without a client id is looked up as '000000'."""
    dim = latest_per_key(ltv, ltv_key, "ltv", order).select(F.col(ltv_key).cast("string").alias("_lk"), "ltv")
    req = requests.withColumn("_lk", F.coalesce(F.col(client_col).cast("string"), F.lit(MISSING_CLIENT)))
    return req.join(dim, "_lk", "left").withColumn("ltv", F.coalesce(F.col("ltv"), F.lit(0.0))).drop("_lk")


def positive_probability(df: DataFrame, scorer: Column | Transformer) -> DataFrame:
    """Column ``_p``: the scorer's value, or a fitted model's probability of class 1."""
    if isinstance(scorer, Column):
        return df.withColumn("_p", scorer)
    scored = keeping(scorer, df.columns).transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("_p"))


def score_requests(
    requests: DataFrame,
    payload_col: str,
    schema: str,
    scorer: Column | Transformer,
    ltv: DataFrame | None = None,
    cutoff: float = PROBA_CUTOFF,
    keep: tuple[str, ...] = ("uid",),
) -> DataFrame:
    """SRV-1: parse each JSON request with ``schema``, score it, round to 2
    places, flag ``high_risk`` at ``cutoff`` and attach ltv.

    ``scorer`` is a Column over the parsed fields or a fitted model (a saved
    pipeline, say).  Rows whose JSON does not parse take the error branch:
    error text and prediction 0; with a model, which would read such a field
    as missing, so do rows with a field that isn't of its type."""
    # malformed JSON parses to a struct of nulls, so validity is checked on the text
    ok = F.get_json_object(F.col(payload_col), "$").isNotNull()
    if isinstance(scorer, Column):
        parsed = requests.select(*keep, ok.alias("_ok"), F.from_json(F.col(payload_col), schema).alias("_r"))
    else:
        options = {"columnNameOfCorruptRecord": "_bad"}
        parsed = requests.select(*keep, ok.alias("_ok"), F.from_json(F.col(payload_col), f"{schema}, _bad string", options).alias("_r"))
        parsed = parsed.withColumn("_ok", F.col("_ok") & F.col("_r._bad").isNull()).withColumn("_r", F.col("_r").dropFields("_bad"))
    flat = parsed.select(*keep, "_ok", "_r.*")
    scored = positive_probability(flat, scorer).withColumn("_p", F.round("_p", 2))
    ok = F.col("_ok")
    out = scored.select(
        *keep,
        *[c for c in flat.columns if c not in keep and c != "_ok"],
        F.when(ok, F.col("_p")).otherwise(F.lit(0.0)).alias("prediction"),
        F.when(ok, F.when(F.col("_p") >= cutoff, "yes").otherwise("no")).alias("high_risk"),
        F.when(~ok, F.lit(ERROR_TEXT)).alias("error"),
    )
    if ltv is not None:
        out = ltv_lookup(out, ltv)
    return out


def score_clients(
    requests: DataFrame, ids_col: str, scores: DataFrame, score_key: str, score_col: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """SRV-2 / JN-2: comma-separated client ids per request -> one row per
    distinct trimmed id with its score as text, or 'client_id_not_found'."""
    parts = F.array_distinct(F.transform(F.split(F.col(ids_col), ","), lambda x: F.trim(x)))
    ids = requests.select(*keep, F.explode(parts).alias("client_id"))
    s = scores.select(F.col(score_key).cast("string").alias("client_id"), F.col(score_col).alias("_s"))
    return ids.join(s, "client_id", "left").select(
        *keep, "client_id", F.coalesce(F.col("_s").cast("string"), F.lit(NOT_FOUND)).alias("prediction")
    )


def prediction_report(
    logs: DataFrame,
    as_of_utc,
    minutes: int = 30,
    min_count: int = 50,
    ts_col: str = "logging_timestamp",
    payload_col: str = "input_output_payloads",
) -> DataFrame:
    """SRV-3: count and mean prediction of the requests logged since the
    lookback start; a row is emitted only when count >= ``min_count``.
    ``as_of_utc`` is a timestamp literal/Column (``current_timestamp()`` live)."""
    start = trunc_seconds_ntz(F.lit(as_of_utc)) - F.make_interval(mins=F.lit(minutes))
    recent = logs.where(F.col(ts_col) >= start)
    agg = recent.agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.avg(F.get_json_object(payload_col, "$.output.prediction").cast("double")).alias("mean_prediction"),
    )
    return agg.where(F.col("prediction_count") >= min_count).select(
        start.alias("start_timestamp"), "prediction_count", "mean_prediction"
    )


__all__ = ["lookback_start", "with_scalar"]
