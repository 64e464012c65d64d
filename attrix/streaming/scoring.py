"""STR-1: streaming scoring of a request log.

Stateless per micro-batch: parse -> score -> stream-static join with the LTV
dimension (re-read each batch, so updates are picked up) -> pack as log rows
-> append to the log sink with a checkpoint (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.operators.serve import score_requests
from attrix.sources.logs import pack_requests


def scored_stream(requests: DataFrame, payload_col: str, schema: str, scorer: Column | Transformer, ltv: DataFrame,
                  cutoff: float = 0.75, keep: tuple[str, ...] = ("uid",)) -> DataFrame:
    """The same plan as batch ``score_requests``, a fitted model included; works on a streaming DataFrame."""
    return score_requests(requests, payload_col, schema, scorer, ltv=ltv, cutoff=cutoff, keep=keep)


def start_scoring_stream(requests: DataFrame, payload_col: str, schema: str, scorer: Column | Transformer, ltv: DataFrame,
                         input_cols, sink_path: str, checkpoint: str, trigger: dict | None = None):
    """Score a request stream and append packed log rows to ``sink_path``."""
    scored = scored_stream(requests, payload_col, schema, scorer, ltv).withColumn(
        "logging_timestamp", F.current_timestamp().cast("timestamp_ntz")
    )
    rows = pack_requests(scored, "uid", "logging_timestamp", list(input_cols),
                         ["prediction", "high_risk", "ltv", "error"])
    q = (rows.writeStream.outputMode("append").format("parquet")
         .option("path", sink_path).option("checkpointLocation", checkpoint))
    return q.trigger(**(trigger or {"availableNow": True})).start()
