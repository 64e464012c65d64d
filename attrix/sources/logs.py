"""Request-log sources and the log sink format (SRC-3, SRC-7, SRC-9, SNK-2, SET-1).

A log row is ``(uid, logging_timestamp, input_output_payloads)`` where the
payload is ``{"input": {...}, "output": {...}}`` JSON text.  Single fields are
read with ``get_json_object`` (only that path is parsed); whole objects with
``from_json``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attrix.functions.columns import all_parse_as_double, strip_json_text

PAYLOAD = "input_output_payloads"
DROP_INPUT_FIELDS = ("uid", "url", "endpoint")
MAX_INPUT_KEYS = 10_000


def parse_requests(df: DataFrame, json_col: str, schema: StructType | str, keep: Sequence[str] = ()) -> DataFrame:
    """SRC-3: JSON object -> one column per field (malformed JSON -> nulls)."""
    return df.select(*keep, F.from_json(F.col(json_col), schema).alias("_r")).select(*keep, "_r.*")


def input_map(payload: Column) -> Column:
    """The request's input object as map<string,string> (numbers kept as text)."""
    return F.from_json(F.get_json_object(payload, "$.input"), "map<string,string>")


def production_requests(
    logs: DataFrame,
    model_uid: str,
    since,
    model_path: str = "$.output.model_uid",
    ts_col: str = "logging_timestamp",
    payload_col: str = PAYLOAD,
    drop: Sequence[str] = DROP_INPUT_FIELDS,
) -> DataFrame:
    """SRC-7: the input features of the requests served by ``model_uid`` since
    ``since``, one column per input key (keys by name, not by position, so
    commas inside values are harmless), quotes/space trimmed, and columns whose
    every value parses as a number cast to double.

    Two small driver round trips decide the output schema: the distinct input
    keys and, per key, whether all values parse (one aggregate row)."""
    f = logs.where((F.get_json_object(payload_col, model_path) == model_uid) & (F.col(ts_col) >= F.lit(since)))
    m = f.select(input_map(F.col(payload_col)).alias("_in"))
    found = m.select(F.explode(F.map_keys("_in")).alias("k")).distinct().limit(MAX_INPUT_KEYS + 1).collect()
    if len(found) > MAX_INPUT_KEYS:
        raise ValueError(f"more than {MAX_INPUT_KEYS} distinct input keys: not a request schema")
    keys = sorted(r["k"] for r in found if r["k"] not in drop)
    if not keys:
        return m.select().limit(0)
    wide = m.select(*[strip_json_text(F.col("_in")[k]).alias(k) for k in keys])
    numeric = wide.agg(*[all_parse_as_double(F.col(f"`{k}`")).alias(k) for k in keys]).first()
    return wide.select(
        *[(F.trim(F.col(f"`{k}`")).try_cast("double") if numeric[k] else F.col(f"`{k}`")).alias(k) for k in keys]
    )


def recent_predictions(logs: DataFrame, since, ts_col: str = "logging_timestamp", payload_col: str = PAYLOAD) -> DataFrame:
    """SRC-9: ``$.output.prediction`` of the log rows since a timestamp."""
    return logs.where(F.col(ts_col) >= F.lit(since)).select(
        ts_col, F.get_json_object(payload_col, "$.output.prediction").cast("double").alias("prediction")
    )


def pack_requests(
    df: DataFrame,
    uid: str,
    ts: str,
    input_cols: Sequence[str],
    output_cols: Sequence[str],
    out: str = PAYLOAD,
) -> DataFrame:
    """SNK-2: pack each scored request as ``{"input": {...}, "output": {...}}``
    with its uid and logging timestamp (the log table's schema)."""
    payload = F.to_json(
        F.struct(
            F.struct(*[F.col(c) for c in input_cols]).alias("input"),
            F.struct(*[F.col(c) for c in output_cols]).alias("output"),
        )
    )
    return df.select(F.col(uid).alias("uid"), F.col(ts).alias("logging_timestamp"), payload.alias(out))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-1: UNION of two filters of the same table.  When a unique id column
    exists, prefer one OR filter (no shuffle); this is the general form."""
    return a.unionByName(b).distinct()


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """SET-2: UNION ALL by column name; missing columns are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
