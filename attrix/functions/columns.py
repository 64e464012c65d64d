"""Scalar column functions (survey section 2.4): dates, ids, JSON text, maths.

Each returns a Column built from built-in functions (JVM-side, codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month number (as text) -> quarter label, as used by the reference.
MONTH_TO_QUARTER = {
    "1": "q1", "2": "q1", "3": "q1",
    "4": "q2", "5": "q2", "6": "q2",
    "7": "q3", "8": "q3", "9": "q3",
    "10": "q4", "11": "q4", "12": "q4",
}
SERVICE_TZ = "America/Chicago"  # the reference's "US/Central"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_date_safe(c) -> Column:
    """SCL-1: text -> date; unparseable text gives null (ANSI ``to_date`` would raise)."""
    return F.try_to_date(_c(c))


def month_text(d) -> Column:
    """SCL-2: month number as text without padding ('6')."""
    return F.month(_c(d)).cast("string")


def quarter_text(d) -> Column:
    """SCL-3: 'q1'..'q4' via the month -> quarter dictionary."""
    m = F.create_map(*[x for k, v in MONTH_TO_QUARTER.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, month_text(d))


def year_text(d) -> Column:
    """SCL-4: year as text."""
    return F.year(_c(d)).cast("string")


def service_local(ts_utc) -> Column:
    """UTC wall time -> service-local wall time (timestamp without zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(SERVICE_TZ), _c(ts_utc).cast("timestamp_ntz"))


def trunc_seconds_ntz(c) -> Column:
    """Wall time truncated to whole seconds, independent of the session zone
    (``date_trunc`` would pass a zone-free timestamp through the session zone)."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    return F.to_timestamp_ntz(F.date_format(_c(c).cast("timestamp_ntz"), fmt), F.lit(fmt))


def day_start_ntz(c) -> Column:
    """Wall-clock midnight of the day, independent of the session zone."""
    return _c(c).cast("timestamp_ntz").cast("date").cast("timestamp_ntz")


def lookback_start(as_of_utc, minutes: int) -> Column:
    """SCL-5: service-local time truncated to seconds minus ``minutes``.
    ``as_of_utc`` is explicit (pass ``current_timestamp()`` in production)."""
    return trunc_seconds_ntz(service_local(as_of_utc)) - F.make_interval(mins=F.lit(minutes))


def run_id(base: str, ts_utc) -> Column:
    """SCL-6: '<base>_<local yyyyMMddHHmmss + microseconds>' (separators stripped)."""
    return F.concat(F.lit(base + "_"), F.date_format(service_local(ts_utc), "yyyyMMddHHmmssSSSSSS"))


def uid_from_path(path) -> Column:
    """SCL-7: second '/'-separated segment of a model path."""
    return F.split_part(_c(path), F.lit("/"), F.lit(2))


def strip_json_text(c) -> Column:
    """SCL-8: drop quotes and brackets from a JSON fragment and trim spaces."""
    return F.trim(F.regexp_replace(_c(c), r'["\[\]]', ""))


def json_field(c, path: str) -> Column:
    """SCL-9: one JSON path as text (path pruning: only this field is parsed)."""
    return F.get_json_object(_c(c), path)


def json_keys_text(c, path: str = "$") -> Column:
    """SCL-9: keys of the JSON object at ``path``, comma-joined."""
    obj = _c(c) if path == "$" else F.get_json_object(_c(c), path)
    return F.array_join(F.json_object_keys(obj), ",")


def logistic_squash(c) -> Column:
    """SCL-11: (sigmoid(c) - 0.5) / 0.5 — maps coefficients into (-1, 1)."""
    return (1.0 / (1.0 + F.exp(-_c(c))) - 0.5) / 0.5


def level_label(feature: str, level) -> Column:
    """SCL-12: '<feature>_<level>'."""
    return F.concat_ws("_", F.lit(feature), _c(level))


def items_text(items) -> Column:
    """SCL-13: item array -> sorted comma text for display."""
    return F.array_join(F.array_sort(_c(items)), ", ")


def parses_as_double(c) -> Column:
    """SCL-14: true when the value is null or its trimmed text parses as a number."""
    return _c(c).isNull() | F.trim(_c(c).cast("string")).try_cast("double").isNotNull()


def all_parse_as_double(c) -> Column:
    """SCL-14 aggregate: every non-null value of the column parses as a number."""
    return F.coalesce(F.bool_and(parses_as_double(c)), F.lit(True))
