"""What the document operators share: picking columns, lineage cuts, code for workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.session import materialize, read_table, ship_code

__all__ = ["materialize", "read_documents", "pick", "normal_text", "ship_code", "shuffle_width"]

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns of ``df`` by exact name under new names; all others go.

    Positions are used, so extra columns can't clash with internal names, not
    even those that differ from a wanted one in case only.
    """
    place = {name: f"in_{i}" for i, name in reversed(list(enumerate(df.columns)))}
    missing = [c for c in wanted.values() if c not in place]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    plain = df.toDF(*[f"in_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(place[c]).alias(new) for new, c in wanted.items()])


def normal_text(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
