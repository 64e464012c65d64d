"""Exact duplicates by distributed MSD radix partitioning.

A document is read as the string ``length, byte 1, byte 2, ...`` of its
normalised text.  The first round splits on the length and the first
``FIRST_WIDTH`` bytes, each later one on the next bytes, eight times as many
as before.  A group that is down to one document, or whose bytes have ended,
is settled and leaves; the rest goes on.  A group is named by the smallest
doc_id in it and told apart by a number, as an id may repeat with other texts
or be null; so equality never rests on a digest.

The rows of a group meet only as partial aggregates (``min`` and ``count``);
the group's name goes back by an equi-join, whose hot keys AQE can split.  So
a group with a third of all rows is no one task's work.  Each round's
undecided rows are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.shared import materialize, normal_text, pick

FIRST_WIDTH = 64
GROWTH = 8


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the name, size and number of their group by ``keys``."""
    groups = rows.groupBy(*keys).agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("size"))
    groups = groups.filter("size > 1").select(*[F.col(k).alias(f"g_{k}") for k in keys], "name", "size", F.monotonically_increasing_id().alias("number"))
    # a table of its own, so that the join has two plain exchanges and AQE can split a hot group, and numbers stay
    groups = materialize(groups, "radix-groups").hint("merge")  # the same join at every size
    same = [rows[k].eqNullSafe(groups[f"g_{k}"]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(groups, condition, "left").drop(*[f"g_{k}" for k in keys])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after each run of white space became one
    space.  Of equal texts the smallest doc_id stays (``keep_id``).  A null
    text is empty.  Null ids: such a row is kept only if its whole group has
    no id (keep_id is then null).  Rows with the same id and text count as
    copies in group_size; all of them carry the decision of their id.  An
    empty table gives an empty result; other columns are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", normal_text(F.col("text").cast("string")).cast("binary").alias("body")
    )
    digits = base.select(
        "doc_id",
        F.octet_length("body").cast("long").alias("n_bytes"),
        F.substring("body", 1, FIRST_WIDTH).alias("digit"),
        "body",
    )
    first = _named(digits, ["n_bytes", "digit"])
    open_ = F.col("name").isNotNull() | F.col("size").isNotNull()
    going = open_ & (F.col("n_bytes") > FIRST_WIDTH)
    state = materialize(
        first.select(
            "doc_id",
            "n_bytes",
            F.sha2("body", 256).alias("text_sha256"),
            "name",
            "number",
            F.coalesce("size", F.lit(1)).alias("size"),
            going.alias("going"),
            F.when(going, F.col("body")).alias("body"),
        ),
        "radix-0",
    )
    # A group of one is named after its row.
    settled = [_decided(state.filter("NOT going"))]
    offset, width = FIRST_WIDTH, FIRST_WIDTH * GROWTH
    active = state.filter("going")
    round_ = 1
    while active.limit(1).count():
        rows = active.select(
            "doc_id",
            "n_bytes",
            "text_sha256",
            F.col("number").alias("group"),
            F.substring("body", offset + 1, width).alias("digit"),
            "body",
        )
        named = _named(rows, ["group", "digit"])
        offset += width
        width *= GROWTH
        going = F.col("size").isNotNull() & (F.col("n_bytes") > offset)
        state = materialize(
            named.select(
                "doc_id",
                "n_bytes",
                "text_sha256",
                "name",
                "number",
                F.coalesce("size", F.lit(1)).alias("size"),
                going.alias("going"),
                F.when(going, F.col("body")).alias("body"),
            ),
            f"radix-{round_}",
        )
        settled.append(_decided(state.filter("NOT going")))
        active = state.filter("going")
        round_ += 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def _decided(rows: DataFrame) -> DataFrame:
    keep = F.when(F.col("size") == 1, F.col("doc_id")).otherwise(F.col("name"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "n_bytes",
    )


SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept,
       sha256(n.t) AS text_sha256, CAST(octet_length(encode(n.t)) AS BIGINT) AS n_bytes
FROM n JOIN g ON n.t = g.t
"""
