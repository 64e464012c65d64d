"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a target share of the mixture.  With ``v`` its share of the
volume now and ``w`` its target share, each of its documents is repeated
Poisson(``size * w / v``) times, so that the expected volume of the source is
its target.  The Poisson variable is the inverse of its distribution function
at a uniform number made from a hash of (seed, doc_id, text), so a re-run or a
retried task repeats it exactly; a row without an id has its position in the
input instead.  Each copy then gets a hash of (seed, doc_id, text, copy) and
goes to a partition and a place in it by that hash: a random order over all
sources, whatever share of the rows one source, or no id, has.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.shared import materialize, pick, shuffle_width

SEED = "mix-1"
#: Target share of a source ~ (its share now) ** POWER when no weights are given.
POWER = 0.5
#: A larger mean is split into equal parts, so that exp(-mean) stays far from 0.
PART_MEAN = 32.0
#: The rows of a source meet so many copies of its rate, so that a hot source divides.
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """Smallest k with P(X <= k) >= u for X ~ Poisson(mean), for means up to PART_MEAN."""
    last = (F.ceil(mean + 14 * F.sqrt(mean)) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + F.when(s["cdf"] < u, 1).otherwise(0)).alias("n"))

    return F.when(mean <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"]))


def source_rates(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    size: float = 1.0,
    power: float = POWER,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per source: source, volume (code points), share, target, rate.

    ``weights`` names target weights (a source that is missing there gets 0);
    without them a source's weight is its share to the power ``power``.
    """
    volume = (
        pick(docs, source=source_col, text=text_col)
        .groupBy("source")
        .agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("volume"), F.count(F.lit(1)).alias("n_docs"))
    )
    volume = materialize(volume, "mix-volume")  # one row per source
    total = volume.agg(F.sum("volume")).first()[0] or 0
    share = volume.withColumn("share", F.col("volume") / F.lit(float(max(total, 1))))
    if weights is None:
        raw = F.pow(F.col("share"), F.lit(float(power)))
    else:
        known = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()]
        raw = F.coalesce(*known, F.lit(0.0))
    share = share.withColumn("raw", F.when(F.col("volume") > 0, raw).otherwise(0.0))
    all_raw = share.agg(F.sum("raw")).first()[0] or 0.0
    target = F.col("raw") / F.lit(float(all_raw) if all_raw else 1.0)
    return share.select(
        "source",
        "volume",
        "share",
        target.alias("target"),
        F.when(F.col("share") > 0, F.round(F.lit(float(size)) * target / F.col("share"), 9)).otherwise(0.0).alias("rate"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    size: float = 1.0,
    power: float = POWER,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Every column of ``docs`` plus mix_rate, mix_copy (from 1) and mix_key, one row per copy, shuffled.

    A null source is a source of its own; a null or empty text has no volume,
    and a source without any volume has rate 0, so its rows don't appear (the
    target weights are shares of volume).  Rows that repeat an id and its text
    are one document and draw the same number.  A row without an id draws by
    its text and its position in the input, so read ``docs`` from files.  An
    empty table gives an empty result.  Columns of those three names in the
    input are replaced; names that differ in case only stay apart.
    """
    spark = docs.sparkSession
    rates = materialize(source_rates(docs, weights, size, power, source_col, text_col).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate")), "mix-rates")
    kept = [(i, c) for i, c in enumerate(docs.columns) if c not in ("mix_rate", "mix_copy", "mix_key")]
    id_, source, text = (F.col(f"in_{docs.columns.index(c)}") for c in (id_col, source_col, text_col))
    rows = docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    who = F.coalesce(id_.cast("string"), F.concat(F.lit("null@"), F.monotonically_increasing_id().cast("string")))
    rows = rows.select(*[F.col(f"in_{i}") for i, _ in kept], who.alias("mix_who"), F.md5(F.coalesce(text.cast("string"), F.lit(""))).alias("mix_text"))
    rows = rows.withColumn("mix_salt", F.pmod(F.xxhash64("mix_who", "mix_text"), F.lit(SALTS)))
    spread = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.join(spread, source.eqNullSafe(spread["mix_source"]) & (rows["mix_salt"] == spread["rate_salt"]))
    rate = F.col("mix_rate")
    parts = F.greatest(F.ceil(rate / PART_MEAN), F.lit(1)).cast("int")

    def draw(part: Column) -> Column:
        return poisson_inverse(uniform(F.lit(seed), F.col("mix_who"), F.col("mix_text"), part), rate / parts)

    copies = F.when(rate <= PART_MEAN, draw(F.lit(1))).otherwise(
        F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, part: n + draw(part))
    )
    out = joined.withColumn("mix_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), "mix_who", "mix_text", F.col("mix_copy").cast("string"))))
    out = out.select(*[F.col(f"in_{i}") for i, _ in kept], "mix_rate", "mix_copy", "mix_key")
    out = out.repartition(shuffle_width(spark), "mix_key").sortWithinPartitions("mix_key")
    return out.toDF(*[c for _, c in kept], "mix_rate", "mix_copy", "mix_key")


SQL = f"""
WITH v AS (SELECT source, sum(length(coalesce(text, ''))) AS volume FROM documents GROUP BY source),
s AS (SELECT source, volume, volume / (SELECT CAST(sum(volume) AS DOUBLE) FROM v) AS share FROM v),
r AS (SELECT source, round(pow(share, {POWER}) / (SELECT sum(pow(share, {POWER})) FROM s) / share, 9) AS rate FROM s WHERE volume > 0),
u AS (
  SELECT d.doc_id, d.source, d.text, r.rate,
         (CAST(('0x' || substr(md5('{SEED}|' || CAST(d.doc_id AS VARCHAR) || '|' || md5(coalesce(d.text, '')) || '|1'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS x
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
),
t AS (SELECT source, rate, k, exp(-rate) * pow(rate, k) / gamma(k + 1.0) AS p FROM r, range(0, 100) AS ks(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
n AS (SELECT u.doc_id, u.source, u.text, u.rate, count(c.k) AS copies FROM u LEFT JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf < u.x GROUP BY ALL)
SELECT doc_id, source, rate AS mix_rate, CAST(copy AS INTEGER) AS mix_copy,
       md5('{SEED}|' || CAST(doc_id AS VARCHAR) || '|' || md5(coalesce(text, '')) || '|' || CAST(copy AS VARCHAR)) AS mix_key, coalesce(text, '') AS text
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n)
"""
