"""Exact nearest-neighbour statistics in one dimension (survey EXP-3).

Values stand on a whole-number grid with a hash in its lowest bits that tells
equal values apart, so distances and counts are exact and repeat.  Neighbours
come from a window over blocks of consecutive ranks, each with k border rows
of the blocks beside it; counts within a distance come from running sums over
points and bounds in one order.  No pair of rows is formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.functions.stats import digamma
from attrix.operators.kernels import hash_order, running_sums

#: Steps of the grid over a feature's range, and of the hash that breaks ties.
GRID, NOISE = 1 << 61, 1 << 30
BLOCK = 1 << 16
FAR = (1 << 63) - 1


def grid_unit(low: float, high: float) -> float:
    """The least power of two of which GRID steps cover the range."""
    return 2.0 ** math.ceil(math.log2((high - low) / GRID)) if high > low else 1.0


def on_grid(long: DataFrame, key: str, feature: str = "attribute", value: str = "x") -> DataFrame:
    """Column ``point``: the value on its feature's grid, ties broken by a hash of (key, feature).

    The grid's bounds are one row a feature (as many as the schema has columns)."""
    bounds = long.groupBy(feature).agg(F.min(value).alias("low"), F.max(value).alias("high")).collect()
    point = F.lit(None).cast("long")
    for r in bounds:
        step = F.round((F.col(value) - F.lit(r["low"])) / F.lit(grid_unit(r["low"], r["high"]))).cast("long")
        point = F.when(F.col(feature) == r[feature], step).otherwise(point)
    noise = F.floor(hash_order(F.col(key), F.col(feature)) / F.lit(NOISE)).cast("long")
    return long.withColumn("point", point + noise)


def kth_distance(k: int, columns: list[tuple[Column, Column]]) -> Column:
    """Distance to the k-th nearest, from the distances to the 1st, 2nd, ... on each side (FAR where there is none)."""
    left, right = ([F.lit(0), *[c[side] for c in columns]] for side in (0, 1))
    return F.least(*[F.greatest(left[j], right[k - j]) for j in range(k + 1)]) if k > 1 else F.least(left[1], right[1])


def neighbour_radius(points: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Adds ``size`` (rows of the group), ``near`` (k, or size - 1 if that is less) and
    ``radius``, the distance to the near-th neighbour of the group; rows alone in their group go."""
    ranked = running_sums(points.withColumn("_one", F.lit(1).cast("long")), groups, ["point", "key"], ["_one"])
    ranked = ranked.withColumnsRenamed({"cum__one": "_rank", "tot__one": "size"}).drop("_one").where("size > 1")
    at, place = F.floor((F.col("_rank") - 1) / BLOCK), F.pmod(F.col("_rank") - 1, F.lit(BLOCK))
    # the first and last k rows of a block are also border rows of the blocks beside it
    into = F.array(
        F.struct(at.alias("block"), F.lit(False).alias("border")),
        F.struct(F.when(place < k, at - 1).alias("block"), F.lit(True).alias("border")),
        F.struct(F.when(place >= BLOCK - k, at + 1).alias("block"), F.lit(True).alias("border")),
    )
    rows = ranked.withColumn("_in", F.explode(F.filter(into, lambda e: e["block"].isNotNull())))
    rows = rows.select("*", F.col("_in.block").alias("_block"), F.col("_in.border").alias("_border")).drop("_in")
    along = Window.partitionBy("_block", *groups).orderBy("_rank")
    sides = []
    for j in range(1, k + 1):
        rows = rows.withColumn(f"_l{j}", F.coalesce(F.col("point") - F.lag("point", j).over(along), F.lit(FAR)))
        rows = rows.withColumn(f"_r{j}", F.coalesce(F.lead("point", j).over(along) - F.col("point"), F.lit(FAR)))
        sides.append((F.col(f"_l{j}"), F.col(f"_r{j}")))
    near = F.least(F.lit(k), F.col("size") - 1).cast("int")
    radius = F.lit(None).cast("long")
    for j in range(1, k + 1):
        radius = F.when(near == j, kth_distance(j, sides)).otherwise(radius)
    kept = [c for c in ranked.columns if c != "_rank"]
    return rows.where("NOT _border").select(*kept, near.alias("near"), radius.alias("radius"))


def count_within(points: DataFrame, group: str) -> DataFrame:
    """Adds ``within``: points of ``group`` (any class) nearer than ``radius``, the row itself
    included; with radius 0 those at the same place."""
    reach = F.greatest(F.col("radius") - 1, F.lit(0))
    events = F.array(
        F.struct(F.col("point").alias("at"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("weight")),
        F.struct((F.col("point") - reach - 1).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("weight")),
        F.struct((F.col("point") + reach).alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("weight")),
    )
    rows = points.select(group, "key", "size", "near", F.explode(events).alias("e")).select(group, "key", "size", "near", "e.*")
    # points come before bounds at the same place, so a bound counts them
    summed = running_sums(rows, [group], ["at", "kind", "key"], ["weight"])
    below = F.max(F.when(F.col("kind") == 1, F.col("cum_weight")))
    upto = F.max(F.when(F.col("kind") == 2, F.col("cum_weight")))
    return summed.where("kind > 0").groupBy(group, "key", "size", "near").agg((upto - below).alias("within"))


def neighbour_information(long: DataFrame, k: int = 3) -> DataFrame:
    """(attribute, score): mutual information in nats of a continuous x and a discrete class,
    by k nearest neighbours, from (attribute, key, class, x) with a unique key per attribute.

    psi(n) + mean psi(k_i) - mean psi(n_class) - mean psi(m_i), not under 0,
    with m_i the rows nearer than the k-th neighbour of the own class.  A class
    of one row is left out, and in a small one k is its size less one.
    """
    points = on_grid(long.where(F.col("x").isNotNull() & ~F.isnan("x")), "key")
    counted = count_within(neighbour_radius(points.drop("x"), ["attribute", "class"], k), "attribute")
    means = counted.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("n"), F.avg(digamma(F.col("near")) - digamma(F.col("size")) - digamma(F.col("within"))).alias("rest")
    )
    return means.select("attribute", F.greatest(digamma(F.col("n")) + F.col("rest"), F.lit(0.0)).alias("score"))
