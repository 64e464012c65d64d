"""Fitted trees as a node table, and exact tree Shapley values over it (survey XPL-1).

A node table has a row a node: ``tree, node, feature, cut, levels, left, right,
value, cover``.  Rows with feature value <= cut (or, where ``levels`` is set,
one of these) go left; a leaf has feature -1; ``value`` is what a leaf adds to
the score and ``cover`` the training rows that reached the node.  The table is
the model, so it is as large as the forest's own parameters allow.

Shapley values are path-dependent ones: a feature that isn't known follows
both children by their cover.  On the path to a leaf each feature counts once,
with z the share of cover that its splits keep and o whether the row fits
them.  The weight |S|! (d - 1 - |S|)! / d! of a subset S of the other features
is the integral of t^|S| (1 - t)^(d - 1 - |S|) from 0 to 1, so the sum over all
subsets is the integral of prod (z (1 - t) + o t), a polynomial of degree
d - 1: Gauss-Legendre points give it exactly, for all rows and leaves at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.operators.stages import feature_lineage, transform_only
from attrix.session import materialize, shared_path, ship_code

NODES = "tree int, node int, feature int, cut double, levels array<double>, left int, right int, value double, cover double"
#: Cells (rows x leaves x path length) that a task works on at once.
CELLS = 1 << 21


# ---------------------------------------------------------------- node tables
def tree_nodes(model) -> DataFrame:
    """The node table of a fitted MLlib tree classifier, from what it saves.

    Forest leaves add their share of class 1 over the number of trees; boosted
    ones twice their weighted prediction, the log odds of MLlib's probability.
    """
    spark = SparkSession.active()
    path = shared_path(spark, "tree-model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        data = data.withColumn("tree", F.lit(0))
    boosted = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")
    if boosted:
        weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
        value = 2.0 * F.col("prediction") * F.get(weights, F.col("tree"))
    else:
        trees = float(getattr(model, "getNumTrees", 1))
        total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
        value = F.try_divide(F.get("impurityStats", F.lit(1)), total) / trees
    inner = F.col("leftChild") >= 0
    ordered = F.col("split.numCategories") < 0
    nodes = data.select(
        F.col("tree").cast("int").alias("tree"),
        F.col("id").cast("int").alias("node"),
        F.when(inner, F.col("split.featureIndex")).otherwise(-1).cast("int").alias("feature"),
        F.when(inner & ordered, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("cut"),
        F.when(inner & ~ordered, F.col("split.leftCategoriesOrThreshold")).alias("levels"),
        F.col("leftChild").cast("int").alias("left"),
        F.col("rightChild").cast("int").alias("right"),
        F.when(~inner, value).alias("value"),
        F.col("rawCount").cast("double").alias("cover"),
    )
    return materialize(nodes, "tree-nodes")


def node_covers(df: DataFrame, nodes: Sequence[tuple], features: Sequence[str]) -> list[tuple]:
    """Rows (tree, node, feature, cut, left, right, value) of a given forest, as node
    table rows with the cover that ``df`` gives them: one aggregation over all nodes."""
    by = {(n[0], n[1]): n for n in nodes}
    reach = {}
    children = {(t, c) for t, _, f, _, left, right, _ in nodes if f >= 0 for c in (left, right)}
    stack = [(k, F.lit(True)) for k in by if k not in children]
    while stack:
        (tree, node), condition = stack.pop()
        reach[tree, node] = condition
        _, _, f, cut, left, right, _ = by[tree, node]
        if f >= 0:
            under = F.col(features[f]) <= cut
            stack += [((tree, left), condition & under), ((tree, right), condition & ~under)]
    row = df.agg(*[F.count(F.when(c, 1)).cast("double").alias(f"c{t}_{n}") for (t, n), c in reach.items()]).first()
    return [(t, n, f, cut, None, left, right, value, row[f"c{t}_{n}"]) for t, n, f, cut, left, right, value in nodes]


@dataclass(frozen=True)
class Paths:
    """All leaves of a node table, with the distinct features of their paths.

    Arrays are leaves x longest path; a place past a path's end has z = 1 and
    no condition.  ``low < x <= high`` is a path's condition on a feature; for
    features split by level, ``levels`` has them by (leaf, place) and whether
    the row's must be one of them.
    """

    features: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    levels: dict[tuple[int, int], tuple[list[float], bool]]
    share: np.ndarray
    value: np.ndarray

    @property
    def expected(self) -> float:
        return float((self.value * self.share.prod(axis=1)).sum())

    def fits(self, x: np.ndarray) -> np.ndarray:
        """Rows x leaves x places: whether the row meets the condition."""
        v = x[:, self.at]
        out = (v > self.low) & (v <= self.high)
        for (leaf, k), (known, among) in self.levels.items():
            out[:, leaf, k] &= np.isin(v[:, leaf, k], known, invert=not among)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.fits(x).all(axis=2) @ self.value

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Rows x features: contributions to the score."""
        leaves, width = self.at.shape
        if not leaves or not width:
            return np.zeros((len(x), len(self.features)))
        points, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
        order = np.argsort(self.at.ravel(), kind="stable")
        first = np.searchsorted(self.at.ravel()[order], np.arange(len(self.features)))
        out = np.empty((len(x), len(self.features)))
        step = max(1, CELLS // (leaves * width))
        for i in range(0, len(x), step):
            fits = self.fits(x[i : i + step]).astype(float)
            total = np.zeros_like(fits)
            for point, weight in zip((points + 1) / 2, weights / 2):
                factor = self.share * (1 - point) + fits * point
                # products without a place, by those before and after it: a factor can be 0
                before, after = np.ones_like(factor), np.ones_like(factor)
                np.cumprod(factor[:, :, :-1], axis=2, out=before[:, :, 1:])
                np.cumprod(factor[:, :, :0:-1], axis=2, out=after[:, :, -2::-1])
                total += weight * before * after
            parts = (self.value[:, None] * (fits - self.share) * total).reshape(len(fits), -1)[:, order]
            out[i : i + step] = np.add.reduceat(parts, first, axis=1)
        return out


def tree_paths(nodes: DataFrame) -> Paths:
    """The paths of a node table, which comes to the driver as a fitted model does."""
    rows = {(r["tree"], r["node"]): r for r in nodes.collect()}
    children = {(t, c) for (t, _), r in rows.items() if r["feature"] >= 0 for c in (r["left"], r["right"])}
    found = []
    stack = [(key, {}) for key in sorted(rows) if key not in children]
    while stack:
        (tree, node), path = stack.pop()
        r = rows[tree, node]
        if r["feature"] < 0:
            found.append((path, r["value"]))
            continue
        for side, child in ((0, r["left"]), (1, r["right"])):
            low, high, allowed, banned, z = path.get(r["feature"], (-np.inf, np.inf, None, frozenset(), 1.0))
            if r["levels"] is None:
                low, high = (low, min(high, r["cut"])) if side == 0 else (max(low, r["cut"]), high)
            elif side == 0:
                allowed = frozenset(r["levels"]) & allowed if allowed is not None else frozenset(r["levels"])
            else:
                banned = banned | frozenset(r["levels"])
            z *= rows[tree, child]["cover"] / r["cover"] if r["cover"] else 0.5
            stack.append(((tree, child), {**path, r["feature"]: (low, high, allowed, banned, z)}))
    features = np.array(sorted({f for path, _ in found for f in path}), dtype=int)
    place = {f: i for i, f in enumerate(features.tolist())}
    width = max((len(path) for path, _ in found), default=0)
    shape = (len(found), width)
    at, share = np.zeros(shape, int), np.ones(shape)
    low, high, levels = np.full(shape, -np.inf), np.full(shape, np.inf), {}
    for leaf, (path, _) in enumerate(found):
        for k, (f, (lo, hi, allowed, banned, z)) in enumerate(path.items()):
            at[leaf, k], low[leaf, k], high[leaf, k], share[leaf, k] = place[f], lo, hi, z
            if allowed is not None:
                levels[leaf, k] = sorted(allowed - banned), True
            elif banned:
                levels[leaf, k] = sorted(banned), False
    return Paths(features, at, low, high, levels, share, np.array([v for _, v in found], dtype=float))


# ---------------------------------------------------------------- Spark
def tree_shapley(df: DataFrame, key: str, paths: Paths, names: DataFrame | None = None, vector: str = "features") -> DataFrame:
    """XPL-1 for tree models: (key, feature, shap, expected_value), exact.

    ``names`` is the (slot, feature) table of the vector's slots; without it a
    feature is its slot's number.  Features that no tree uses aren't listed
    (their value is 0); per row the values add up to score - expected_value.
    """
    ship_code(df.sparkSession)
    slots = paths.features.tolist()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, len(slots))
            values = paths.shapley(x)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(slots), dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], [key, "shap"])

    used = F.transform(F.array(*[F.lit(s) for s in slots]), lambda s: F.get(F.col("_v"), s))
    rows = df.select(key, vector_to_array(vector).alias("_v")).select(key, used.alias("x"))
    long = rows.mapInArrow(run, f"{key} {kind}, shap array<double>").select(key, F.posexplode("shap").alias("_at", "shap"))
    long = long.select(key, F.get(F.array(*[F.lit(s) for s in slots]), F.col("_at")).alias("slot"), "shap")
    if names is None:
        named = long.withColumn("feature", F.col("slot").cast("string"))
    else:
        named = long.join(names.select(F.col("slot").cast("int").alias("slot"), "feature"), "slot")
    return named.select(key, "feature", "shap", F.lit(paths.expected).alias("expected_value"))


def _paths(model: PipelineModel) -> Paths:
    last = model.stages[-1]
    return tree_paths(last.table if hasattr(last, "table") else tree_nodes(last))


def model_shapley(df: DataFrame, key: str, model: PipelineModel, paths: Paths | None = None) -> DataFrame:
    """``tree_shapley`` of a feature pipeline that ends with a tree classifier."""
    return tree_shapley(transform_only(model).transform(df), key, paths or _paths(model), feature_lineage(model))


def fold_shapley(df: DataFrame, key: str, models: Sequence[PipelineModel]) -> DataFrame:
    """Mean of the folds' values and expected values by feature; a feature that a
    fold's trees don't use counts there as 0."""
    paths = [_paths(m) for m in models]
    both = reduce(DataFrame.unionByName, [model_shapley(df, key, m, p) for m, p in zip(models, paths)])
    out = both.groupBy(key, "feature").agg((F.sum("shap") / float(len(paths))).alias("shap"))
    return out.withColumn("expected_value", F.lit(float(np.mean([p.expected for p in paths]))))
