"""Extremely randomised trees, grown level by level (survey TRN-5).

At each node some features are drawn, and for each one cut, at random between
the least and the largest value that the node has of it; the cut with the
largest Gini gain splits the node.  All rows take part in every tree.

Values are read as bins whose edges come from a bounded sample
(``SAMPLE`` rows by hash); a cut is one of the edges within the node's range,
drawn by value.  A level is one aggregation over (tree, node, feature, bin,
class): tasks count their rows in numpy, Spark adds the counts up, and the
driver draws the cuts from at most ``CELLS`` of them a pass.  Draws depend on
(seed, tree, node) alone and counts are exact, so the trees are the same
however the rows lie.  The fitted model is a node table (``trees.NODES``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.operators.encoders import TableModel
from attrix.operators.trees import NODES
from attrix.session import materialize, ship_code

SAMPLE = 10_000
CELLS = 1 << 20


class _ExtraTreesParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class, 0 or 1", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight of a row", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "weight of a child, at least", TypeConverters.toFloat)
    minWeightFractionPerNode = Param(Params._dummy(), "minWeightFractionPerNode", "share of all weight of a child, at least", TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features drawn a node: all, sqrt, log2", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(
            featuresCol="features", labelCol="label", numTrees=20, maxDepth=5, maxBins=64, minInstancesPerNode=1.0,
            minWeightFractionPerNode=0.0, featureSubsetStrategy="sqrt", seed=19,
        )


class _Forest:
    """Trees in the making: flat node arrays of each tree."""

    def __init__(self, trees: int):
        self.feature = [[-1] for _ in range(trees)]
        self.bin = [[0] for _ in range(trees)]
        self.left = [[0] for _ in range(trees)]
        self.right = [[0] for _ in range(trees)]

    def positions(self, bins: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """The node of each row after ``depth`` steps; leaves keep theirs."""
        feature, cut, left, right = (np.array(a[tree]) for a in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(bins), dtype=np.int64)
        for _ in range(depth):
            f = feature[at]
            under = bins[np.arange(len(bins)), np.maximum(f, 0)] <= cut[at]
            at = np.where(f < 0, at, np.where(under, left[at], right[at]))
        return at

    def split(self, tree: int, node: int, feature: int, cut: int) -> tuple[int, int]:
        a = len(self.feature[tree])
        self.feature[tree][node], self.bin[tree][node] = feature, cut
        self.left[tree][node], self.right[tree][node] = a, a + 1
        for arrays in (self.feature, self.bin, self.left, self.right):
            arrays[tree] += [-1, -1] if arrays is self.feature else [0, 0]
        return a, a + 1


class ExtraTreesClassifier(Estimator, _ExtraTreesParams, DefaultParamsReadable, DefaultParamsWritable):
    """TRN-5: the estimator; parameters are named as MLlib's forest has them."""

    @keyword_only
    def __init__(
        self, featuresCol="features", labelCol="label", weightCol=None, numTrees=20, maxDepth=5, maxBins=64, minInstancesPerNode=1.0,
        minWeightFractionPerNode=0.0, featureSubsetStrategy="sqrt", seed=19,
    ):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _drawn(self, n: int) -> int:
        ways = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": math.ceil(math.log2(max(n, 2)))}
        return max(1, min(n, ways[self.getOrDefault(self.featureSubsetStrategy)]))

    def _fit(self, dataset: DataFrame) -> "ExtraTreesModel":
        spark = dataset.sparkSession
        ship_code(spark)
        weight = F.col(self.getOrDefault(self.weightCol)).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        rows = dataset.select(
            vector_to_array(self.getOrDefault(self.featuresCol)).alias("x"), F.col(self.getOrDefault(self.labelCol)).cast("double").alias("y"), weight.alias("w")
        ).where("w > 0")
        sample = [r["x"] for r in rows.select("x").orderBy(F.xxhash64("x")).limit(SAMPLE).collect()]
        edges = bin_edges(np.array(sample, dtype=float), self.getOrDefault(self.maxBins))
        binned = materialize(rows.mapInArrow(_binning(edges), "bins binary, y double, w double"), "extra-trees")
        nodes = _grow(
            binned, edges, self.getOrDefault(self.numTrees), self.getOrDefault(self.maxDepth), self._drawn(len(edges)),
            self.getOrDefault(self.minInstancesPerNode), self.getOrDefault(self.minWeightFractionPerNode), self.getOrDefault(self.seed),
        )
        table = materialize(spark.createDataFrame(nodes, f"{NODES}, gain double"), "extra-trees-nodes")
        params = {p.name: v for p, v in self.extractParamMap().items()}
        return ExtraTreesModel(table, numFeatures=len(edges), **params)


class ExtraTreesModel(TableModel, _ExtraTreesParams):
    """Table: ``trees.NODES`` and the gain of each split; adds rawPrediction, probability and prediction."""

    numFeatures = Param(Params._dummy(), "numFeatures", "slots of the feature vector", TypeConverters.toInt)

    def __init__(self, table=None, **params):
        super().__init__(table)
        self._defaults()
        self._set(**params)

    @property
    def featureImportances(self) -> DenseVector:
        """Mean decrease of impurity, adding up to 1."""
        out = np.zeros(self.getOrDefault(self.numFeatures))
        for r in self.table.where("feature >= 0").groupBy("feature").agg(F.sum("gain").alias("g")).collect():
            out[r["feature"]] = r["g"]
        return DenseVector(out / out.sum() if out.sum() else out)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_code(dataset.sparkSession)
        walk = _Walk(self.table)

        @F.arrow_udf("double")
        def score(column: pa.Array) -> pa.Array:
            x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)
            return pa.array(walk.scores(x))

        used = F.transform(F.array(*[F.lit(s) for s in walk.slots]), lambda s: F.get(vector_to_array(self.getOrDefault(self.featuresCol)), s))
        p = F.least(F.greatest(score(used), F.lit(0.0)), F.lit(1.0))
        out = dataset.withColumn("_p", p)
        both = array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p")))
        out = out.withColumn("rawPrediction", both).withColumn("probability", both)
        return out.withColumn("prediction", F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0)).drop("_p")


class _Walk:
    """The node table as arrays, trees one after the other."""

    def __init__(self, table: DataFrame):
        rows = sorted(table.collect(), key=lambda r: (r["tree"], r["node"]))
        place = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
        self.slots = sorted({r["feature"] for r in rows if r["feature"] >= 0}) or [0]
        at = {s: i for i, s in enumerate(self.slots)}
        self.roots = np.array([place[r["tree"], r["node"]] for r in rows if r["node"] == 0])
        inner = [r["feature"] >= 0 for r in rows]
        self.feature = np.array([at[r["feature"]] if f else 0 for r, f in zip(rows, inner)])
        self.cut = np.array([r["cut"] if f else np.inf for r, f in zip(rows, inner)])
        self.left = np.array([place[r["tree"], r["left"]] if f else i for i, (r, f) in enumerate(zip(rows, inner))])
        self.right = np.array([place[r["tree"], r["right"]] if f else i for i, (r, f) in enumerate(zip(rows, inner))])
        self.value = np.array([0.0 if f else r["value"] for r, f in zip(rows, inner)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        while True:
            to = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            if (to == at).all():
                return self.value[at].sum(axis=1)
            at = to


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts of each feature between values of the sample, at most ``bins`` - 1."""
    out = []
    for f in range(x.shape[1] if x.ndim == 2 else 0):
        values = np.unique(x[:, f])
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) > bins - 1:
            middles = middles[np.unique(np.linspace(0, len(middles) - 1, bins - 1).round().astype(int))]
        out.append(middles)
    return out


def _binning(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), batch.column(1), batch.column(2)], ["bins", "y", "w"])

    return run


def _counting(forest: _Forest, slots: list[tuple[int, int]], drawn: np.ndarray, depth: int, n_features: int, width: int):
    """Weights by cell (slot, drawn feature, bin, class) of the rows of a task."""
    by_tree: dict[int, list[tuple[int, int]]] = {}
    for k, (tree, node) in enumerate(slots):
        by_tree.setdefault(tree, []).append((k, node))
    per_slot = drawn.shape[1] * width * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(slots) * per_slot)
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u2").reshape(batch.num_rows, n_features).astype(np.int64)
            y, w = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            for tree, mine in by_tree.items():
                at = forest.positions(bins, tree, depth)
                slot_of = np.full(len(forest.feature[tree]), -1)
                slot_of[[node for _, node in mine]] = [k for k, _ in mine]
                slot = slot_of[at]
                here = np.flatnonzero(slot >= 0)
                s = slot[here]
                for j in range(drawn.shape[1]):
                    cell = ((s * drawn.shape[1] + j) * width + bins[here, drawn[s, j]]) * 2 + y[here]
                    total += np.bincount(cell, w[here], len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "weight"])

    return run


def _best_cut(counts: np.ndarray, features: np.ndarray, edges: list[np.ndarray], draws: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best of the random cuts; counts are drawn features x bins x classes."""
    best = None
    for j, f in enumerate(features.tolist()):
        n = counts[j].sum(axis=1)
        there = np.flatnonzero(n)
        if len(there) < 2:
            continue
        a, b = int(there[0]), int(there[-1])
        inside = edges[f][a:b]  # the cuts that leave rows on both sides
        value = inside[0] + draws[j] * (inside[-1] - inside[0])
        cut = a + max(int(np.searchsorted(inside, value, "right")) - 1, 0)
        left, right = counts[j, : cut + 1].sum(axis=0), counts[j, cut + 1 :].sum(axis=0)
        if min(left.sum(), right.sum()) < least or not left.sum() or not right.sum():
            continue
        gain = gini(left + right) - gini(left) - gini(right)
        if best is None or gain > best[0]:
            best = gain, f, cut
    return best


def gini(counts: np.ndarray) -> float:
    """Weight times Gini impurity."""
    n = counts.sum()
    return float(n - (counts**2).sum() / n) if n else 0.0


def _grow(
    binned: DataFrame, edges: list[np.ndarray], trees: int, depth: int, drawn: int, least: float, least_share: float, seed: int
) -> list[tuple]:
    """Rows of the node table with gains."""
    got = {r["y"]: r["n"] for r in binned.groupBy("y").agg(F.sum("w").alias("n")).collect()}
    if set(got) - {0.0, 1.0}:
        raise ValueError(f"classes must be 0 and 1, not {sorted(got)}")
    all_counts = np.array([got.get(0.0, 0.0), got.get(1.0, 0.0)])
    least = max(least, least_share * all_counts.sum())
    forest = _Forest(trees)
    counts = {(t, 0): all_counts for t in range(trees)}
    gains: dict[tuple[int, int], float] = {}
    frontier = [(t, 0) for t in range(trees)] if all_counts.min() > 0 and edges else []
    width = max((len(e) for e in edges), default=0) + 1
    for level in range(depth):
        below = []
        room = max(1, CELLS // (drawn * width * 2))
        for i in range(0, len(frontier), room):
            slots = frontier[i : i + room]
            rngs = [np.random.default_rng([seed, t, node]) for t, node in slots]
            features = np.array([rng.choice(len(edges), drawn, replace=False) for rng in rngs])
            draws = np.array([rng.random(drawn) for rng in rngs])
            run = _counting(forest, slots, features, level, len(edges), width)
            cells = binned.mapInArrow(run, "cell long, weight double").groupBy("cell").agg(F.sum("weight").alias("weight")).toArrow()
            table = np.zeros(len(slots) * drawn * width * 2)
            table[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
            table = table.reshape(len(slots), drawn, width, 2)
            for k, (t, node) in enumerate(slots):
                best = _best_cut(table[k], features[k], edges, draws[k], least)
                if best is None:
                    continue
                gain, f, cut = best
                j = int(np.flatnonzero(features[k] == f)[0])
                left, right = table[k, j, : cut + 1].sum(axis=0), table[k, j, cut + 1 :].sum(axis=0)
                a, b = forest.split(t, node, f, cut)
                gains[t, node] = float(gain / all_counts.sum())
                counts[t, a], counts[t, b] = left, right
                below += [(t, c) for c in (a, b) if counts[t, c].min() > 0]
        frontier = below
        if not frontier:
            break
    rows = []
    for (t, node), n in sorted(counts.items()):
        f = forest.feature[t][node]
        share = float(n[1] / n.sum() / trees) if n.sum() else 0.0
        if f < 0:
            rows.append((t, node, -1, None, None, -1, -1, share, float(n.sum()), None))
        else:
            cut = float(edges[f][forest.bin[t][node]])
            rows.append((t, node, f, cut, None, forest.left[t][node], forest.right[t][node], None, float(n.sum()), gains[t, node]))
    return rows


