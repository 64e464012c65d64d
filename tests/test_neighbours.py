"""Nearest-neighbour statistics against brute force over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attrix.functions.stats import digamma
from attrix.operators import neighbours as nb
from attrix.operators.explore import mutual_information


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute(points, k):
    """The estimator from whole-number points (point, class)."""
    by = {}
    for p, c in points:
        by.setdefault(c, []).append(p)
    rows = [(p, c) for p, c in points if len(by[c]) > 1]
    rest = 0.0
    for p, c in rows:
        near = min(k, len(by[c]) - 1)
        radius = sorted(abs(p - q) for q in by[c])[near]
        within = sum(abs(p - q) < radius or p == q for q, _ in rows)
        rest += psi(near) - psi(len(by[c])) - psi(within)
    return max(psi(len(rows)) + rest / len(rows), 0.0) if rows else None


def data(n):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        c = rng.choice(["a", "a", "b", "rare" if i < 40 else "a"])
        rows.append((i, c, rng.gauss(0, 1) + 2 * (c == "b"), float(rng.randrange(5)), rng.paretovariate(0.3), 7.0))
    return rows + [(n, "alone", 0.5, 1.0, 1.0, 7.0), (n + 1, "two", 1.0, 1.0, 2.0, 7.0), (n + 2, "two", 2.0, 1.0, 2.0, 7.0)]


NAMES = ["normal", "ties", "heavy", "constant"]


@pytest.mark.parametrize("block", [1 << 16, 16])
def test_information_equals_brute_force_on_2000_rows(spark, monkeypatch, block):
    monkeypatch.setattr(nb, "BLOCK", block)
    df = spark.createDataFrame(data(2000), ["key", "class", *NAMES])
    long = df.unpivot(["key", "class"], NAMES, "attribute", "x")
    got = {r["attribute"]: r["score"] for r in nb.neighbour_information(long).collect()}
    points = nb.on_grid(long, "key").collect()
    assert set(got) == set(NAMES)
    for name in NAMES:
        want = brute([(r["point"], r["class"]) for r in points if r["attribute"] == name], 3)
        assert got[name] == pytest.approx(want, abs=1e-9), name
    assert got["normal"] > 0.15 and got["constant"] < 0.05


def test_grid_keeps_distances_and_order(spark):
    rows = [(i, "c", "f", x) for i, x in enumerate([-1e300, -2.5, -2.5, 0.0, 1e-9, 3.0, 1e300])] + [(i, "c", "g", x) for i, x in enumerate([1.0, 1.5, 2.0])]
    long = spark.createDataFrame(rows, "key long, class string, attribute string, x double")
    got = {(r["attribute"], r["key"]): (r["x"], r["point"]) for r in nb.on_grid(long, "key").collect()}
    for f in "fg":
        points = [p for (a, _), (_, p) in sorted(got.items(), key=lambda e: e[1]) if a == f]
        assert all(0 <= p < nb.GRID * 2 for p in points)
    a, b, c = (got["g", i][1] for i in range(3))
    assert abs((b - a) - (c - b)) < 2 * nb.NOISE


def test_neighbours_of_tiny_groups_and_equal_points(spark):
    rows = [("f", i, "c", p) for i, p in enumerate([5, 5, 5, 5, 5, 9])] + [("f", 10, "d", 5), ("f", 11, "d", 6), ("f", 12, "one", 0)]
    points = spark.createDataFrame(rows, "attribute string, key long, class string, point long")
    near = nb.neighbour_radius(points, ["attribute", "class"], 3)
    got = {r["key"]: (r["size"], r["near"], r["radius"]) for r in near.collect()}
    assert got == {**{i: (6, 3, 0) for i in range(5)}, 5: (6, 3, 4), 10: (2, 1, 1), 11: (2, 1, 1)}
    within = {r["key"]: r["within"] for r in nb.count_within(near, "attribute").collect()}
    assert within == {**{i: 6 for i in range(5)}, 5: 2, 10: 6, 11: 1}


def test_digamma(spark):
    rows = spark.createDataFrame([(i,) for i in [1, 2, 3, 7, 50, 1000]], "n int")
    for r in rows.select("n", digamma(F.col("n")).alias("psi")).collect():
        assert r["psi"] == pytest.approx(psi(r["n"]), abs=1e-11)
    assert math.isclose(rows.select(digamma(F.lit(0.5)).alias("p")).first()["p"], -1.9635100260214235, abs_tol=1e-10)


def test_numeric_nulls_are_imputed_and_empty_columns_go(spark):
    df = spark.createDataFrame([(i, "yes" if i % 3 else "no", None if i % 5 == 0 else float(i), None) for i in range(60)], "key long, target string, x double, gone double")
    got = mutual_information(df, "target", ["target"], ["x", "gone"]).collect()
    assert {r["attribute"] for r in got} == {"x", "target_yes", "target_no"}


def test_no_pairs_are_formed(spark):
    """Bounds are met by running sums: no join of the plan has a range condition."""
    df = spark.createDataFrame(data(50), ["key", "class", *NAMES])
    plan = nb.neighbour_information(df.unpivot(["key", "class"], NAMES, "attribute", "x"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
