"""Metrics, calibration and density from the score table against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attrix.operators import evaluate as ev


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = rng.choice([0.0, 1.0, round(rng.random(), 1), rng.random()])
        out.append((i, int(rng.random() < 0.2 + 0.6 * p), p, rng.choice("ab"), None if rng.random() < 0.1 else rng.gauss(0, 1)))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return ev.predictions_frame(spark.createDataFrame(rows(700), "key long, label int, prob double, g string, x double"))


def loop_metrics(data):
    clip = lambda p: min(max(p, 1e-15), 1 - 1e-15)
    n = len(data)
    tp, fp, fn, tn = (sum(y == a and (p >= 0.5) == b for y, p in data) for a, b in ((1, True), (0, True), (1, False), (0, False)))
    wins = [(0.5 if p == q else float(p > q)) for y, p in data if y for z, q in data if not z]
    return {
        "log_loss": -sum(math.log(clip(p) if y else 1 - clip(p)) for y, p in data) / n,
        "brier_score_loss": sum((p - y) ** 2 for y, p in data) / n,
        "roc_auc": sum(wins) / len(wins),
        "f1": 2 * tp / (2 * tp + fp + fn),
        "balanced_accuracy_score": (tp / (tp + fn) + tn / (tn + fp)) / 2,
    }


def test_metrics_match_a_loop(frame):
    for groups in ([], ["g"]):
        got = {}
        for r in ev.metric_scores(frame, groups=groups).collect():
            got.setdefault(r["g"] if groups else "", {})[r["metric"]] = r["score"]
        for g, scores in got.items():
            data = [(y, p) for _, y, p, h, _ in rows(700) if not groups or h == g]
            assert scores == {m: pytest.approx(v) for m, v in loop_metrics(data).items()}


def test_partitions_match_a_loop(spark, frame):
    features = frame.select("key", "g", "x")
    got = {(r["metric"], r["partition"]): (r["score"], r["observations"]) for r in ev.metrics_by_partition(frame, features, categorical=["g"], numeric=["x"], numeric_bins=4).collect()}
    known = sorted(x for *_, x in rows(700) if x is not None)

    def quantile(q):
        h = (len(known) - 1) * q
        lo = math.floor(h)
        return known[lo] + (h - lo) * (known[min(lo + 1, len(known) - 1)] - known[lo])

    edges = [quantile(q) for q in (0.25, 0.5, 0.75)]
    by = {}
    for _, y, p, g, x in rows(700):
        by.setdefault(f"g_{g}", []).append((y, p))
        by.setdefault("x_nan" if x is None else f"x_q{1 + sum(x > e for e in edges)}", []).append((y, p))
    assert got == {(m, k): (pytest.approx(v), len(data)) for k, data in by.items() for m, v in loop_metrics(data).items()}


def test_calibration_in_one_pass_equals_each_curve(frame):
    both = sorted(map(tuple, ev.calibration_tables(frame, bins=[3, 10]).collect()))
    single = [tuple(r) for n in (3, 10) for s in ("uniform", "quantile") for r in ev.calibration_table(frame, n_bins=n, strategy=s).collect()]
    assert both == sorted(single)
    want = {}
    for _, y, p, *_ in rows(700):
        b = sum(p >= j * (1 + 1e-8) / 10 for j in range(1, 11))
        want.setdefault(b, []).append((y, p))
    got = {r[2]: r[3:] for r in both if r[:2] == (10, "uniform")}
    assert got == {b: (pytest.approx(sum(y for y, _ in d) / len(d)), pytest.approx(sum(p for _, p in d) / len(d)), len(d)) for b, d in want.items()}
    with pytest.raises(ValueError):
        ev.calibration_table(frame, strategy="other")


@pytest.mark.parametrize("values", ["normal", "heavy"])
def test_density_is_within_its_error_of_the_exact_sum(spark, values):
    rng = random.Random(2)
    draw = (lambda: rng.gauss(0, 1)) if values == "normal" else (lambda: rng.paretovariate(3))
    data = [("a", draw()) for _ in range(900)] + [("b", float(rng.randrange(3))) for _ in range(50)] + [("c", 5.0)] * 4
    df = spark.createDataFrame(data, "g string, v double")
    got = ev.density_points(df, "v", ["g"]).collect()
    assert len(got) == 600 and all(r["density"] is None for r in got if r["g"] == "c")
    for g in "ab":
        x = [v for h, v in data if h == g]
        mean = sum(x) / len(x)
        bw = math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1)) * len(x) ** -0.2
        exact = {r["point"]: sum(math.exp(-0.5 * ((r["x"] - v) / bw) ** 2) for v in x) / (len(x) * bw * math.sqrt(2 * math.pi)) for r in got if r["g"] == g}
        peak = max(exact.values())
        assert max(abs(r["density"] - exact[r["point"]]) for r in got if r["g"] == g) < 0.002 * peak


def test_density_work_doesn_t_grow_with_distinct_values(spark):
    df = spark.range(200_000).select((F.randn(1) * 3).alias("v"))
    plan = ev.density_points(df, "v")
    cells = plan.count()
    assert cells == 200


def test_bootstrap_draws_the_smallest_hashes(spark, frame):
    from attrix.operators.kernels import hash_order

    got = {r["metric"]: r for r in ev.bootstrap_scores(frame, samples=5).collect()}
    order = frame.select("key", "label", "prob", *[hash_order(F.col("key"), F.lit(i)).alias(f"h{i}") for i in range(5)]).collect()
    scores = [loop_metrics([(r["label"], r["prob"]) for r in sorted(order, key=lambda r: (r[f"h{i}"], r["key"]))[:140]]) for i in range(5)]
    for m in ev.METRIC_NAMES:
        assert got[m]["mean"] == pytest.approx(sum(s[m] for s in scores) / 5) and got[m]["count"] == 5
