"""Exact two-sample p-values, Poisson bootstrap weights, permutations by bijection."""

import itertools
import math

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from attrix.functions.stats import KS_EXACT, ks_exact_pvalue, ks_pvalue
from attrix.operators import explain as xp
from attrix.operators import train as tr
from attrix.operators.extra_trees import ExtraTreesClassifier


def enumerated(n1, n2):
    """{statistic * n1 * n2: P(D >= it)} over all orders of the two samples."""
    found = []
    for places in itertools.combinations(range(n1 + n2), n1):
        a = b = most = 0
        for k in range(n1 + n2):
            a, b = (a + 1, b) if k in places else (a, b + 1)
            most = max(most, abs(a * n2 - b * n1))
        found.append(most)
    return {d: sum(x >= d for x in found) / len(found) for d in set(found)}


def test_exact_p_value_equals_enumeration(spark):
    rows, want = [], []
    for n1, n2 in [(1, 1), (1, 8), (2, 3), (3, 3), (5, 4), (6, 8), (8, 8), (8, 7)]:
        for d, p in enumerated(n1, n2).items():
            rows.append((d / (n1 * n2), n1, n2))
            want.append(p)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d double, n1 int, n2 int")
    got = [r["p"] for r in df.select("i", ks_exact_pvalue("d", "n1", "n2").alias("p")).orderBy("i").collect()]
    assert got == pytest.approx(want, abs=1e-12)
    assert [r["p"] for r in df.select("i", ks_pvalue("d", "n1", "n2").alias("p")).orderBy("i").collect()] == pytest.approx(want, abs=1e-12)


def test_large_samples_keep_the_series_and_edges(spark):
    rows = [(0.5, 80, 120), (0.12, 100, 100), (0.12, 101, 100), (0.01, 50_000, 70_000), (None, 5, 5), (0.0, 4, 4), (1.0, 4, 4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d double, n1 int, n2 int")
    got = [r["p"] for r in df.select("i", ks_pvalue("d", "n1", "n2").alias("p")).orderBy("i").collect()]
    assert KS_EXACT == 10_000 and got[0] < 1e-9 and abs(got[1] - got[2]) < 0.1 and got[4] is None
    assert got[5] == 1.0 and got[6] == pytest.approx(2 / math.comb(8, 4))


def test_poisson_weights_follow_the_distribution(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "key").select("key", tr.poisson_weight("key", 3).alias("w"), tr.poisson_weight("key", F.lit(4)).alias("v"))
    n = {r["w"]: r["count"] for r in rows.groupBy("w").count().collect()}
    for k in range(4):
        assert n[float(k)] / 20_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.012)
    assert abs(rows.stat.corr("w", "v")) < 0.03


@pytest.mark.parametrize(
    "maker,options", [(DecisionTreeClassifier, {"maxDepth": 4}), (LogisticRegression, {"maxIter": 5}), (ExtraTreesClassifier, {"numTrees": 3, "maxDepth": 3})], ids=["tree", "linear", "extra"]
)
def test_refits_don_t_depend_on_how_the_rows_lie(spark, maker, options):
    model = maker(**options)
    rows = spark.range(400).selectExpr("id AS key", "CAST(id % 17 AS DOUBLE) AS a", "CAST((id * 7) % 23 AS DOUBLE) AS b", "CAST((id % 17 + (id * 13) % 5) % 3 = 0 AS INT) AS label")
    test = rows.where("key % 4 = 0")
    pipe = tr.build_pipeline(model, numeric=["a", "b"], categorical=[], num_percentile=100)

    def predicted(train):
        return sorted(map(tuple, tr.bootstrap_predictions(train, test, "key", pipe, rounds=2).collect()))

    first = predicted(rows.where("key % 4 <> 0"))
    assert predicted(rows.where("key % 4 <> 0").repartition(7, "b")) == first
    by_round = [{k: p for k, _, r, p in first if r == i} for i in range(2)]
    assert len(by_round[0]) == 100 and (maker is LogisticRegression or by_round[0] != by_round[1])


def test_models_without_weights_are_refused(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(10).selectExpr("id AS key", "CAST(id % 2 AS INT) AS label")
    with pytest.raises(TypeError):
        tr.bootstrap_predictions(rows, rows, "key", tr.Pipeline(stages=[VectorAssembler(inputCols=["key"], outputCol="features")]), rounds=1)
    assert GBTClassifier().hasParam("weightCol")


@pytest.mark.parametrize("n", [1, 2, 12, 97, 100, 3_000_000_000])
def test_slots_are_permuted(n):
    found = xp.slot_bijections(["a", "b"], 3, n)
    assert len(found) == 6 and all(math.gcd(a, n) == 1 and a * n < 2**63 and 0 <= b < n for _, _, a, b in found)
    if n <= 100:
        for _, _, a, b in found:
            assert sorted((s * a + b) % n for s in range(n)) == list(range(n))


def test_permutation_importance_matches_a_loop(spark):
    rows = [(k, int(k % 3 == 0), float(k % 7), float((k * 5) % 11)) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, label int, a double, b double")
    score = xp.expr_scorer(lambda: 1 / (1 + F.exp(-(F.col("a") * 0.3 - F.col("b") * 0.1))))
    got = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in xp.permutation_importance(df, "key", "label", ["a", "b"], score, repeats=4).collect()}

    def loss(triples):
        ps = [(y, 1 / (1 + math.exp(-(a * 0.3 - b * 0.1)))) for y, a, b in triples]
        return sum(math.log(p if y else 1 - p) for y, p in ps) / len(ps)

    base = loss([r[1:] for r in rows])
    for at, name in ((2, "a"), (3, "b")):
        drops = []
        for _, _, a, b in (x for x in xp.slot_bijections(["a", "b"], 4, 60) if x[0] == name):
            moved = [list(r[1:]) for r in rows]
            for s in range(60):
                moved[(s * a + b) % 60][at - 1] = rows[s][at]
            drops.append(base - loss(moved))
        mean = sum(drops) / 4
        std = math.sqrt(sum((d - mean) ** 2 for d in drops) / 4)
        assert got[name] == (pytest.approx(mean), pytest.approx(std))


def test_a_failed_refit_is_named(spark):
    rows = spark.range(60).selectExpr("id AS key", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b", "CAST(id % 2 AS INT) AS label")

    def make(cols):
        if "b" not in cols:
            raise ValueError("no b")
        return tr.build_pipeline(DecisionTreeClassifier(maxDepth=2), numeric=list(cols), categorical=[], num_percentile=100)

    with pytest.warns(UserWarning, match="without b"):
        got = dict(xp.drop_column_importance(rows, rows, "label", ["a", "b"], make))
    assert got["b"] == 0.0 and got["a"] != 0.0
