"""What the explanation operators send where, and their results against plain loops."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from attrix.operators import explain as xp
from attrix.operators.windows import head_hash_ordered


def h60(*parts):
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("explain") / "rows")
    rows = spark.range(3000).selectExpr("id AS key", "CAST(id % 3 = 0 AS INT) AS label", "CAST(id * 7 % 101 AS DOUBLE) AS a", "CAST(id * 5 % 37 AS DOUBLE) AS b")
    rows.write.parquet(path)
    return spark.read.parquet(path)


SCORE = xp.expr_scorer(lambda: 1 / (1 + F.exp(-(F.col("a") * 0.03 - F.col("b") * 0.1))))


def test_sampled_shapley_broadcasts_the_background_and_not_the_rows(frame):
    out = xp.sampled_shapley(frame, "key", ["a", "b"], SCORE, head_hash_ordered(frame, "key", 100))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "BroadcastHashJoin [_bid" in join and "BuildRight" in join, join


def test_sampled_shapley_matches_a_loop(frame):
    f = lambda a, b: 1 / (1 + math.exp(-(a * 0.03 - b * 0.1)))
    back = sorted((r["b"], r["a"]) for r in head_hash_ordered(frame, "key", 20).collect())
    got = {(r["key"], r["feature"]): r["shap"] for r in xp.sampled_shapley(frame, "key", ["b", "a"], SCORE, head_hash_ordered(frame, "key", 20), 4).collect()}
    assert len(got) == 6000
    for r in frame.where("key < 50").collect():
        want = {"a": 0.0, "b": 0.0}
        for p in range(4):
            now = dict(zip("ba", back[h60(r["key"], p) % 20]))
            for c in sorted("ab", key=lambda c: (h60(r["key"], p, c), c)):
                before = f(**now)
                now[c] = r[c]
                want[c] += (f(**now) - before) / 4
        assert {c: got[r["key"], c] for c in "ab"} == pytest.approx(want)


def test_density_is_the_exact_sum(spark):
    from attrix.operators import evaluate as ev

    data = [(g, ((i * 37) % 101) ** 1.5 + (g == "b")) for i in range(150) for g in "ab"]
    got = ev.density_points(spark.createDataFrame(data, "g string, v double"), "v", ["g"]).collect()
    assert len(got) == 400
    for g in "ab":
        x = [v for h, v in data if h == g]
        mean = sum(x) / len(x)
        bw = math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1)) * len(x) ** -0.2
        for r in got:
            if r["g"] == g:
                exact = sum(math.exp(-0.5 * ((r["x"] - v) / bw) ** 2) for v in x) / (len(x) * bw * math.sqrt(2 * math.pi))
                assert r["density"] == pytest.approx(exact, rel=1e-9)


def test_permutations_in_the_order_of_hashes_match_a_loop(spark):
    rows = [(k * 3, int(k % 3 == 0), float(k % 7), float((k * 5) % 11)) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, label int, a double, b double")
    got = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in xp.permutation_importance(df, "key", "label", ["a", "b"], SCORE, repeats=4, shuffle="hash").collect()}

    def loss(triples):
        ps = [(y, 1 / (1 + math.exp(-(a * 0.03 - b * 0.1)))) for y, a, b in triples]
        return sum(math.log(p if y else 1 - p) for y, p in ps) / len(ps)

    base = loss([r[1:] for r in rows])
    for at, name in ((2, "a"), (3, "b")):
        drops = []
        for rep in range(4):
            order = sorted(range(60), key=lambda i: h60(rows[i][0], name, rep))
            moved = [list(r[1:]) for r in rows]
            for rank, i in enumerate(order):
                moved[i][at - 1] = rows[rank][at]
            drops.append(base - loss(moved))
        mean = sum(drops) / 4
        assert got[name] == (pytest.approx(mean), pytest.approx(math.sqrt(sum((d - mean) ** 2 for d in drops) / 4)))


def test_rounding_of_many_rows_is_that_of_round(spark):
    import random

    from attrix.plans.common import r6, r6_many

    rng = random.Random(4)
    ties = [s * (k + 0.5) / 1e6 + e for k in (0, 1, 7, 249_999, 10**9, 10**11 + 3) for s in (1, -1) for e in (0.0, 1e-17, -1e-17, 1e-12, -1e-12)]
    values = ties + [rng.uniform(-2, 2) for _ in range(3000)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 18) for _ in range(3000)]
    values += [0.0, -0.0, -1e-9, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    text = lambda d: [(r["i"], repr(r["v"])) for r in d.orderBy("i").collect()]
    assert text(r6_many(df)) == text(r6(df))
