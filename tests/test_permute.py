"""Permutations by hash in rounds: hashes, ranks over buckets, rows as they were, and the disk."""

import hashlib
import math
import os
import time

import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from attrix.operators import explain as xp
from attrix.operators import permute as pm
from attrix.operators.kernels import hash_order

SCORE = xp.expr_scorer(lambda: 1 / (1 + F.exp(-(F.col("a") * 0.03 - F.col("b") * 0.1))))


def h60(*parts):
    return int(hashlib.md5("-".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:15], 16)


def importance(df, **options):
    out = xp.permutation_importance(df, "key", "label", ["a", "b"], SCORE, shuffle="hash", **options)
    return {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in out.collect()}


def loop(rows, repeats):
    """The same by a plain loop; rows (key, label, a, b) are in the order of keys, ties in this order."""

    def loss(rows):
        # without a score the probability is the least there is
        ps = [(y, 1e-15 if a is None or b is None else 1 / (1 + math.exp(-(a * 0.03 - b * 0.1)))) for _, y, a, b in rows]
        return sum(math.log(p if y else 1 - p) for y, p in ps) / len(ps)

    out = {}
    for at, name in ((2, "a"), (3, "b")):
        drops = []
        for rep in range(repeats):
            moved = [list(r) for r in rows]
            for rank, i in enumerate(sorted(range(len(rows)), key=lambda i: h60(rows[i][0], name, rep))):
                moved[i][at] = rows[rank][at]
            drops.append(loss(rows) - loss(moved))
        mean = sum(drops) / repeats
        out[name] = (pytest.approx(mean), pytest.approx(math.sqrt(sum((d - mean) ** 2 for d in drops) / repeats)))
    return out


def test_hashes_of_texts():
    texts = [None, "", "a", "-1", "é" * 20, "x" * 55, "x" * 60, "y" * 130] + ["k" * i for i in range(70)] + [str(i * 37) for i in range(20_000)]
    for part in (pa.array(texts), pa.array(texts).slice(3, 40), pa.array([], pa.string()), pa.array([None], pa.string())):
        k = pm.KeyTexts(part)
        for ends in (("num_a", 3), ("", 0), ("b" * 40, 11), ("ü", 10)):
            assert k.hashes(*ends).tolist() == [h60(t, *ends) for t in part.to_pylist()]


def test_hashes_are_those_of_hash_order(spark):
    df = spark.sql("SELECT id * 7919 - 20 AS k, CAST(id AS DOUBLE) / 3 AS d, IF(id % 3 = 0, NULL, concat('c-', id)) AS s FROM range(50)")
    for c in df.columns:
        rows = df.select(F.col(c).cast("string").alias("t"), hash_order(F.col(c), F.lit("num_a"), F.lit(4)).alias("h")).collect()
        assert pm.KeyTexts(pa.array([r["t"] for r in rows], pa.string())).hashes("num_a", 4).tolist() == [r["h"] for r in rows]


@pytest.mark.parametrize("copies, bucket", [(1, 1 << 18), (1, 300), (11_000, 1000), (1 << 25, 700)])
def test_rounds_and_buckets_match_a_loop(spark, monkeypatch, copies, bucket):
    # keys of many lengths, some values missing, more rows than a kept block has
    rows = [(k * k - 50, int(k % 3 == 0), None if k % 17 == 5 else float(k % 7), float((k * 5) % 11)) for k in range(5000)]
    monkeypatch.setattr(pm, "COPIES", copies)
    monkeypatch.setattr(pm, "PERMUTATIONS", 1)
    monkeypatch.setattr(pm, "BUCKET", bucket)
    monkeypatch.setattr(pm, "GATHERED", 6000)
    df = spark.createDataFrame(rows, "key long, label int, a double, b double").repartition(5)
    assert importance(df, repeats=3) == loop(sorted(rows, key=lambda r: r[0]), 3)


def test_keys_of_equal_rows_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(pm, "COPIES", 1)
    monkeypatch.setattr(pm, "PERMUTATIONS", 1)
    monkeypatch.setattr(pm, "BUCKET", 8)
    # rows that share a key are equal, so their order doesn't matter
    rows = [(None, 1, 2.0, 3.0)] * 2 + [(f"c-{k // 4:03d}", int(k % 12 < 4), float(k // 4 % 7), float(k // 4 * 5 % 11)) for k in range(80)]
    df = spark.createDataFrame(rows, "key string, label int, a double, b double")
    assert importance(df, repeats=2) == loop(rows, 2)


def test_no_rows(spark):
    assert importance(spark.createDataFrame([], "key long, label int, a double, b double"), repeats=2) == {}


def test_other_columns_pass_through_as_they_were(spark, monkeypatch):
    monkeypatch.setattr(pm, "COPIES", 1)
    monkeypatch.setattr(pm, "PERMUTATIONS", 1)
    monkeypatch.setattr(pm, "BUCKET", 16)
    df = spark.range(100).selectExpr(
        "id AS key", "CAST(id % 2 AS INT) AS label", "CAST(id AS INT) AS a", "CAST(id AS DOUBLE) AS b", "concat('t', id) AS text",
        "array(id, NULL) AS list", "TIMESTAMP_NTZ '2024-01-01' AS seen", "DATE '2024-01-01' AS day", "named_struct('x', id) AS deep", "CAST(id AS DECIMAL(20, 2)) AS price",
    )
    df = VectorAssembler(inputCols=["b"], outputCol="vector").transform(df)
    seen = []

    def score(frame):
        seen.append(frame)
        return frame.withColumn("_score", F.lit(0.5))

    xp.permutation_importance(df, "key", "label", ["a", "b"], score, repeats=2, shuffle="hash").collect()
    want = {r["key"]: r for r in df.collect()}
    assert len(seen) == 5
    for frame in seen[1:]:
        rows = frame.collect()
        moved = {"a": "a", "b": "b"}[("a" if sorted(r["b"] for r in rows if r["b"] == r["key"]) == [float(i) for i in range(100)] else "b")]
        assert sorted(r["key"] for r in rows) == sorted(want) and sorted(r[moved] for r in rows) == [float(i) for i in range(100)]
        assert {f.name: f.dataType for f in frame.schema.fields if f.name in df.columns and f.name != "a"} == {f.name: f.dataType for f in df.schema.fields if f.name != "a"}
        for r in rows:
            assert all(r[c] == want[r["key"]][c] for c in df.columns if c != moved)


def test_the_files_of_a_round_go_with_it(spark, monkeypatch):
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        found = {}
        for top in dirs:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.startswith("shuffle_"):
                        try:
                            found[f"{folder}/{n}"] = os.path.getsize(f"{folder}/{n}")
                        except OSError:
                            pass
        return found

    monkeypatch.setattr(pm, "COPIES", 1)
    monkeypatch.setattr(pm, "PERMUTATIONS", 1)
    df = spark.range(40_000).selectExpr("id AS key", "CAST(id % 3 = 0 AS INT) AS label", "rand(1) AS a", "rand(2) AS b")
    old = set(shuffled())
    assert len(importance(df, repeats=6)) == 2
    for _ in range(40):
        # 9.2 MB stayed when all copies were exchanged in one job
        left = sum(size for f, size in shuffled().items() if f not in old)
        if left < 200_000:
            break
        time.sleep(0.25)
    assert left < 200_000
