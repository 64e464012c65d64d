"""Rule outcomes by a prefix tree against brute force."""

import random

import pytest

from attrix.operators import explore as ex


def brute(rules, baskets, outcomes):
    out = {}
    for a, c in rules:
        held = [outcomes[k] for k, items in baskets.items() if set(a) | set(c) <= items and k in outcomes]
        if held:
            known = [y for y in held if y is not None]
            out[f"{','.join(a)} -> {','.join(c)}"] = (sum(known) / len(known) if known else None, len(held))
    return out


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_outcomes_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(ex, "MAX_TREE_ITEMS", most)
    rng = random.Random(3)
    names = [f"i{n}" for n in range(12)]
    baskets = {k: set(rng.sample(names, rng.randint(1, 9))) | {"hot"} for k in range(300)}
    rules = [(["hot"], ["i1"]), (["i1"], ["hot"]), (["never"], ["i2"])]
    rules += [tuple(sorted(part) for part in (s[:1], s[1:])) for s in (rng.sample([*names, "hot"], rng.randint(2, 4)) for _ in range(25))]
    rules = [list(r) for r in {(tuple(a), tuple(c)) for a, c in rules}]
    outcomes = {k: rng.choice([0.0, 1.0, None]) for k in list(baskets)[:280]}
    got = ex.rule_outcomes(
        spark.createDataFrame(rules, "antecedents array<string>, consequents array<string>"),
        spark.createDataFrame([(k, i) for k, s in baskets.items() for i in s for _ in range(rng.choice([1, 1, 2]))], "key long, item string"),
        spark.createDataFrame(list(outcomes.items()), "key long, y double"),
        "key",
        "item",
        "y",
    )
    want = brute(rules, baskets, outcomes)
    assert {r["rules"]: (pytest.approx(r["outcome"]) if r["outcome"] is not None else None, r["outcome_count"]) for r in got.collect()} == want


def test_tree_enters_only_branches_of_the_basket():
    tree = ex.ItemTree([["a"], ["a", "b"], ["b", "c"], [], ["a", "c", "d"], ["a", "b"]])
    assert sorted(tree.within(["b", "a", "z"])) == [0, 1, 3, 5]
    assert sorted(tree.within(["d", "c", "a"])) == [0, 3, 4] and tree.within([]) == [3]


def test_no_join_on_an_item(spark):
    rules = spark.createDataFrame([(["a"], ["b"])], "antecedents array<string>, consequents array<string>")
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "key long, item string")
    out = ex.rule_outcomes(rules, rows, spark.createDataFrame([(1, 1.0)], "key long, y double"), "key", "item", "y")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "item#" not in plan and out.collect()[0]["outcome_count"] == 1


def test_empty_rules(spark):
    rules = spark.createDataFrame([], "antecedents array<string>, consequents array<string>")
    rows = spark.createDataFrame([(1, "a")], "key long, item string")
    assert ex.rule_outcomes(rules, rows, spark.createDataFrame([(1, 1.0)], "key long, y double"), "key", "item", "y").count() == 0
