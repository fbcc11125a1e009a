"""The join of text columns against brute force: both measures, all kinds, copies, missing and empty texts."""

import re

import numpy as np
import pytest

from tabscry.operators.text_join import text_join


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(left, right, percent, measure, n, how):
    out = set()
    for i, a in left:
        for j, b in right:
            x, y = grams(a, n), grams(b, n)
            whole = len(y) if measure == "containment" else len(x | y)
            if x and y and 100 * len(x & y) >= percent * whole:
                out.add((i, j, round(len(x & y) / whole, 6)))
    lefts, rights = {i for i, _, _ in out}, {j for _, j, _ in out}
    if how in ("left", "full"):
        out |= {(i, None, None) for i, _ in left if i not in lefts}
    if how in ("right", "full"):
        out |= {(None, j, None) for j, _ in right if j not in rights}
    return out


def texts(seed, n, vocabulary=40):
    rng = np.random.default_rng(seed)
    return [" ".join(f"W{x}" for x in np.minimum(rng.zipf(1.4, rng.integers(0, 25)), vocabulary)) for _ in range(n)]


LEFT = [(i, t) for i, t in enumerate([*texts(1, 120), *["w1 w2 w3 W4 w5"] * 40, None, "", " \t", "é ☃"])]
RIGHT = [(i, t) for i, t in enumerate([*texts(2, 60), "w1 w2 w3 w4 w5", "w1\nw2 w3 w4 w9", None, "", "É ☃", "é ☃"])]


@pytest.mark.parametrize(("measure", "percent", "n"), [("jaccard", 30, 1), ("jaccard", 80, 2), ("jaccard", 100, 1), ("containment", 50, 2), ("containment", 75, 1), ("containment", 1, 3)])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_equals_brute_force(spark, measure, percent, n, how):
    left = spark.createDataFrame([(i, t, 1, 2.0) for i, t in LEFT], "doc long, text string, size int, items double")
    right = spark.createDataFrame([(i, t, 1) for i, t in RIGHT], "item long, text string, held int")
    rows = text_join(left, right, "doc", "item", "text", "text", percent, measure, n, how).collect()
    got = {tuple(r) for r in rows}
    assert len(rows) == len(got) and got == brute(LEFT, RIGHT, percent, measure, n, how)


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, "a b")], "doc long, text string")
    right = left.withColumnRenamed("doc", "item")
    none = lambda how, a, b: [tuple(r) for r in text_join(a, b, "doc", "item", "text", "text", 50, how=how).collect()]
    assert none("left", left, right.limit(0)) == [(1, None, None)] and none("right", left.limit(0), right) == [(None, 1, None)]
    assert none("inner", left.limit(0), right) == [] and none("full", left.limit(0), right.limit(0)) == []


def test_plan_compares_no_all_pairs(spark):
    left = spark.createDataFrame(LEFT, "doc long, text string")
    right = spark.createDataFrame(RIGHT, "item long, text string")
    plan = text_join(left, right, "doc", "item", "text", "text", 60)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


@pytest.mark.parametrize("wrong", [{"how": "cross"}, {"measure": "cosine"}, {"percent": 0}])
def test_wrong_arguments_are_refused(spark, wrong):
    df = spark.createDataFrame([(1, "a")], "k long, text string")
    with pytest.raises(ValueError):
        text_join(df, df, "k", "k", "text", "text", **{"percent": 50, **wrong})
