import numpy as np
import pytest

from tabscry.operators.similarity import semantic_join, semantic_join_lsh


def vectors(spark, seed, n=400, copies=True):
    """Clustered vectors of which a third are copies of one, plus a zero and a missing one."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.25 * rng.normal(size=(n, 16))
    if copies:
        x[: n // 3] = centres[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(n, [0.0] * 16), (n + 1, None)]
    return spark.createDataFrame(rows, "vid long, v array<double>"), x


def brute(a, b, threshold):
    ua, ub = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    return set(zip(*[z.tolist() for z in np.nonzero(ua @ ub.T >= threshold)]))


@pytest.mark.parametrize("threshold", [0.35, 0.8, 0.97])
@pytest.mark.parametrize("block_rows", [50, 5000])
def test_exact_join_equals_brute_force(spark, threshold, block_rows):
    left, a = vectors(spark, 5)
    right, b = vectors(spark, 6, n=300)
    out = semantic_join(left, right, "vid", "vid", "v", threshold, how="inner", pivots=6, block_rows=block_rows)
    rows = out.collect()
    got = {(x["left_vid"], x["right_vid"]) for x in rows}
    assert got == brute(a, b, threshold) and len(rows) == len(got)


def test_left_join_keeps_unmatched(spark):
    left, a = vectors(spark, 5, n=60)
    right, _ = vectors(spark, 6, n=60)
    out = semantic_join(left, right.limit(0), "vid", "vid", "v", 0.9).collect()
    assert len(out) == 62 and all(x["right_vid"] is None for x in out)
    matched = {x["left_vid"] for x in semantic_join(left, left, "vid", "vid", "v", 0.9).collect() if x["right_vid"] is not None}
    assert matched == set(range(60))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_every_kind_of_join(spark, how):
    left, a = vectors(spark, 5, n=60)
    right, b = vectors(spark, 7, n=40, copies=False)
    pairs = brute(a, b, 0.9)
    want = set(pairs)
    if how in ("left", "full"):
        want |= {(i, None) for i in range(62) if i not in {x for x, _ in pairs}}
    if how in ("right", "full"):
        want |= {(None, j) for j in range(42) if j not in {y for _, y in pairs}}
    rows = semantic_join(left, right, "vid", "vid", "v", 0.9, how=how).collect()
    assert {(x["left_vid"], x["right_vid"]) for x in rows} == want and len(rows) == len(want)
    none = {(x["left_vid"], x["right_vid"]) for x in semantic_join(left.limit(0), right, "vid", "vid", "v", 0.9, how=how).collect()}
    assert none == ({(None, j) for j in range(42)} if how in ("right", "full") else set())


def test_unknown_join_is_refused(spark):
    left, _ = vectors(spark, 5, n=5)
    with pytest.raises(ValueError, match="how"):
        semantic_join(left, left, "vid", "vid", "v", 0.9, how="outer-ish")


def test_vectors_that_are_not_finite_match_nothing(spark):
    rows = [(0, [1.0, 0.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vid long, v array<double>")
    got = {(x["left_vid"], x["right_vid"]) for x in semantic_join(df, df, "vid", "vid", "v", 0.9, how="inner").collect()}
    assert got == {(0, 0), (0, 4), (4, 0), (4, 4)}


def test_lsh_join_returns_right_pairs_only(spark):
    left, a = vectors(spark, 5)
    right, b = vectors(spark, 6)
    want = brute(a, b, 0.9)
    got = {(x["left_vid"], x["right_vid"]) for x in semantic_join_lsh(left, right, "vid", "vid", "v", 0.9).collect()}
    assert got <= want
    assert len(got) / len(want) > 0.9


def test_pairs_without_copies_are_not_shuffled(spark):
    left, a = vectors(spark, 5, n=60, copies=False)
    out = semantic_join(left, left, "vid", "vid", "v", 0.35)
    plan = out._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Join" not in above and "Exchange" not in above
    rows = {(x["left_vid"], x["right_vid"]) for x in out.collect()}
    assert rows == brute(a, a, 0.35) | {(60, None), (61, None)}


@pytest.mark.parametrize("tables, width", [(12, 1.5), (2, 0.05)])
def test_lsh_join_meets_in_blocks(spark, tables, width):
    left, a = vectors(spark, 5, n=120)
    out = semantic_join_lsh(left, left, "vid", "vid", "v", 0.35, tables=tables, width=width)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    rows = [(x["left_vid"], x["right_vid"]) for x in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= brute(a, a, 0.35) and {(i, i) for i in range(120)} <= set(rows)
