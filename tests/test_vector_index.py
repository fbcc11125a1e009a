"""The inverted file: only right pairs, few comparisons, recall against the exact join."""

import numpy as np
import pytest

from tabscry.operators.similarity import semantic_join
from tabscry.operators.vector_index import build_index, compared_share, semantic_join_ivf


def planted(spark, n=3000, dims=64, seed=0):
    """Random vectors, a third of them within a cosine of 0.8 to 0.99 of another one, some copies, a zero and a missing one."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(n // 3):
        noise = rng.normal(size=dims)
        noise -= (noise @ x[i]) * x[i]
        t = rng.uniform(0.8, 0.99)
        x[n - 1 - i] = t * x[i] + np.sqrt(1 - t * t) * noise / np.linalg.norm(noise)
    if n > 160:
        x[100:160] = x[100]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, (n, [0.0] * dims), (n + 1, None)], "vid long, v array<double>")


def test_recall_and_share(spark):
    df = planted(spark).cache()
    exact = {(r[0], r[1]): r[2] for r in semantic_join(df, df, "vid", "vid", "v", 0.8, how="inner").collect()}
    found = {(r[0], r[1]): r[2] for r in semantic_join_ivf(df, df, "vid", "vid", "v", 0.8, how="inner", cells=400, probes=16).collect()}
    assert found.items() <= exact.items()
    others = {p for p in exact if p[0] != p[1] and not (100 <= p[0] < 160 and 100 <= p[1] < 160)}
    assert len(others) > 1500 and len(others & found.keys()) >= 0.9 * len(others)
    assert compared_share(df, "vid", "v", build_index(df, "vid", "v", 400), 16) < 0.05


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("block_rows", [40, 2000])
def test_all_cells_visited_is_exact(spark, how, block_rows):
    a, b = planted(spark, 300, 16, 1), planted(spark, 200, 16, 1)
    want = sorted(map(repr, semantic_join(a, b, "vid", "vid", "v", 0.7, how=how).collect()))
    got = sorted(map(repr, semantic_join_ivf(a, b, "vid", "vid", "v", 0.7, how=how, cells=9, probes=9, block_rows=block_rows).collect()))
    assert got == want


def test_empty_sides(spark):
    a = planted(spark, 30, 8)
    assert semantic_join_ivf(a, a.limit(0), "vid", "vid", "v", 0.9).count() == 32
    assert semantic_join_ivf(a.limit(0), a, "vid", "vid", "v", 0.9, how="inner").count() == 0
    with pytest.raises(ValueError):
        semantic_join_ivf(a, a, "vid", "vid", "v", 0.9, how="cross")
