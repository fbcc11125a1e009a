import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabscry.operators.quantiles import percentiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def result(df, keys):
    return {tuple(r[k] for k in [*keys, "column_name"]): list(r["q"]) for r in df.collect()}


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("shape", ["uniform", "heavy_tail", "one_hot_value", "two_values", "constant"])
def test_global_percentiles_match_numpy(spark, small, shape):
    rng = np.random.default_rng(7)
    x = {
        "uniform": rng.uniform(0, 1, 20000),
        "heavy_tail": rng.pareto(0.6, 20000),
        "one_hot_value": np.where(rng.uniform(size=20000) < 0.4, 3.0, rng.normal(size=20000)),
        "two_values": np.array([1.0, 5.0]),
        "constant": np.full(1000, 2.5),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = result(percentiles(df, ["x"], PROBS, small=small), [])[("x",)]
    assert got == pytest.approx(np.quantile(x, PROBS).tolist(), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("small", [True, False])
def test_hot_group_is_narrowed_and_cold_groups_are_ranked(spark, small):
    rng = np.random.default_rng(11)
    keys = np.where(rng.uniform(size=30000) < 0.5, 0, rng.integers(1, 200, 30000))
    x = rng.exponential(size=30000)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, x)], "k int, x double")
    got = result(percentiles(df, ["x"], [0.5, 0.9], keys=["k"], small=small, hot_rows=1000), ["k"])
    assert len(got) == len(set(keys.tolist()))
    for k in set(keys.tolist()):
        assert got[(k, "x")] == pytest.approx(np.quantile(x[keys == k], [0.5, 0.9]).tolist(), rel=1e-12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_any_list(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").coalesce(1)
    for small in (True, False):
        got = result(percentiles(df, ["x"], [0.1, 0.5], small=small), [])[("x",)]
        assert got == pytest.approx(np.quantile(values, [0.1, 0.5]).tolist())
