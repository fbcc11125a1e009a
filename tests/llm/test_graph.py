"""Connected components: right roots, and no more jobs and stages than stars that are already settled need."""

import uuid

import numpy as np
import pytest

from tabscry.llm import neardup
from tabscry.llm.graph import components


def links(spark, pairs):
    return spark.createDataFrame(pairs, "a bigint, b bigint")


def roots(pairs):
    sets = neardup.Union()
    for a, b in pairs:
        sets.join(a, b)
    return {x: sets.root(x) for x in list(sets.up)}


def jobs(spark, run):
    """The number of jobs of a run."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("kind", ["chain", "star", "random", "copies", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(7)
    pairs = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(100, i) for i in range(60)] + [(200, 201)],
        "random": [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2)) if a != b],
        "copies": [(3, 1), (1, 3), (3, 1), (5, 3), (9, 9), (7, 8)],
        "none": [],
    }[kind]
    got = [(r["node"], r["component"]) for r in components(links(spark, pairs)).collect()]
    assert sorted(got) == sorted(roots((a, b) for a, b in pairs if a != b).items())


def test_settled_stars_take_one_round(spark):
    # One round of two stars, its check, and two writes; a second round that changes nothing would pass this bound.
    pairs = [(100, i) for i in range(60)] + [(200, 201)]
    assert jobs(spark, lambda: components(links(spark, pairs))) <= 16
