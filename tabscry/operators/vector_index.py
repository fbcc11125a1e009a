"""Join of vectors through an inverted file: each side meets only in the cells that lie nearest.

The centres are fitted on a bounded sample (``sample`` distinct right vectors, by hash), but every vector is indexed. A right
vector belongs to the cell of its nearest centre, a left one visits its ``probes`` nearest cells, so about probes / cells of all pairs
are compared, on whole vectors. Every pair returned is right; pairs in cells that were not visited are missing, the fewer the
higher the threshold. ``semantic_join`` is the exact form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscry.functions.numeric import rounded
from tabscry.operators.similarity import BLOCK_ROWS, HOW, _distinct, _matches, _unit, _with_unmatched

SAMPLE = 20_000
MOST_CELLS = 4096
ROUNDS = 12

c = F.col


def fit_cells(points: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres by spherical k-means; starts from the first points, empty cells keep their centre."""
    centres = points[:cells].copy()
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """Centres of the cells, and the right vectors with their cell."""

    centres: np.ndarray
    keyed: DataFrame
    placed: DataFrame


def build_index(right: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex | None:
    """An inverted file over all distinct right vectors; None over none. ``cells``: the root of their number unless given."""
    keyed = _unit(right, key, vector)
    units = _distinct(keyed)
    n = units.count()
    if not n:
        return None
    chosen = units.orderBy(F.xxhash64("digest")).limit(sample).select("unit").collect()
    points = np.array([row["unit"] for row in chosen])
    wanted = cells or min(MOST_CELLS, int(np.ceil(np.sqrt(n))))
    centres = fit_cells(points, max(1, min(wanted, len(points))))

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series((np.stack(vectors.to_numpy()) @ centres.T).argmax(axis=1).astype("int32"))

    return VectorIndex(centres, keyed, units.withColumn("cell", nearest("unit")))


def probed(units: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """Left vectors, once for each of the cells they visit."""
    centres, k = index.centres, min(probes, len(index.centres))

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        sims = np.stack(vectors.to_numpy()) @ centres.T
        return pd.Series(list(np.argpartition(-sims, k - 1, axis=1)[:, :k].astype("int32")))

    return units.withColumn("cell", F.explode(near("unit")))


def compared_share(left: DataFrame, left_key: str, vector: str, index: VectorIndex, probes: int) -> float:
    """The share of all pairs of distinct vectors that the join compares, from one count per cell."""
    a = _distinct(_unit(left, left_key, vector))
    met = probed(a, index, probes).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(index.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    pairs = met.agg(F.sum(c("n").cast("double") * c("m"))).first()[0] or 0.0
    return pairs / max(1, a.count() * index.placed.count())


def semantic_join_ivf(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    vector: str,
    threshold: float,
    how: str = "left",
    cells: int | None = None,
    probes: int = 8,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs with cosine similarity of at least ``threshold`` in the cells visited: left_<key>, right_<key>, similarity.

    A cell with many vectors is cut into blocks of about ``block_rows`` on either side by digest; the driver sees one
    row per cell. Equal vectors are compared once. Zero, missing and not finite vectors match nothing.
    """
    if how not in HOW:
        raise ValueError(f"how is one of {', '.join(HOW)}, not {how}")
    index = build_index(right, right_key, vector, cells)
    if index is None:
        return _with_unmatched(left, right, left_key, right_key, None, how)
    lv = _unit(left, left_key, vector)
    sent = probed(_distinct(lv), index, probes)
    size = len(index.centres)

    def blocks(df: DataFrame):
        count = np.ones(size, dtype=int)
        for row in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
            count[row["cell"]] = -(-row["n"] // block_rows)
        return F.array(*[F.lit(int(n)) for n in count])[c("cell")]

    lefts, rights = blocks(sent), blocks(index.placed)
    part = F.xxhash64("digest")
    sent = sent.withColumn("lb", F.pmod(part, lefts).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), rights - 1)))
    kept = index.placed.withColumn("rb", F.pmod(part, rights).cast("int")).withColumn("lb", F.explode(F.sequence(F.lit(0), lefts - 1)))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["cell", "lb", "rb"]
    pairs = (
        sent.repartition(tasks, *keys)
        .groupBy(*keys)
        .cogroup(kept.repartition(tasks, *keys).groupBy(*keys))
        .applyInPandas(_matches(threshold), "l string, r string, similarity double")
    )
    matched = (
        pairs.join(lv.select(c("key").alias(f"left_{left_key}"), c("digest").alias("l")), "l")
        .join(index.keyed.select(c("key").alias(f"right_{right_key}"), c("digest").alias("r")), "r")
        .select(f"left_{left_key}", f"right_{right_key}", rounded(c("similarity")).alias("similarity"))
    )
    return _with_unmatched(left, right, left_key, right_key, matched, how)
