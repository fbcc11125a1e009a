"""Vector similarity of column pairs, and the join of two tables by similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscry.functions.numeric import rounded
from tabscry.session import cut, is_small, spread

PIVOTS = 24
BLOCK_ROWS = 2000
# Blocks of a side, and the bytes up to which a block grows for that.
BLOCKS = 12
BLOCK_BYTES = 64 * 1024 * 1024
# Left rows multiplied with a batch at a time.
CHUNK = 1000
# Share of all pairs from which on cells spare too little.
UNPRUNED = 0.8
SENT_ROWS = 200_000
TABLE_BITS = 48
# Keeps rounding of the angles from dropping a pair.
ANGLE_SLACK = 1e-9
HOW = ("inner", "left", "right", "full")

c = F.col


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, NULL for a zero vector."""
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def cosine_pairs(df: DataFrame, left: str, right: str, name: str = "similarity") -> DataFrame:
    return df.withColumn(name, rounded(cosine(c(left), c(right))))


def _unit(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, unit vector, 128-bit digest of it); zero, missing and not finite vectors drop out."""
    rows = spread(df.select(c(key).alias("key"), c(vector).cast("array<double>").alias("v")))
    rows = rows.withColumn("length", F.sqrt(dot(c("v"), c("v")))).filter((c("length") > 0) & (c("length") < float("inf")))
    units = rows.select("key", F.transform("v", lambda x: x / c("length")).alias("unit"))
    digest = F.concat_ws("-", F.hex(F.xxhash64("unit")), F.hex(F.xxhash64(F.lit(1), c("unit"))))
    return units.withColumn("digest", digest)


def _distinct(units: DataFrame) -> DataFrame:
    """One row per distinct vector."""
    return units.groupBy("digest").agg(F.any_value("unit").alias("unit"))


def _counted(units: DataFrame) -> DataFrame:
    """One row per distinct vector with one of its keys and their number."""
    return units.groupBy("digest").agg(F.any_value("unit").alias("unit"), F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))


def _matches(threshold: float):
    """Compare one bounded block of left vectors with one of right vectors."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"l": [], "r": [], "similarity": []})
        sims = np.stack(left["unit"].to_numpy()) @ np.stack(right["unit"].to_numpy()).T
        i, j = np.nonzero(sims >= threshold)
        return pd.DataFrame(
            {"l": left["digest"].to_numpy()[i], "r": right["digest"].to_numpy()[j], "similarity": sims[i, j]}
        )

    return compare


def _block_rows(n: int, dims: int, block_rows: int) -> int:
    """Rows of a block: at most BLOCKS blocks a side, so copies grow with the rows alone, while a block stays under BLOCK_BYTES."""
    return max(block_rows, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * dims)))


def _compared(lefts: DataFrame, rights: DataFrame, threshold: float, hashed: bool = False) -> DataFrame:
    """(l, r, similarity) of the pairs that meet in a block and reach ``threshold``; both sides: who, unit, cell, lb, rb.

    A task holds one left block and takes the right one batch by batch. With ``hashed`` a pair must share a bucket
    of ``hashes`` too, and in cells of one table (0 and up) it counts only in the first table it shares.
    """
    spark = lefts.sparkSession
    l_type, r_type = lefts.schema["who"].dataType, rights.schema["who"].dataType
    keys = ["cell", "lb", "rb"]
    more = ["hashes"] if hashed else []

    def side(df: DataFrame, number: int) -> DataFrame:
        l = c("who") if number == 0 else F.lit(None).cast(l_type)  # noqa: E741
        r = c("who") if number == 1 else F.lit(None).cast(r_type)
        return df.select(*keys, F.lit(number).alias("side"), l.alias("l"), r.alias("r"), "unit", *more)

    def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def pairs(held: list, right: pa.RecordBatch, table: int):
        units, hashes = matrix(right, "unit"), matrix(right, "hashes") if hashed else None
        for who, block, own in held:
            for at in range(0, len(block), CHUNK):
                sims = block[at : at + CHUNK] @ units.T
                i, j = np.nonzero(sims >= threshold)
                if hashed and len(i):
                    shared = own[at + i] == hashes[j]
                    kept = shared.any(axis=1) & ((table < 0) | (shared.argmax(axis=1) == table))
                    i, j = i[kept], j[kept]
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [who.take(pa.array(at + i)), right.column("r").take(pa.array(j)), pa.array(sims[i, j])], ["l", "r", "similarity"]
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            places = np.stack([batch.column(k).to_numpy() for k in [*keys, "side"]], axis=1)
            cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                *here, which = places[start].tolist()
                part = batch.slice(start, end - start)
                if here != block:
                    block, held = here, []
                if which == 0:
                    held.append((part.column("l"), matrix(part, "unit").copy(), matrix(part, "hashes").copy() if hashed else None))
                else:
                    yield from pairs(held, part, here[0] >> TABLE_BITS if here[0] >= 0 else -1)

    # Blocks are small in bytes but costly, so their partitions are not to be merged.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    both = side(lefts, 0).unionByName(side(rights, 1)).repartition(tasks, *keys).sortWithinPartitions(*keys, "side")
    out = T.StructType([T.StructField("l", l_type), T.StructField("r", r_type), T.StructField("similarity", T.DoubleType())])
    return both.mapInArrow(run, out)


def _whole(lu: DataFrame, ru: DataFrame, left_blocks: int, right_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Every left block beside every right block."""
    part = F.xxhash64("digest")
    sent = lu.withColumn("lb", F.pmod(part, F.lit(left_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1))))
    kept = ru.withColumn("rb", F.pmod(part, F.lit(right_blocks)).cast("int")).withColumn("lb", F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1))))
    return sent.withColumn("cell", F.lit(-1).cast("long")), kept.withColumn("cell", F.lit(-1).cast("long"))


def _met(lu: DataFrame, ru: DataFrame, threshold: float, pivots: int, block_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """Both sides placed in the blocks in which all pairs of at least ``threshold`` meet; None without right vectors."""
    theta = math.acos(max(-1.0, min(1.0, threshold))) + ANGLE_SLACK
    chosen = ru.orderBy("digest").limit(pivots).collect()
    if not chosen:
        return None
    centres = np.array([row["unit"] for row in chosen])

    @F.pandas_udf("cell int, angle double")
    def nearest(units: pd.Series) -> pd.DataFrame:
        angles = np.arccos(np.clip(np.stack(units.to_numpy()) @ centres.T, -1.0, 1.0))
        return pd.DataFrame({"cell": angles.argmin(axis=1).astype("int32"), "angle": angles.min(axis=1)})

    placed = ru.withColumn("near", nearest("unit"))
    cells = placed.groupBy("near.cell").agg(F.max("near.angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    n_left, n_right = lu.count(), sum(cell["n"] for cell in cells)
    rows = _block_rows(max(n_left, n_right), centres.shape[1], block_rows)
    left_blocks = max(1, -(-n_left // rows))
    radius, right_blocks, held = np.full(len(centres), -10.0), np.ones(len(centres), dtype=int), np.zeros(len(centres))
    for cell in cells:
        radius[cell["cell"]], held[cell["cell"]] = cell["radius"], cell["n"]
        right_blocks[cell["cell"]] = -(-cell["n"] // rows)

    @F.pandas_udf("array<int>")
    def reachable(units: pd.Series) -> pd.Series:
        angles = np.arccos(np.clip(np.stack(units.to_numpy()) @ centres.T, -1.0, 1.0))
        return pd.Series([np.nonzero(row <= radius + theta)[0].astype("int32") for row in angles])

    reached = lu.select(F.explode(reachable("unit")).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    if sum(row["n"] * held[row["cell"]] for row in reached) > UNPRUNED * n_left * n_right:
        return _whole(lu, ru, left_blocks, max(1, -(-n_right // rows)))
    blocks_of = F.array(*[F.lit(int(n)) for n in right_blocks])
    part = F.xxhash64("digest")
    sent = (
        lu.withColumn("cell", F.explode(reachable("unit")))
        .withColumn("lb", F.pmod(part, F.lit(left_blocks)).cast("int"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), blocks_of[c("cell")] - 1)))
    )
    kept = (
        placed.withColumn("cell", c("near.cell"))
        .withColumn("rb", F.pmod(part, blocks_of[c("cell")]).cast("int"))
        .withColumn("lb", F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1))))
        .drop("near")
    )
    return tuple(df.withColumn("cell", -1 - c("cell").cast("long")) for df in (sent, kept))


def _named(units: DataFrame, vectors: DataFrame, key: str):
    """The vectors with ``who``, and a function from pairs on it to the keys.

    Without copies a vector goes by its key, and pairs need no join to find it. Otherwise it goes by its digest;
    the keys of copies, or of all vectors if the copies are many, are joined to the pairs.
    """
    copies = cut(units.join(vectors.filter(c("n") > 1).select("digest"), "digest").select("digest", "key"))
    n = copies.count()
    if not n:
        return vectors.withColumn("who", c("key")), lambda pairs, side: pairs.withColumnRenamed(side, key)
    named = vectors.withColumn("who", c("digest"))
    table = F.broadcast(units.select("digest", "key")) if is_small(units) and n <= SENT_ROWS else units.select("digest", "key")
    return named, lambda pairs, side: pairs.join(table.select(c("digest").alias(side), c("key").alias(key)), side).drop(side)


def _sides(left: DataFrame, right: DataFrame, left_key: str, right_key: str, vector: str) -> list[tuple]:
    """Unit vectors, distinct ones with ``who``, and the way back to the keys, of both sides; each stored once."""
    stored: dict = {}
    for df, key in ((left, left_key), (right, right_key)):
        if (id(df), key) not in stored:
            units = cut(_unit(df, key, vector))
            stored[id(df), key] = units, cut(_counted(units))
    out = []
    for df, key, name in ((left, left_key, f"left_{left_key}"), (right, right_key, f"right_{right_key}")):
        units, vectors = stored[id(df), key]
        out.append((units, *_named(units, vectors, name)))
    return out


def _unique(df: DataFrame, key: str) -> bool:
    """No key is null or comes twice."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((c("n") > 1) | c(key).isNull()).isEmpty()


def semantic_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    vector: str,
    threshold: float,
    how: str = "left",
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All pairs with cosine similarity of at least ``threshold``; exact.

    Equal vectors are compared once. Right vectors belong to the cell of
    their nearest pivot. By the triangle inequality of angles a left vector
    can only match in cells whose pivot is within the cell's radius plus the
    threshold angle, and it is sent to those cells alone; where that spares
    next to nothing, all vectors are one cell. Cells are cut into blocks by
    digest: of ``block_rows`` vectors or more, at most BLOCKS a side while a
    block fits a task. The pairs themselves, which may grow with the square
    of the rows, move only where keys repeat or are null, or vectors do.
    The driver sees the ``pivots`` pivot vectors and one row per cell.
    Columns: left_<key>, right_<key>, similarity. ``how`` is one of HOW.
    """
    if how not in HOW:
        raise ValueError(f"how is one of {', '.join(HOW)}, not {how}")
    lk, rk = f"left_{left_key}", f"right_{right_key}"
    (lv, lu, l_keys), (rv, ru, r_keys) = _sides(left, right, left_key, right_key, vector)
    placed = _met(lu, ru, threshold, pivots, block_rows)
    if placed is None:
        return _with_unmatched(left, right, left_key, right_key, None, how)
    pairs = _compared(*placed, threshold)
    matched = r_keys(l_keys(pairs, "l"), "r").select(lk, rk, rounded(c("similarity")).alias("similarity"))
    kept = [(left, left_key, lv, lu, ru)] * (how in ("left", "full")) + [(right, right_key, rv, ru, lu)] * (how in ("right", "full"))
    if not all(_unique(df, key) for df, key, *_ in kept):
        return _with_unmatched(left, right, left_key, right_key, matched, how)
    out = matched
    for df, key, units, own, other in kept:
        name = lk if own is lu else rk
        lost = _lost(df, key, units, own, other, threshold, pivots, block_rows)
        out = out.unionByName(lost.select(c(key).alias(name)), allowMissingColumns=True)
    return out.select(lk, rk, "similarity")


def _lost(df: DataFrame, key: str, units: DataFrame, own: DataFrame, other: DataFrame, threshold: float, pivots: int, block_rows: int) -> DataFrame:
    """The keys without a match, each of which comes once.

    A vector that the other side holds too matches it, if the threshold leaves room for rounding; the others
    are compared once more for their keys alone.
    """
    lone = own if threshold > 1 - 1e-9 else own.join(other.select("digest"), "digest", "left_anti")
    lone = cut(lone.withColumn("who", c("digest")))
    met = None if lone.isEmpty() else _met(lone, other.withColumn("who", c("digest")), threshold, pivots, block_rows)
    if met is not None:
        lone = lone.join(_compared(*met, threshold).select(c("l").alias("digest")).distinct(), "digest", "left_anti")
    found = units.join(lone.select("digest"), "digest", "left_anti").select(c("key").alias(key))
    return df.select(key).join(found, key, "left_anti")


def _with_unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str, matched: DataFrame | None, how: str) -> DataFrame:
    """Add the keys without a match of the side or sides that the join keeps; no ``matched`` stands for no pairs."""
    lk, rk = f"left_{left_key}", f"right_{right_key}"
    lefts, rights = left.select(c(left_key).alias(lk)), right.select(c(right_key).alias(rk))
    if matched is None:
        nothing = lefts.withColumn(rk, F.lit(None).cast(right.schema[right_key].dataType))
        matched = nothing.withColumn("similarity", F.lit(None).cast("double")).filter(F.lit(False))
    if how == "right":
        return rights.join(matched, rk, "left").select(lk, rk, "similarity")
    if how == "inner":
        return matched
    out = lefts.join(matched, lk, "left")
    if how == "full":
        lost = rights.join(matched.select(rk).distinct(), rk, "left_anti")
        out = out.unionByName(lost, allowMissingColumns=True)
    return out


def semantic_join_lsh(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, vector: str, threshold: float, tables: int = 12, width: float = 1.5
) -> DataFrame:
    """The pairs that random projections bring together, re-checked exactly.

    Every pair returned is right; some pairs may be missing. For tables where
    the exact join cannot prune. Equal vectors are compared once. Vectors meet
    in the buckets of each table, cut into blocks; where buckets are so wide
    that this would compare more pairs than there are, every block meets every
    other. Either way a pair counts once, if it shares a bucket of any table.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    lk, rk = f"left_{left_key}", f"right_{right_key}"
    (lv, lu, l_keys), (rv, ru, r_keys) = _sides(left, right, left_key, right_key, vector)
    first = ru.select("unit").first()
    if first is None:
        nothing = _with_unmatched(left, right, left_key, right_key, None, "inner")
        return nothing.select(lk, rk, "similarity")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="drawn", numHashTables=tables, bucketLength=width, seed=42)
    model = model.fit(ru.limit(1).withColumn("features", array_to_vector("unit")))  # reads the number of dimensions
    hashes = F.array(*[vector_to_array(c("drawn")[i])[0] for i in range(tables)])

    def hashed(df: DataFrame) -> DataFrame:
        return model.transform(df.withColumn("features", array_to_vector("unit"))).withColumn("hashes", hashes).drop("features", "drawn")

    lh = cut(hashed(lu))
    rh = lh if left is right and left_key == right_key else cut(hashed(ru))
    # A cell is a table and a bucket in it.
    cells = F.transform("hashes", lambda h, i: F.shiftleft(i.cast("long"), TABLE_BITS) + (h.cast("long") + F.lit(1 << (TABLE_BITS - 1))))
    in_cells = [df.withColumn("cell", F.explode(cells)) for df in (lh, rh)]
    n, m = [df.groupBy("cell").agg(F.count(F.lit(1)).alias(name)) for df, name in zip(in_cells, "nm", strict=True)]
    counts = cut(n.join(m, "cell"))
    n_left, n_right = lu.count(), ru.count()
    rows = _block_rows(max(n_left, n_right), len(first["unit"]), BLOCK_ROWS)
    left_blocks, right_blocks = (max(1, -(-x // rows)) for x in (n_left, n_right))
    meeting = counts.agg(F.sum(c("n").cast("double") * c("m"))).first()[0] or 0.0
    if meeting >= float(n_left) * n_right:
        sent, kept = _whole(lh, rh, left_blocks, right_blocks)
    else:
        sizes = counts.select("cell", F.ceil(c("n") / rows).cast("int").alias("lefts"), F.ceil(c("m") / rows).cast("int").alias("rights"))
        part = F.xxhash64("digest")
        sent, kept = (df.join(sizes, "cell") for df in in_cells)
        sent = sent.withColumn("lb", F.pmod(part, c("lefts")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), c("rights") - 1)))
        kept = kept.withColumn("rb", F.pmod(part, c("rights")).cast("int")).withColumn("lb", F.explode(F.sequence(F.lit(0), c("lefts") - 1)))
    pairs = _compared(sent, kept, threshold, hashed=True)
    return r_keys(l_keys(pairs, "l"), "r").select(lk, rk, rounded(c("similarity")).alias("similarity"))
