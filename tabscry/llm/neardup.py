"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set holds its distinct 5-word shingles. Its sketch has ``BINS`` coordinates: in round i every shingle
is thrown into a random bin with value i plus a fraction, and a bin keeps its least value; after that many rounds
again every bin is visited once by all shingles. Rounds stop as soon as all bins are filled, so small sets fill
every coordinate and large ones need one or two rounds. Two sketches agree in a coordinate with the probability
of their Jaccard similarity. With 20 bands of 4 coordinates a pair at 0.85 shares no band with probability 4e-7.

Documents with equal sets form one class, and classes are what is compared:

1. In every band bucket the class with most bucket mates over all its bands (a base text has more than its
   variants) is the centre; every other member is verified against it on full sets. Linear in the bucket.
2. Links are joined into components. Buckets that still hold several components are compared member by member,
   except within a component, in blocks of bounded size that are spread over tasks; a block emits only
   links that join components, never its pairs.
3. Both kinds of links give the final components.

Nothing is capped: a bucket of any size is split into blocks. Step 2 is quadratic in the members of a bucket that
neither its centre nor other links join.

Nulls and edge cases: a null text or one without words has no shingles and is linked with nothing; fewer than 5
words are one shingle; rows without id are linked with nothing and kept; rows that share an id are one document and
share their component; repeated texts are copies of the smallest id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscry.llm.common import ascii_words, map_arrow, prefilter_joins, written
from tabscry.llm.graph import components

SHINGLE = 5
BANDS, DEPTH = 20, 4
BINS = BANDS * DEPTH
BLOCK = 512
PERCENT = 85
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words from the words' hashes; fewer words are one run."""
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * MULTIPLIER + h[k : k + len(out)]
    return mixed(out ^ np.uint64(n))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(gram_hashes(word_hashes(ascii_words(text)), SHINGLE))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The coordinates of a non-empty set of 64-bit hashes."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * bins):
        x = mixed(items + np.uint64((i + 1) * int(MULTIPLIER) % 2**64))
        value = np.uint64(i << 48) | (x >> np.uint64(16))
        if i < bins:
            np.minimum.at(out, ((x & np.uint64(0xFFFF)) * np.uint64(bins)) >> np.uint64(16), value)
        else:
            out[i - bins] = min(out[i - bins], value.min())
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        size, digest, sketches = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text)
            size.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append((mixed(sketch(s)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() if len(s) else None)
        yield {"id": batch.column("id").to_pylist(), "n": size, "digest": digest, "sketch": sketches}


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield {"rep": batch.column("rep").to_pylist(), "items": [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]}


class Union:
    """Disjoint sets over the components named in one block."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(y, y)
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def block_links(rep: list, comp: list, side: list[bool], items: list[np.ndarray], percent: int, within: bool) -> list[tuple]:
    """Verified links between members of different components that join components of this block.

    ``within``: all members are compared; else those of one side with those of the other.
    """
    sizes = np.array([len(x) for x in items])
    flat, ids = np.unique(np.concatenate(items), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    marked = np.zeros(len(flat), np.int32)
    comps, sides = np.unique(np.array(comp), return_inverse=True)[1], np.array(side)
    big = np.bincount(comps).argmax()
    joined, links = Union(), []
    for i in range(len(rep)):
        if comps[i] == big:  # its pairs with others are seen from the other end
            continue
        wanted = (comps != comps[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        wanted &= (comps == big) | (np.arange(len(rep)) > i)
        if not within:
            wanted &= sides != sides[i]
        if not wanted.any():
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        both = np.add.reduceat(marked[ids], starts)
        marked[own] = 0
        for j in np.flatnonzero(wanted & (100 * both >= percent * (sizes + sizes[i] - both))):
            if joined.join(comps[i], comps[j]):
                links.append((rep[i], rep[j]))
    return links


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows come sorted by bucket and block pair."""
        group, held = None, ([], [], [], [])

        def close() -> Iterator[dict]:
            if len(held[0]) > 1:
                links = block_links(*held, percent, group[1] == group[2])
                if links:
                    yield {"a": [x for x, _ in links], "b": [y for _, y in links]}
            for x in held:
                x.clear()

        for batch in batches:
            items = [np.asarray(x) for x in batch.column("items").to_numpy(zero_copy_only=False)]
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "rep", "component", "upper")), items, strict=True)
            for key, low, high, rep, comp, upper, own in rows:
                if group != (key, low, high):
                    yield from close()
                    group = (key, low, high)
                for x, v in zip(held, (rep, comp, upper, own), strict=True):
                    x.append(v)
        yield from close()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def mixed_keys(cand: DataFrame, found: DataFrame) -> DataFrame:
    """Keys of the buckets that hold several components."""
    component = F.coalesce("component", "rep")
    placed = cand.select("key", "rep").join(found, F.col("rep") == found["node"], "left").groupBy("key")
    return written(placed.agg(F.min(component).alias("lo"), F.max(component).alias("hi")).filter("lo <> hi").select("key"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = written(map_arrow(texts, _sketched, f"id {kind}, n int, digest binary, sketch binary"))
    has = rows.filter("n > 0 AND id IS NOT NULL")
    classes = has.groupBy("digest").agg(F.min("id").alias("rep"))
    nodes = written(has.join(classes, "digest").filter("id = rep").groupBy("rep", "digest").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    keys = F.array(*(F.xxhash64(F.substring("sketch", 1 + 2 * DEPTH * b, 2 * DEPTH), F.lit(b)) for b in range(BANDS)))
    banded = nodes.select("rep", "n", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    cand = written(banded.join(shared, "key"))
    mates = cand.groupBy("rep").agg(F.sum("c").alias("mates"))
    centre = cand.join(mates, "rep").groupBy("key").agg(F.max_by("rep", F.struct("mates", "n")).alias("a"), F.max_by("n", F.struct("mates", "n")).alias("na"))
    fits = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")
    pairs = written(cand.join(centre, "key").filter((F.col("rep") != F.col("a")) & fits).select("a", F.col("rep").alias("b")).distinct())

    # Only texts of shared buckets are needed: Spark's own Bloom filter over their ids, of bounded size, keeps most
    # of the others out of the shuffle, at any table size.
    prefilter_joins(docs.sparkSession)
    wanted = written(cand.groupBy("rep").agg(F.max("c").alias("c"))).filter("c > 1")
    # A class is read through its smallest id.
    sets = written(map_arrow(texts.join(wanted, texts["id"] == wanted["rep"]).select("rep", "text"), _sets, f"rep {kind}, items array<bigint>"))
    stars = written(_verified(pairs, sets, percent))

    first = components(stars)
    # With two members the star has decided; with one component there is nothing to find.
    cand = cand.filter("c > 2")
    placed = cand.join(mixed_keys(cand, first), "key").join(first, F.col("rep") == first["node"], "left").select("key", "rep", "c", F.coalesce("component", "rep").alias("component"))
    blocks = F.ceil(F.col("c") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    spread = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rep", "component", (F.col("own") > F.col("other")).alias("upper"))
    dealt = spread.join(sets, "rep").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")
    links = written(map_arrow(dealt, _compared(percent), f"a {kind}, b {kind}"))

    final = components(stars.union(links))
    groups = classes.join(final, classes["rep"] == final["node"], "left").select("digest", F.coalesce("component", "rep").alias("root"))
    out = rows.join(groups, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents without the near copies of another one, with all their columns."""
    gone = near_duplicates(docs, text, doc_id, **how).filter("NOT kept").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(gone, docs[doc_id] == gone["_copy"], "left_anti")
