"""Ranked lexical search over impact vectors in norm buckets (the LEMP way), with exact integer scores.

A document is the vector of its terms' impacts: weight of the term over all documents times the damped frequency in this one. Only
terms of the queries are kept. A query is the vector of its terms' counts, so a score is the inner product of two vectors.

1. One pass over the texts writes every document's length and its counts of query terms; number of documents, their terms and
   document frequencies come from that table.
2. Impact vectors are written in order of their Euclidean length, longest first. What a task reads at a time, at most
   ``ROWS_PER_BATCH`` vectors of like length, is a bucket.
3. The longest ``HEAD`` share is searched first. The k-th score of a query there is its floor: the rest is read only as far as the
   longest query-wise bound allows (a filter on the length that skips files), and only scores at the floor or above leave a task.
4. In a bucket, a query whose length times the bucket's longest vector stays under its k-th score so far is done (Cauchy-Schwarz).
   Else its coordinates are taken by their largest share in the bucket until the others together cannot reach that score; documents
   in none of the lists taken are out. The others keep their sum plus the bound of their remaining coordinates, the smaller of the
   largest shares and Cauchy-Schwarz on what is left of both vectors.
5. Survivors are scored again over all coordinates in 64-bit integers.

Bounds are doubles, widened by more than their rounding. Queries are broadcast in blocks of at most about ``BLOCK_TERMS`` terms.

Nulls and edge cases: a null text or one without terms is no document, or an item without results; documents without id count in all
statistics but are not returned; rows that share a doc_id are results of their own; items that share an item_id are one item with the
terms of all its rows; ties go to the smaller id; only scores above 0 count; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscry.llm.common import map_arrow, written
from tabscry.llm.search import terms

K = 20
HEAD = 0.1
BLOCK_TERMS = 500_000
WIDER = 1 + 1e-9


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = Counter(terms(text))
            yield {"item": [i] * len(own), "term": list(own), "times": list(own.values())}


def _counted(number):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Length of every document with terms and its counts of query terms."""
        get = number.value.get
        for batch in batches:
            out: dict = {"id": [], "n": [], "term": [], "tf": []}
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = terms(text)
                if words:
                    own = Counter(c for w in words if (c := get(w)) is not None)
                    for name, value in zip(out, (i, len(words), list(own), list(own.values())), strict=True):
                        out[name].append(value)
            yield out

    return run


def _impacts(weights, documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Impact vectors and their lengths."""
        for batch in batches:
            held = batch.column("term").value_lengths().to_numpy()
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("term", "tf"))
            m = 75 + 25 * batch.column("n").to_numpy().astype(np.int64) * documents // total
            impact = weights.value[term] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, held)))
            ends = np.cumsum(held)[:-1]
            rows = np.repeat(np.arange(len(held)), held)
            norm = np.sqrt(np.bincount(rows, impact.astype(float) ** 2, len(held)))
            yield {"id": batch.column("id").to_pylist(), "norm": norm, "term": np.split(term, ends), "impact": np.split(impact, ends)}

    return run


class Bucket:
    """Impact vectors of like length, by row and by coordinate."""

    def __init__(self, ids: list, norm: np.ndarray, held: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids, self.norm, self.longest = ids, norm, float(norm.max()) * WIDER
        self.starts = np.concatenate([[0], np.cumsum(held)])
        self.term, self.impact = term, impact
        order = np.argsort(term, kind="stable")
        self.doc, self.share = np.repeat(np.arange(len(held)), held)[order], impact[order]
        self.known, self.first, length = np.unique(term[order], return_index=True, return_counts=True)
        self.last = self.first + length
        self.most = np.maximum.reduceat(self.share, self.first) if len(self.first) else self.share
        self.rescored = 0

    def best(self, codes: np.ndarray, times: np.ndarray, dense: np.ndarray, least: int) -> list[tuple[int, object]]:
        """(score, id) of all vectors whose score is at least ``least``; ``dense`` holds the query by term number."""
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        there = self.known[at] == codes
        at, times = at[there], times[there]
        if not len(at):
            return []
        most = times * self.most[at]
        order = np.argsort(-most, kind="stable")
        at, times, most = at[order], times[order], most[order]
        left = most.sum() - np.cumsum(most)  # what the coordinates after each can still add
        taken = int(np.argmax(left < least)) + 1
        lists = [(self.doc[a:b], t, self.share[a:b]) for a, b, t in zip(self.first[at[:taken]], self.last[at[:taken]], times[:taken].tolist(), strict=True)]
        docs = np.concatenate([d for d, _, _ in lists])
        share = np.concatenate([s for _, _, s in lists]).astype(float)
        own = np.concatenate([np.full(len(d), t, float) for d, t, _ in lists])
        n = len(self.ids)
        total, square = np.bincount(docs, own * share, n), np.bincount(docs, share * share, n)
        rest = math.sqrt(float((times[taken:].astype(float) ** 2).sum())) * np.sqrt(np.maximum(self.norm * self.norm * WIDER - square, 0))
        bound = (total + np.minimum(rest * WIDER, float(left[taken - 1]))) * WIDER + 1
        met = np.zeros(n, bool)
        met[docs] = True
        near = np.flatnonzero(met & (bound >= least))
        self.rescored += len(near)
        if not len(near):
            return []
        a, b = self.starts[near], self.starts[near + 1]
        length = b - a
        rows = np.repeat(a - np.cumsum(length) + length, length) + np.arange(length.sum())
        score = np.add.reduceat(self.impact[rows] * dense[self.term[rows]], np.cumsum(length) - length)
        return [(int(score[j]), self.ids[near[j]]) for j in np.flatnonzero(score >= least)]


def _searched(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary, asked, floors = queries.value
        dense = np.zeros(vocabulary, np.int64)
        length = [math.sqrt(float((times.astype(float) ** 2).sum())) for _, times in asked]
        least, found = list(floors), [[] for _ in asked]
        for batch in batches:
            norm = batch.column("norm").to_numpy()
            if not len(norm):
                continue
            held = batch.column("term").value_lengths().to_numpy()
            bucket = Bucket(batch.column("id").to_pylist(), norm, held, batch.column("term").flatten().to_numpy(), batch.column("impact").flatten().to_numpy())
            for q, (codes, times) in enumerate(asked):
                if length[q] * bucket.longest * WIDER + 1 < least[q]:
                    continue
                dense[codes] = times
                new = bucket.best(codes, times, dense, least[q])
                dense[codes] = 0
                if new:
                    found[q] = sorted(found[q] + new, key=lambda r: (-r[0], r[1]))[:k]
                    if len(found[q]) == k:
                        least[q] = max(least[q], found[q][-1][0])
        rows = [(q, i, s) for q, own in enumerate(found) for s, i in own]
        for a in range(0, len(rows), 20_000):
            yield dict(zip(("query", "id", "score"), map(list, zip(*rows[a : a + 20_000], strict=True)), strict=True))

    return run


def ranked(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    kind, of_item = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    asked = map_arrow(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")), _item_terms, f"item {of_item}, term string, times bigint")
    asked = written(asked.groupBy("item", "term").agg(F.sum("times").alias("times")))
    blocks = max(1, -(-asked.count() // block_terms))
    found = spark.createDataFrame([], f"item_id {of_item}, id {kind}, score bigint")
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).groupBy("item").agg(F.collect_list(F.struct("term", "times")).alias("own")).collect()
        if not block:
            continue
        number = {t: c for c, t in enumerate(sorted({o["term"] for r in block for o in r["own"]}))}
        index = written(map_arrow(rows, _counted(spark.sparkContext.broadcast(number)), f"id {kind}, n int, term array<int>, tf array<int>"))
        documents, total = index.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        df = dict(map(tuple, index.select(F.explode("term").alias("t")).groupBy("t").count().collect()))  # at most one row a query term
        weights = spark.sparkContext.broadcast(np.array([weight(documents, df.get(c, 0)) for c in range(len(number))], np.int64))
        vectors = map_arrow(index.filter("id IS NOT NULL AND size(term) > 0"), _impacts(weights, documents, total), f"id {kind}, norm double, term array<int>, impact array<bigint>").filter("norm > 0")
        vectors = written(vectors.repartitionByRange(F.desc("norm"), F.xxhash64("id")).sortWithinPartitions(F.desc("norm")))  # ties are split
        queries = []
        for r in block:
            codes = np.array([number[o["term"]] for o in r["own"]])
            order = np.argsort(codes)
            queries.append((codes[order], np.array([o["times"] for o in r["own"]], np.int64)[order]))
        found = found.union(_block_best(vectors, [r["item"] for r in block], queries, len(number), kind, of_item, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _block_best(vectors: DataFrame, names: list, queries: list, vocabulary: int, kind: str, of_item: str, k: int) -> DataFrame:
    """item_id, id, score of the best of a block of queries, and perhaps more."""
    spark = vectors.sparkSession
    schema = f"query int, id {kind}, score bigint"

    def search(part: DataFrame, floors: list[int]) -> DataFrame:
        return map_arrow(part, _searched(spark.sparkContext.broadcast((vocabulary, queries, floors)), k), schema)

    longest = vectors.agg(F.percentile_approx("norm", 1 - HEAD, 1000)).first()[0]
    if longest is None:
        return spark.createDataFrame([], f"item_id {of_item}, id {kind}, score bigint")
    head = written(search(vectors.filter(F.col("norm") >= longest), [1] * len(queries)))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    floors = [1] * len(queries)
    for r in head.withColumn("place", place).filter(F.col("place") == k).select("query", "score").collect():  # one row a query
        floors[r["query"]] = r["score"]
    # The shortest vector that any query can still take.
    reach = min((f - 1) / WIDER / math.sqrt(float((times.astype(float) ** 2).sum())) for f, (_, times) in zip(floors, queries, strict=True))
    rest = search(vectors.filter((F.col("norm") < longest) & (F.col("norm") >= reach / WIDER / WIDER)), floors)
    name = spark.createDataFrame(list(enumerate(names)), f"query int, item_id {of_item}")
    return head.union(rest).join(F.broadcast(name), "query").select("item_id", "id", "score")
