"""Language identification: known words first, character n-grams for unseen words.

Each known word has a log frequency per language. A word the model has not seen falls back to its character
4-grams, then to 3-, 2- and 1-grams: the first length of which the model knows at least one gram decides.
A text's score per language is the sum over all its words.

The model is fitted on at most ``max_docs`` labelled rows, picked by a hash of the id, and keeps the
``max_words`` most frequent words and ``max_grams`` grams of each length per language; its size is thus bounded
by these parameters and it is broadcast. Every row is scored on its whole text.

Nulls and edge cases: a null, empty or letterless text is ``und`` with score 0; rows without text or language
are not learned from; with nothing to learn from every text is ``und``; ties go to the smallest language name;
repeated rows are scored each for itself; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscry.llm.common import map_arrow, sample_by_id

LETTERS = re.compile(r"[^\W\d_]+")
BROADCAST_LANGS = 10_000
GRAM_LENGTHS = (4, 3, 2, 1)
CACHED_WORDS = 300_000
UNDETERMINED = "und"


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """(lang, n, gram, count) of each partition; n = 0 are whole words."""
    words: dict[str, Counter] = {}

    def flush() -> Iterator[dict]:
        for lang, seen in words.items():
            by_n: dict[int, Counter] = {0: seen} | {n: Counter() for n in GRAM_LENGTHS}
            for word, k in seen.items():
                for n in GRAM_LENGTHS:
                    for g in grams(word, n):
                        by_n[n][g] += k
            for n, c in by_n.items():
                yield {"lang": [lang] * len(c), "n": [n] * len(c), "gram": list(c), "k": list(c.values())}
        words.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        if sum(map(len, words.values())) > CACHED_WORDS:
            yield from flush()
    yield from flush()


class Model:
    """Log frequencies by gram length; row i of ``tables[n][1]`` belongs to the gram with index i."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[dict[str, int], np.ndarray]]):
        self.langs, self.tables = langs, tables
        self.cache: dict[str, np.ndarray] = {}
        self.none = np.zeros(len(langs))

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the known grams of the longest length that has any."""
        found = self.cache.get(word)
        if found is None:
            found = self.none
            for n in GRAM_LENGTHS:
                index, table = self.tables[n]
                rows = [index[g] for g in grams(word, n) if g in index]
                if rows:
                    found = table[rows].mean(axis=0)
                    break
            if len(self.cache) < CACHED_WORDS:
                self.cache[word] = found
        return found

    def score(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        index, table = self.tables[0]
        known, total = [], self.none.copy()
        for word, k in Counter(words).items():
            row = index.get(word)
            if row is None:
                total += k * self.unseen(word)
            else:
                known.append((row, k))
        if known:
            rows, k = np.array(known).T
            total += k @ table[rows]
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    max_docs: int = 20_000, max_words: int = 50_000, max_grams: int = 20_000, lang_docs: int = 200,
) -> Model:
    """Learn from about ``max_docs`` of the rows where ``learn`` holds, and from about ``lang_docs`` of every language with fewer.

    Languages of up to ``lang_docs`` rows are learned from all of them, so a rare one is learned at any size of the table.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), learn.alias("learn"))
    rows = rows.filter("learn AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    n, langs = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if n > max_docs:
        rows = rows.join(F.broadcast(sizes) if langs <= BROADCAST_LANGS else sizes, "lang")
        rows = sample_by_id(rows, n, max_docs, lang_docs / F.col("size"))
    rows = rows.filter("text IS NOT NULL").select("lang", "text")
    counted = map_arrow(rows, _counts, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    # A word seen once says little about its language; its grams say more.
    counted = counted.filter("n > 0 OR k > 1")
    best = Window.partitionBy("lang", "n").orderBy(F.desc("k"), "gram")
    kept = counted.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams))
    found = kept.select("lang", "n", "gram", "k").toPandas()
    langs = sorted(found["lang"].unique().tolist())
    place = {x: i for i, x in enumerate(langs)}
    tables = {}
    for size in (0, *GRAM_LENGTHS):
        part = found[found["n"] == size]
        names = sorted(part["gram"].unique().tolist())
        index = {g: i for i, g in enumerate(names)}
        table = np.full((len(names), len(langs)), 0.5)
        np.add.at(table, (part["gram"].map(index).to_numpy(int), part["lang"].map(place).to_numpy(int)), part["k"].to_numpy(float))
        tables[size] = (index, np.log(table / np.maximum(table.sum(axis=0), 1)))
    return Model(langs, tables)


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score (the posterior of that language) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = shared.value
        for batch in batches:
            out = [scorer.score(x) for x in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id").to_pylist(), "lang_pred": [x for x, _ in out], "score": [x for _, x in out]}

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")
