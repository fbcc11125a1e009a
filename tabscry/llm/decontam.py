"""Benchmark decontamination; DataFrame functions only.

The windows of all benchmark items (10 words each; an item of fewer words is one window) form a hash set. Its
size is counted first: up to ``broadcast_grams`` windows it goes to every executor and documents are scanned
without a shuffle; beyond that the same equi-join is left to Spark's shuffled joins. Document windows are looked up
by a 64-bit hash, and every hit is verified word by word. Hits are gathered per document, never per window.

Nulls and edge cases: null and empty texts have no words; a document row without hits is returned with zeros; an
item without words matches nothing; an item without id marks words as hit but is not listed; repeated items give
the same result as one; repeated document rows are judged each for itself; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_GRAMS = 500_000
WINDOWS = "array<struct<p: int, size: int, h: bigint, own: array<string>>>"


def words_of(text: Column) -> Column:
    """Digits, letters and all characters beyond ASCII, A-Z lower-cased."""
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _windows(size: int, gram: str) -> str:
    """SQL for the windows of ``size`` words of the array ``words``: place, size, hash, and ``gram`` over these words."""
    made = f"transform(sequence(1, n - {size - 1}), p -> struct(p, {size} AS size, xxhash64(slice(words, p, {size})) AS h, {gram.format(size=size)} AS own))"
    return f"if(n >= {size}, {made}, cast(array() AS {WINDOWS}))"


def benchmark_grams(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per distinct window: size, gram (its words), items (sorted ids as text), h."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).filter("size(words) > 0")
    size = F.least(F.size("words"), F.lit(window))
    grams = items.select("item", size.alias("size"), F.explode(F.expr(f"transform(sequence(1, greatest(size(words) - {window - 1}, 1)), p -> slice(words, p, {window}))")).alias("gram"))
    return grams.groupBy("size", "gram").agg(F.collect_set("item").alias("items")).withColumn("h", F.expr("xxhash64(gram)"))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Per document row: doc_id, n_words, spans (first word and number of words of every hit), items (sorted)."""
    grams = benchmark_grams(benchmark, window=window)
    sizes = {r["size"]: r["count"] for r in grams.groupBy("size").count().collect()}  # at most ``window`` rows
    small = sum(sizes.values()) <= broadcast_grams
    g = grams.select(F.col("h").alias("gh"), "gram", "items")
    # A broadcast set is probed where the words are, and only met windows are cut out. Before a shuffle every window takes its own
    # words along instead: ten times the text at most, where all words of the text would grow with the square of its length.
    gram = "cast(null AS array<string>)" if small else "slice(words, p, {size})"
    # The first entry stands for the document itself and never matches.
    marks = ", ".join([f"cast(array(struct(0, 0, null, null)) AS {WINDOWS})", *(_windows(n, gram) for n in sorted(sizes))])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    # Windows are made in a column of their own: exploding a plain column stays inside generated code, which looks the hash up
    # before a row is built. Exploding the expression itself would copy all words of the text into the row of every window.
    rows = rows.withColumn("n", F.size("words")).withColumn("marks", F.expr(f"concat({marks})"))
    rows = rows.select("row", "doc_id", "n", *(["words"] if small else []), F.explode_outer("marks").alias("w"))
    # Two comparisons instead of one equality: the words are then compared on a met hash only and never hashed as a key.
    own = F.expr("slice(words, w.p, w.size)") if small else F.col("w.own")
    same = (F.col("w.h") == F.col("gh")) & (own <= F.col("gram")) & (own >= F.col("gram"))
    met = rows.join(F.broadcast(g) if small else g, same, "left").filter("w.p = 0 OR gram IS NOT NULL")
    met = met.select("row", "doc_id", F.when(F.col("w.p") == 0, F.col("n")).alias("n"), F.when(F.col("w.p") > 0, F.struct(F.col("w.p").alias("p"), F.col("w.size").alias("size"))).alias("span"), "items")
    found = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return found.drop("row")


def n_hit_words() -> Column:
    """Words inside any span, from the sorted column ``spans``."""
    return F.expr(
        "aggregate(spans, struct(0L AS upto, 0L AS n), (a, s) -> struct(greatest(a.upto, s.p + s.size - 1L) AS upto, "
        "a.n + greatest(0L, s.p + s.size - 1L - greatest(a.upto, s.p - 1L)) AS n), a -> a.n)"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, **how)
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _texts_hit(docs: DataFrame, benchmark: DataFrame, text: str, **how) -> DataFrame:
    """Digest and spans of every text that is hit, once per text."""
    found = hits(docs.select(_digest(docs[text]).alias("doc_id"), docs[text].alias("text")), benchmark, **how)
    return found.filter("size(spans) > 0").groupBy(F.col("doc_id").alias("hit_text")).agg(F.first("spans").alias("hit_spans"))


def _digest(text: Column) -> Column:
    """Names a text; null for a null text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns.

    Every row is judged by its own text, so ids may be null or repeated.
    """
    bad = _texts_hit(docs, benchmark, text, **how).select("hit_text")
    return docs.join(bad, _digest(docs[text]) == bad["hit_text"], "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """doc_id and the words of every document row outside all hit windows, joined by one space (``text``)."""
    found = _texts_hit(docs, benchmark, text, **how)
    rows = docs.select(docs[doc_id].alias("doc_id"), _digest(docs[text]).alias("digest"), words_of(docs[text]).alias("words"))
    rows = rows.join(found, rows["digest"] == found["hit_text"], "left")
    kept = F.expr("if(hit_spans IS NULL, words, filter(words, (x, i) -> NOT exists(hit_spans, s -> i + 1 >= s.p AND i + 1 < s.p + s.size)))")
    return rows.select("doc_id", F.array_join(kept, " ").alias("text"))
