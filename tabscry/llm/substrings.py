"""Exact removal of long passages that an earlier document holds as well, by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the least hash of the ``MER``-word
grams inside it; consecutive windows with the same minimiser form a run that travels as one packed string to
the bucket of that minimiser. Equal windows have equal minimisers, so they meet in one bucket, where the windows
themselves are sorted and compared word by word.

1. Every document emits one small row per run (minimiser, id, run). Only minimisers that occur in two documents
   can hold a repeated window; the runs of the others never travel.
2. The remaining runs are packed and dealt out by minimiser. A minimiser with more than ``bucket_runs`` runs is
   salted: each part decides what repeats inside it and sends one digest row per window it is the first
   holder of; the parts meet by window digest, where each window has at most one row per part and document.
3. The spans found go back to their documents, once per document.

Nulls and edge cases: a null or empty text has no words; texts of fewer words than a window keep all; repeats inside
one document, or among rows that share an id, stay; rows without id neither lose words nor cost others theirs;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscry.llm.common import map_arrow, plain_words, prefilter_joins, written
from tabscry.llm.neardup import gram_hashes, word_hashes

WINDOW = 50
MER = 8
BUCKET_RUNS = 2000


def runs(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """First windows of the runs of one document (with the number of windows at the end) and their minimisers."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    least = gram_hashes(word_hashes(words), min(MER, window))
    span = window - min(MER, window) + 1  # grams in a window
    have = 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - span + have], least[span - have :])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return np.append(first, n), least[first]


def _emitted(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {"mini": [], "id": [], "mark": [], "run": []}
            for i, mark, text in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "text")), strict=True):
                mini = runs(plain_words(text), window)[1].view(np.int64).tolist()
                out["mini"] += mini
                out["id"] += [i] * len(mini)
                out["mark"] += [mark] * len(mini)
                out["run"] += range(len(mini))
            yield out

    return run


def _packed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {"mini": [], "salt": [], "salted": [], "id": [], "mark": [], "start": [], "packed": []}
            for i, mark, text, chosen in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "text", "runs")), strict=True):
                words = plain_words(text)
                at, mini = runs(words, window)
                mini = mini.view(np.int64)
                for x in chosen:
                    r, parts = x["run"], x["parts"]
                    a, b = int(at[r]), int(at[r + 1])
                    for name, v in zip(out, (int(mini[r]), xxhash.xxh3_64_intdigest(f"{i}:{mark}:{r}".encode()) % parts, parts > 1, i, mark, a, b" ".join(words[a : b + window - 1])), strict=True):
                        out[name].append(v)
            yield out

    return run


def repeats(rows: list[tuple], window: int, salted: bool) -> Iterator[tuple]:
    """Spans of one bucket; rows are (id, mark, start, packed) by ascending id.

    Yields (id, mark, first word, end, digest, sure): a span to remove, or, of a salted bucket, a window whose first
    holder here this is.
    """
    whole: dict[bytes, object] = {}
    texts, owner, place = [], [], []
    for k, (i, mark, start, packed) in enumerate(rows):
        first = whole.setdefault(packed, i)
        if first != i:  # the same run as in an earlier document
            n = packed.count(b" ") + 1
            yield i, mark, start, start + n, None, True
            continue
        ends = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
        begins, ends = [0, *(e + 1 for e in ends)], [*ends, len(packed)]
        for j in range(len(begins) - window + 1):
            texts.append(packed[begins[j] : ends[j + window - 1]])
            owner.append(k)
            place.append(start + j)
    order = sorted(range(len(texts)), key=texts.__getitem__)  # stable: the smallest id leads its equals
    last, least, found = None, None, []
    for o in order:
        i, mark = rows[owner[o]][:2]
        if texts[o] != last:
            last, least = texts[o], i
        if i != least:
            found.append((owner[o], place[o]))
        elif salted:
            yield i, mark, place[o], place[o] + window, xxhash.xxh3_128_digest(texts[o]), False
    found.sort()
    k = 0
    while k < len(found):
        row, a = found[k]
        b = a
        while k + 1 < len(found) and found[k + 1] == (row, b + 1):
            b, k = b + 1, k + 1
        k += 1
        yield rows[row][0], rows[row][1], a, b + window, None, True


def _bucketed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("id", "mark", "first", "end", "digest", "sure")
        group, held = None, []

        def close() -> Iterator[dict]:
            if held and (group[2] or len(held) > 1):
                # A sure span meets nobody: its digest is its own place.
                out = [(i, m, a, b, d or xxhash.xxh3_128_digest(f"{i}:{m}:{a}:{b}".encode()), s) for i, m, a, b, d, s in repeats(held, window, group[2])]
                if out:
                    yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
            held.clear()

        for batch in batches:
            for mini, salt, salted, *row in zip(*(batch.column(c).to_pylist() for c in ("mini", "salt", "salted", "id", "mark", "start", "packed")), strict=True):
                if group != (mini, salt, salted):
                    yield from close()
                    group = (mini, salt, salted)
                held.append(tuple(row))
        yield from close()

    return run


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {"doc_id": batch.column("id").to_pylist(), "n_words": [], "n_removed": [], "kept_sha256": []}
            if with_text:
                out["kept_text"] = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = plain_words(text)
                left, at = [], 0
                for s in sorted(spans or [], key=lambda s: s["first"]):
                    left += words[at : max(at, s["first"])]
                    at = max(at, s["end"])
                left += words[at:]
                kept = b" ".join(left)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(left))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept_text"].append(kept.decode("utf-8", "surrogatepass"))
            yield out

    return run


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, bucket_runs: int = BUCKET_RUNS, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and kept_text)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    # The mark tells apart rows that share an id.
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    key = ["id", "mark"]
    emitted = written(map_arrow(texts.filter("id IS NOT NULL"), _emitted(window), f"mini bigint, id {kind}, mark bigint, run int").distinct())
    met = emitted.groupBy("mini").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).filter("lo <> hi")
    met = met.select("mini", F.ceil(F.col("c") / bucket_runs).cast("int").alias("parts"))
    chosen = written(emitted.join(met, "mini").groupBy(key).agg(F.collect_list(F.struct("run", "parts")).alias("runs"), F.count("*").alias("n")))
    prefilter_joins(docs.sparkSession)  # texts without such a run stay where they are
    schema = f"mini bigint, salt int, salted boolean, id {kind}, mark bigint, start int, packed binary"
    packed = map_arrow(texts.join(chosen.filter("n > 0"), key), _packed(window), schema)
    dealt = packed.repartition("mini", "salt").sortWithinPartitions("mini", "salt", "id", "start")
    spans = map_arrow(dealt, _bucketed(window), f"id {kind}, mark bigint, first int, end int, digest binary, sure boolean")
    # A window's parts: whoever holds a smaller id elsewhere decides.
    least = spans.groupBy("digest").agg(F.min("id").alias("least"), F.collect_list(F.struct("id", "mark", "first", "end", "sure")).alias("s"))
    gone = least.select("least", F.explode("s").alias("s")).filter("s.sure OR s.id > least").select("s.*")
    gone = gone.groupBy(key).agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    fields = "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return map_arrow(texts.join(gone, key, "left").select("id", "text", "spans"), _kept(with_text), f"doc_id {kind}, {fields}")
