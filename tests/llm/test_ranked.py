"""Ranked search against scoring everything; how much the norm buckets leave out."""

import re
from collections import Counter

import numpy as np
import pytest
from test_operators import CLASH, EDGES

from tabscry.llm import ranked

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    held = [(i, terms_of(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for item, q in asked.items():
        rows = []
        for i, w in held:
            tf, m = Counter(w), 75 + 25 * len(w) * n // total
            score = sum(c * ranked.weight(n, df[t]) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in q.items() if tf[t])
            if score > 0 and i is not None:
                rows.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return Counter(out)


def check(spark, docs, items, **how):
    frame = spark.createDataFrame([(i, t, "en", 7, 1, "w", 0.5, 3, 1, 2, 9) for i, t in docs], "doc_id long, text string, lang string" + CLASH).repartition(4)
    asked = spark.createDataFrame([(i, t, 1, 0.5, 3) for i, t in items], "item_id string, text string, id long, norm double, score long")
    got = Counter(tuple(r) for r in ranked.ranked(frame, asked, **how).collect())
    assert got == brute(docs, items, how.get("k", 20))


def made(seed, n, vocabulary=300):
    rng = np.random.default_rng(seed)
    return [" ".join(f"T{int(x)}" for x in np.minimum(rng.zipf(1.3, rng.integers(0, 120)), vocabulary)) for _ in range(n)]


@pytest.mark.parametrize(("k", "block"), [(20, 10**6), (3, 40), (1, 10**6)])
def test_made_texts(spark, monkeypatch, k, block):
    monkeypatch.setattr(ranked, "HEAD", 0.05)
    docs = [(5000 - i, t) for i, t in enumerate(made(k, 700))]
    docs += [(9000 + i, docs[5][1]) for i in range(60)]  # ties
    docs += [(9000, "t1 t2 t2 t9"), (None, "t1 t250"), (1, None), (2, ""), (3, "...")]
    items = [(f"q{i}", t) for i, t in enumerate([*made(100 + k, 12), docs[5][1], "", "nothing known here", "t1 t1 T1 t250"])]
    items += [("q0", "t250 t251"), (None, "t3 t77"), ("null text", None)]
    check(spark, docs, items, k=k, block_terms=block)


def test_edges(spark):
    check(spark, [(i, t) for i, t, _ in EDGES], [("a", "one two"), ("b", "same W5 w6"), ("c", "漢字 é"), ("d", None)])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for d, q in ((docs, items), (some, items), (docs, some.withColumnRenamed("doc_id", "item_id"))):
        assert ranked.ranked(d, q).count() == 0


def test_buckets_leave_most_vectors_out():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.minimum(rng.zipf(1.4, 40), 400)) for _ in range(512)]
    held, term = np.array([len(r) for r in rows]), np.concatenate(rows)
    impact = (1_000_000 / (1 + np.bincount(term)[term])).astype(np.int64) + 1
    square = np.bincount(np.repeat(np.arange(512), held), impact.astype(float) ** 2)
    bucket = ranked.Bucket(list(range(512)), np.sqrt(square), held, term, impact)
    scored = 0
    for q in range(40):
        codes, times = rows[q], np.ones(len(rows[q]), np.int64)
        dense = np.zeros(401, np.int64)
        dense[codes] = times
        full = np.array([impact[bucket.starts[i] : bucket.starts[i + 1]] @ dense[rows[i]] for i in range(512)])
        least = int(np.sort(full)[-20])
        got = bucket.best(codes, times, dense, least)
        assert sorted(got) == sorted((int(full[i]), int(i)) for i in np.flatnonzero(full >= least))
        scored += int((full > 0).sum())
    assert bucket.rescored < 0.2 * scored
