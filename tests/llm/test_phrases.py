"""Collocations against brute force; transducers against dictionaries."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import CLASH, EDGES

from tabscry.llm import phrases


def brute(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i:j] for q in cand for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and c[q] >= c[q[i:j]]}
        rows = []
        for p in cand - gone:
            score, k = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def check(spark, rows, least, **how):
    data = [(i, t, lang, 7, 1, "w", 0.5, 3, 1, 2, 9) for i, (t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string" + CLASH).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=least, **how).collect())
    want = brute(rows, least, **how)
    assert got == want and (len(want) or not rows)


def made(seed, n):
    rng = np.random.default_rng(seed)
    words = ["The", "of", "new", "york", "city", "state", "é", "漢字", "a\x1cb", "x'"]
    marks = [" ", " ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "  ", ";"]
    return [
        ("".join(words[w] + marks[m] for w, m in zip(rng.integers(0, len(words), k), rng.integers(0, len(marks), k), strict=True)), ["en", "de", None, "und"][k % 4])
        for k in rng.integers(0, 60, n)
    ]


def test_edges(spark):
    check(spark, [(t, lang) for _, t, lang in EDGES], 2)


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (8, 5, 7), (4, 3, 2000), (3, 2, 2000), (2, 6, 2000)])
def test_made_texts(spark, monkeypatch, least, longest, top):
    monkeypatch.setattr(phrases, "RANGE_WORDS", 500)
    check(spark, [*made(least, 250), ("", "en"), (None, "en"), *[("new york city", "en")] * 30, *[("state of the new york", None)] * 9], least, longest=longest, top=top)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "phrase_filter", lambda automata, size: automata.sparkSession.sparkContext.broadcast(np.full(phrases.BITS // 64, 2**64 - 1, np.uint64)))
    check(spark, made(1, 120), 5)


def test_symbols_are_those_of_spark(spark):
    words = ["", "a", "漢字", "x" * 100, "é"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] % 2**64 for r in got] == [phrases.symbol(w.encode()) for w in words]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_transducers(size):
    rng = np.random.default_rng(size)
    for rows in (1, 5, 400):
        drawn = rng.integers(0, 6, (rows, size)).astype(np.uint64) * phrases.MULTIPLIER
        own, counts = phrases.summed(drawn, rng.integers(1, 3, rows))
        automaton = phrases.Automaton.load(phrases.Automaton.build(own, counts).dump())
        back, f = automaton.paths()
        assert (back == own).all() and (f == counts).all()
        asked = rng.integers(0, 8, (500, size)).astype(np.uint64) * phrases.MULTIPLIER
        known = {tuple(p): c for p, c in zip(own.tolist(), counts.tolist(), strict=True)}
        assert automaton.counts(asked).tolist() == [known.get(tuple(p), 0) for p in asked.tolist()]


def test_equal_states_are_shared():
    own = np.array([[a, b, c] for a in range(20) for b in range(5) for c in range(4)], np.uint64)
    automaton = phrases.Automaton.build(own, np.ones(len(own), np.int64))
    assert [len(labels) for _, labels, _ in automaton.levels] == [20, 5, 4]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).count() == 0
