"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over quantile bins, learned by cyclic boosting: round after round each feature
in turn gets one shallow tree on the current gradients, whose leaf values are added to its table. Pairs of
features that explain most of what the single tables leave over get two-dimensional tables in the same way.
A score is the sum of table entries through the logistic function: scoring is indexing and adding.

The model is fitted on at most ``max_rows`` labelled rows, picked by a hash of the id; their features (not
texts) go to the driver. Every row is scored on its whole text.

Nulls and edge cases: null and empty texts share the features of an empty text and get a score; labels without
quality or document are ignored; a document labelled both ways counts as the lower label; with labels of one
class, or none, every score is the share of label 1 (0.5 without any); repeated rows are scored each for itself;
further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscry.llm.common import id_crc, map_arrow, map_batches, plain_words

FEATURES = (
    "chars", "words", "word_length", "letters", "upper", "digits", "symbols", "exclaims", "bars", "odd_ends",
    "distinct", "top_word", "repeats", "lines", "line_length", "repeated_lines", "short_words", "digit_words",
)
ODD = frozenset(b"!#$%&*|@^~<>=_+\\/")


def features(text: str | None) -> list[float]:
    """The numbers in FEATURES of one whole text."""
    words = plain_words(text)
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, total = len(words), len(raw)
    upper, lower, digits, high = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
    letters = upper + lower + high
    space = c[32] + c[9:14].sum()
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(total), np.log1p(n), (total - space) / n, letters / total, upper / max(1, upper + lower), digits / total,
        (total - space - letters - digits) / total, c[33] / n, c[124] / n, sum(w[-1] in ODD for w in words) / n,
        len(counts) / n**0.8, max(counts.values()) / n, sum(map(bytes.__eq__, words[1:], words)) / n,
        np.log1p(len(lines)), np.log1p(total / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) < 4 for w in words) / n, sum(w[0] < 58 and w[0] > 47 for w in words) / n,
    ]


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best cut of a histogram and its gain; the cut is the first bin of the right side."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    best = int(gain.argmax())
    return best + 1, float(gain[best])


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree of that depth on one feature."""
    cut, gain = _split(g, h) if depth else (0, 0.0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([tree(g[:cut], h[:cut], depth - 1), tree(g[cut:], h[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values by cell of a tree that cuts one feature, then the other on either side; its gain."""
    best, most = np.full(g.shape, _leaf(g.sum(), h.sum())), 0.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        cut, gain = _split(a.sum(1), b.sum(1))
        if not cut:
            continue
        out = np.empty(a.shape)
        for side in (slice(0, cut), slice(cut, None)):
            gs, hs = a[side].sum(0), b[side].sum(0)
            gain += _split(gs, hs)[1]
            out[side] = tree(gs, hs, 1)
        if gain > most:
            best, most = out.T if turned else out, gain
    return best, most


class Additive:
    """Edges and tables of the fitted model."""

    def __init__(self, base: float, edges: list[np.ndarray] | None = None):
        self.base, self.edges = base, edges or []
        self.single: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for j, table in enumerate(self.single):
            out += table[b[:, j]]
        for i, j, table in self.pairs:
            out += table[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = self.margin(self.bins(x)) if self.edges else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, n_pairs: int = 8, pair_rounds: int = 40, rate: float = 0.15) -> Additive:
    """Fit the tables to features ``x`` and labels ``y`` (0 or 1)."""
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Additive(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Additive(float(np.log(y.mean() / (1 - y.mean()))), edges)
    b = model.bins(x)
    sizes = [len(e) + 1 for e in edges]
    model.single = [np.zeros(s) for s in sizes]
    f = np.full(len(y), model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, size in enumerate(sizes):
            g, h = gradients()
            step = rate * tree(np.bincount(b[:, j], g, size), np.bincount(b[:, j], h, size))
            model.single[j] += step
            f += step[b[:, j]]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradients()
        at, shape = b[:, i] * sizes[j] + b[:, j], (sizes[i], sizes[j])
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((pair_tree(*cells(i, j))[1], i, j) for i, j in combinations(range(len(sizes)), 2)), reverse=True)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * pair_tree(*cells(i, j))[0]
            table += step
            f += step[b[:, i], b[:, j]]
    return model


def _featured(docs: DataFrame, also: str) -> DataFrame:
    """Features of (key, text) rows; ``also`` is the key's column definition."""
    name = also.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {name: batch.column(name).to_pylist(), "x": [features(t) for t in batch.column("text").to_pylist()]}

    return map_arrow(docs, run, f"{also}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = 20_000, **how: float) -> Additive:
    """Learn from at most ``max_rows`` labelled rows whose id satisfies ``learn`` (a condition on column ``id``)."""
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("y IS NOT NULL AND id IS NOT NULL").filter(learn)
    n = marks.count()
    if n > max_rows:
        marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    marks = marks.groupBy("id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(marks), "id")  # at most about max_rows ids
    # One text of every id, so that a repeated id stays one row.
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text")
    got = _featured(rows, "y int").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    y = got["y"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))  # the same model whichever task answers first
    return boost(x[order], y[order], **how)


def classify(docs: DataFrame, model: Additive, text: str = "text", doc_id: str = "doc_id", cut: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if score >= ``cut``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = shared.value
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            score = scorer.score(x)
            yield {"doc_id": batch.column("doc_id").to_pylist(), "score": score, "predicted": (score >= cut).astype(np.int32)}

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, score double, predicted int")


def held_out(column: Column, folds: int, fold: int) -> Column:
    """True for ids whose crc32 falls into that fold; a null id is in none."""
    return F.coalesce(id_crc(column) % folds == fold, F.lit(False))


def kept_documents(docs: DataFrame, model: Additive, text: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows themselves, without those that score below ``cut``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column(text).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        return batch.filter(pa.array(shared.value.score(x) >= cut))

    return map_batches(docs, change)
