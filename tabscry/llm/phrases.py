"""Collocations from exact phrase counts, held in weighted acyclic automata.

Phrases of one length are counted in a pass over the texts. A task takes the words of a language in chunks of bounded size, counts
the chunk's phrases, sorts them and builds a count transducer from the sorted list: arcs are words, equal prefixes share a path,
states with equal continuations and counts are one, and the last arc carries the count (``Automaton``). Chunks are the increments:
each transducer is cut by ranges of its phrases' prefixes, and for every (language, length, range) one task unites what arrives,
sums the counts and keeps the phrases that are frequent enough.

A phrase is frequent only if the phrases inside it are. So each pass counts only what the frequent phrases one word shorter allow;
a filter of fixed size (``BITS``) carries these to the tasks. A full filter lets more be counted, it never loses anything. The
passes are: words, pairs, triples, then all longer ones.

Counts of a candidate's parts are read by composition: the wanted parts go to the range their prefix belongs to and are walked
through its transducer side by side. Scores are exact decimals.

Words are numbered by their 64-bit hash; two frequent words of one language with one hash raise an error. Memory of a task is bounded by its
chunk, or by the distinct phrases of a range, of which there are as many as the corpus has words / ``RANGE_WORDS``.

Nulls and edge cases: a null text is empty; a null language is ``und``; equal texts all count; an empty table gives no rows; no id is
read; further columns are ignored; equal scores and counts rank by the phrase's bytes.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscry.llm.common import map_arrow, written
from tabscry.llm.neardup import MULTIPLIER, mixed

CHUNK_WORDS = 2_000_000
RANGE_WORDS = 4_000_000
HELD_WORDS = 200_000
UNITE_ROWS = 1_000_000
BITS = 1 << 25
PROBES = 4
BREAK = b"\xff"  # no UTF-8 text holds this byte
CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")


def pieces(texts: list[str | None]) -> list[bytes]:
    """The words of the texts, with ``BREAK`` between pieces and between texts."""
    raw = "\n".join(t for t in texts if t).encode("utf-8", "surrogatepass").lower()
    return raw.translate(CUTS).replace(BREAK, b" " + BREAK + b" ").split()


def symbol(word: bytes) -> int:
    """What Spark's xxhash64 gives for the word."""
    return xxhash.xxh64_intdigest(word, 42)


def prefix_range(phrases: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each row's prefix: all but its last word."""
    h = np.zeros(len(phrases), np.uint64)
    for k in range(max(1, phrases.shape[1] - 1)):
        h = h * MULTIPLIER + phrases[:, k]
    return (((mixed(h) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


class Automaton:
    """A count transducer of phrases of one length: per depth the first arc of each state, labels, and targets or counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, phrases: np.ndarray, counts: np.ndarray) -> Automaton:
        """From distinct phrases in lexicographic order."""
        size = phrases.shape[1]
        fresh, marks = np.zeros(len(phrases), bool), []
        fresh[0] = True
        for d in range(size):
            fresh = fresh.copy()
            fresh[1:] |= phrases[1:, d] != phrases[:-1, d]
            marks.append(fresh)
        levels, values = [], counts.astype(np.uint64)
        for d in reversed(range(size)):
            arcs = np.flatnonzero(marks[d])
            labels = phrases[arcs, d]
            state = np.cumsum(marks[d - 1])[arcs] - 1 if d else np.zeros(len(arcs), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
            first, merged = cls._equal(starts, labels, values)
            length = np.diff(np.append(starts, len(arcs)))[first]
            kept = np.repeat(starts[first], length) + _within(length)
            levels.append((np.concatenate([[0], np.cumsum(length)]), labels[kept], values[kept]))
            values = merged.astype(np.uint64)
        return cls(levels[::-1])

    @staticmethod
    def _equal(starts: np.ndarray, labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One state for each set of arcs, and the number of every state's own."""
        length = np.diff(np.append(starts, len(labels)))
        digest = np.add.reduceat(mixed(labels ^ mixed(values + MULTIPLIER)), starts)
        _, first, merged = np.unique(digest, return_index=True, return_inverse=True)
        like = first[merged]
        other = length != length[like]
        at = np.minimum(np.repeat(starts[like], length) + _within(length), len(labels) - 1)
        other |= np.logical_or.reduceat((labels != labels[at]) | (values != values[at]), starts)
        if other.any():  # equal digests, yet other arcs
            merged[other] = len(first) + np.arange(other.sum())
            first = np.append(first, np.flatnonzero(other))
        return first, merged

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases and their counts."""
        state, columns = np.zeros(1, np.int64), []
        for starts, labels, values in self.levels:
            length = starts[state + 1] - starts[state]
            arc = np.repeat(starts[state], length) + _within(length)
            columns = [np.repeat(c, length) for c in columns] + [labels[arc]]
            state = values[arc].astype(np.int64)
        return np.stack(columns, axis=1), state

    def counts(self, phrases: np.ndarray) -> np.ndarray:
        """The count of each row of ``phrases``, 0 if it is unknown; all walk side by side."""
        state, alive = np.zeros(len(phrases), np.int64), np.ones(len(phrases), bool)
        for d, (starts, labels, values) in enumerate(self.levels):
            known, code = np.unique(labels, return_inverse=True)
            arcs = (np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.uint64) << np.uint64(32)) | code.astype(np.uint64)
            own = np.minimum(np.searchsorted(known, phrases[:, d]), len(known) - 1)
            alive &= known[own] == phrases[:, d]
            wanted = (state.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64)
            arc = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            alive &= arcs[arc] == wanted
            state = np.where(alive, values[arc].astype(np.int64), 0)
        return state

    def dump(self) -> bytes:
        known = np.unique(np.concatenate([labels for _, labels, _ in self.levels]))
        parts = [np.diff(known, prepend=np.uint64(0))]
        for starts, labels, values in self.levels:
            parts += [np.diff(starts), np.searchsorted(known, labels), values]
        head, body = [len(parts)], []
        for x in parts:
            kind = next(t for t in ("u1", "u2", "u4", "u8") if not len(x) or int(x.max()) < 1 << 8 * int(t[1]))
            head += [int(kind[1]), len(x)]
            body.append(x.astype("<" + kind).tobytes())
        return zstandard.compress(struct.pack(f"<{len(head)}q", *head) + b"".join(body), 1)

    @classmethod
    def load(cls, blob: bytes) -> Automaton:
        raw = zstandard.decompress(blob)
        n = struct.unpack_from("<q", raw)[0]
        head, at, parts = struct.unpack_from(f"<{2 * n}q", raw, 8), 8 + 16 * n, []
        for width, length in zip(head[::2], head[1::2], strict=True):
            parts.append(np.frombuffer(raw, f"<u{width}", length, at))
            at += width * length
        known = np.cumsum(parts[0], dtype=np.uint64)
        return cls([
            (np.concatenate([[0], np.cumsum(parts[i], dtype=np.int64)]), known[parts[i + 1]], parts[i + 2].astype(np.uint64))
            for i in range(1, n, 3)
        ])


def _within(length: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)


def summed(phrases: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and their summed counts."""
    order = np.lexsort(phrases.T[::-1])
    phrases, counts = phrases[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (phrases[1:] != phrases[:-1]).any(axis=1)]))
    return phrases[starts], np.add.reduceat(counts, starts)


def cut_by_range(lang: str, phrases: np.ndarray, counts: np.ndarray, ranges: int) -> dict:
    """Transducers of the rows of each prefix range."""
    at = prefix_range(phrases, ranges)
    order = np.lexsort((*phrases.T[::-1], at))
    phrases, counts, at = phrases[order], counts[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.append(starts[1:], len(at))
    blobs = [Automaton.build(phrases[a:b], counts[a:b]).dump() for a, b in zip(starts, ends, strict=True)]
    return {"lang": [lang] * len(starts), "size": [phrases.shape[1]] * len(starts), "part": at[starts], "blob": blobs}


BLOB = "lang string, size int, part bigint, blob binary"


def positions(hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in the filter, one row per probe."""
    step = mixed(hashes ^ MULTIPLIER) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(BITS - 1) for i in range(PROBES)])


def seen_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in positions(hashes):
        out &= (bits[(at >> np.uint64(6)).astype(np.intp)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return out


def phrase_hash(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), symbol(lang.encode()), np.uint64)
    for c in columns:
        h = h * MULTIPLIER + c
    return mixed(h ^ np.uint64(len(columns)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Word counts of a task, by language."""
    held: dict[str, Counter] = defaultdict(Counter)

    def emit(lang: str) -> dict:
        counts = held.pop(lang)
        counts.pop(BREAK, None)
        return {"lang": [lang] * len(counts), "word": [w.decode("utf-8", "replace") for w in counts], "f": list(counts.values())}

    for batch in batches:
        for lang, texts in by_language(batch).items():
            held[lang].update(pieces(texts))
            if len(held[lang]) > HELD_WORDS:
                yield emit(lang)
    for lang in list(held):
        yield emit(lang)


def by_language(batch: pa.RecordBatch) -> dict[str, list[str | None]]:
    out: dict[str, list[str | None]] = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        out[lang].append(text)
    return out


class Chunk:
    """Words of one language, numbered in order of appearance; 0 is the break between pieces."""

    def __init__(self, lang: str):
        self.lang, self.size = lang, 0
        self.number: dict[bytes, int] = defaultdict(lambda: len(self.number), {BREAK: 0})
        self.parts: list[np.ndarray] = []

    def add(self, texts: list[str | None]) -> None:
        words = pieces(texts)
        self.parts += [np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
        self.size += len(words)

    def phrases(self, sizes: list[int], filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Counted phrases of each size whose shorter phrases pass the filters (one for each length from 1 on)."""
        symbols = np.fromiter(map(symbol, self.number), np.uint64, len(self.number))
        known = seen_in(filters[0], phrase_hash(self.lang, [symbols]))
        known[0] = False
        compact = np.where(known, np.cumsum(known), 0)  # rare words end a phrase
        ids = compact[np.concatenate(self.parts)]
        symbols = np.concatenate([[np.uint64(0)], symbols[known]])
        at, fits = symbols[ids], ids > 0
        for size, bits in enumerate(filters[1:], 2):
            fits = fits[:-1] & fits[1:]
            where = np.flatnonzero(fits)
            fits[where] = seen_in(bits, phrase_hash(self.lang, [at[where + j] for j in range(size)]))
        inner, width = len(filters), 21 if len(ids) < 1 << 21 else 31
        for size in sizes:
            n = len(ids) - size + 1
            if n <= 0:
                continue
            start = np.ones(n, bool)
            for j in range(size - inner + 1):
                start &= fits[j : j + n]
            start = np.flatnonzero(start)
            if not len(start):
                continue
            code, room = ids[start].astype(np.int64), 63 // width - 1
            for j in range(1, size):
                if not room:  # the code is full: go on with its rank
                    code, room = np.unique(code, return_inverse=True)[1], 63 // width - 1
                code, room = (code << width) | ids[start + j], room - 1
            _, first, counts = np.unique(code, return_index=True, return_counts=True)
            yield np.stack([at[start[first] + j] for j in range(size)], axis=1), counts


def _counted(sizes: list[int], filters: list, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chunks: dict[str, Chunk] = {}
        held = 0
        bits = [b.value for b in filters]

        def flush() -> Iterator[dict]:
            for chunk in chunks.values():
                for phrases, counts in chunk.phrases(sizes, bits):
                    yield cut_by_range(chunk.lang, phrases, counts, ranges)
            chunks.clear()

        for batch in batches:
            for lang, texts in by_language(batch).items():
                if lang not in chunks:
                    chunks[lang] = Chunk(lang)
                chunks[lang].add(texts)
            held = sum(c.size for c in chunks.values())
            if held > CHUNK_WORDS:
                yield from flush()
        yield from flush()

    return run


def _single(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Transducers of single words."""
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            symbols, f = batch.column("symbol").to_numpy().view(np.uint64), batch.column("f").to_numpy()
            for lang in np.unique(langs):
                yield cut_by_range(str(lang), symbols[langs == lang][:, None], f[langs == lang], ranges)

    return run


def _united(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """One transducer of the frequent phrases of every (lang, size, part), which come sorted."""
        group, held, rows = None, [], 0

        def close() -> dict | None:
            phrases, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            frequent = counts >= least
            if not frequent.any():
                return None
            blob = Automaton.build(phrases[frequent], counts[frequent]).dump()
            return {"lang": [group[0]], "size": [group[1]], "part": [group[2]], "blob": [blob]}

        for batch in batches:
            for *key, blob in zip(*(batch.column(c).to_pylist() for c in ("lang", "size", "part", "blob")), strict=True):
                if group != key:
                    if held and (out := close()):
                        yield out
                    group, held, rows = key, [], 0
                held.append(Automaton.load(blob).paths())
                rows += len(held[-1][1])
                if rows > UNITE_ROWS and len(held) > 1:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    rows = len(held[0][1]) // 2  # the next union comes when as many rows again have arrived
        if held and (out := close()):
            yield out

    return run


def united(blobs: DataFrame, least: int) -> DataFrame:
    dealt = blobs.repartition("lang", "size", "part").sortWithinPartitions("lang", "size", "part")
    return written(map_arrow(dealt, _united(least), BLOB))


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            phrases, _ = Automaton.load(blob).paths()
            at = np.unique(positions(phrase_hash(lang, list(phrases.T))))
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            yield {"word": word[starts].view(np.int64), "bits": np.bitwise_or.reduceat(bit, starts).view(np.int64)}


def phrase_filter(automata: DataFrame, size: int):
    """The filter of all frequent phrases of a length, of fixed size, sent to the tasks."""
    rows = map_arrow(automata.filter(F.col("size") == size), _filter_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return automata.sparkSession.sparkContext.broadcast(bits)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            phrases, counts = Automaton.load(blob).paths()
            for k in range(0, len(counts), 50_000):
                rows = phrases[k : k + 50_000].view(np.int64)
                yield {"lang": [lang] * len(rows), "phrase": list(rows), "a": counts[k : k + 50_000]}


def _routed(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Wanted parts with the range of their prefix."""
        for batch in batches:
            lang, parts = batch.column("lang").to_pylist(), batch.column("wanted")
            size = np.array([len(p) for p in parts])
            at = np.zeros(len(parts), np.int64)
            for k in np.unique(size):
                rows = np.flatnonzero(size == k)
                at[rows] = prefix_range(parts.take(pa.array(rows)).flatten().to_numpy().view(np.uint64).reshape(-1, k), ranges)
            yield {"lang": lang, "size": size, "part": at, "blob": [None] * len(size), "wanted": parts}

    return run


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Counts of the wanted parts; a range's transducer comes before its parts."""
    group, automaton = None, None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "size", "part", "blob")), strict=True))
        k = 0
        while k < len(rows):
            lang, size, part, blob = rows[k]
            if blob is not None:
                group, automaton = (lang, size, part), Automaton.load(blob)
                k += 1
                continue
            end = k
            while end < len(rows) and rows[end][:3] == (lang, size, part) and rows[end][3] is None:
                end += 1
            wanted = batch.column("wanted").slice(k, end - k)
            asked = wanted.flatten().to_numpy().view(np.uint64).reshape(-1, size)
            found = automaton.counts(asked) if group == (lang, size, part) else np.zeros(end - k, np.int64)
            yield {"lang": [lang] * (end - k), "wanted": wanted, "f": found}
            k = end


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of 2 to ``longest`` words of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL")
    words = written(map_arrow(texts, _words, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ranges = max(1, (words.agg(F.sum("f")).first()[0] or 0) // RANGE_WORDS)
    names = words.filter(F.col("f") >= least).select("lang", "word", F.xxhash64("word").alias("symbol"), "f")
    twice = names.groupBy("lang", "symbol").agg(F.count("*").alias("c")).filter("c > 1").first()
    if twice:
        raise ValueError(f"two frequent words of language {twice['lang']} have one hash")

    automata = united(map_arrow(names.select("lang", "symbol", "f"), _single(ranges), BLOB), least)
    filters = [phrase_filter(automata, 1)]
    for sizes in [[k] for k in range(2, min(longest, 3) + 1)] + ([list(range(4, longest + 1))] if longest > 3 else []):
        longer = united(map_arrow(texts, _counted(sizes, list(filters), ranges), BLOB), least)
        if sizes[-1] < min(longest, 4):
            filters.append(phrase_filter(longer, sizes[-1]))
        automata = automata.union(longer)

    found = written(map_arrow(automata.filter("size > 1"), _listed, "lang string, phrase array<bigint>, a bigint"))
    size = F.size("phrase")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, size - F.col("k")).alias("right"))
    wanted = cuts.select("lang", F.explode(F.array("left", "right")).alias("wanted")).distinct()
    asked = map_arrow(wanted, _routed(ranges), f"{BLOB}, wanted array<bigint>")
    both = automata.withColumn("wanted", F.lit(None).cast("array<bigint>")).union(asked)
    walked = both.repartition("lang", "size", "part").sortWithinPartitions("lang", "size", "part", F.col("blob").isNull())
    counts = written(map_arrow(walked, _composed, "lang string, wanted array<bigint>, f bigint"))
    scored = cuts.join(counts.select("lang", F.col("wanted").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    scored = scored.join(counts.select("lang", F.col("wanted").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    scored = scored.withColumn("score", F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("cut")).select("lang", "phrase", "cut.*")
    # A phrase inside a longer one of the same count is inside one that is a single word longer, of the same count.
    inside = found.filter(size > 2).select("lang", "a", F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1))).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = written(least_cut.join(covered, ["lang", "phrase"], "left").filter("most IS NULL OR most < a").drop("most"))
    spelled = kept.select("lang", "phrase", F.posexplode("phrase").alias("at", "symbol")).join(names.select("lang", "symbol", "word"), ["lang", "symbol"])
    spelled = spelled.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("words"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "words")
    ranked = kept.join(spelled, ["lang", "phrase"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("words").alias("phrase"), "a", "l", "r", "n", "score")
