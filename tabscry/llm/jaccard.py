"""N-gram Jaccard join by PartEnum signatures: exact, no link is lost.

A document's set holds its distinct 5-word shingles. Sizes are cut into bands that grow by the threshold, so linked sets lie in
one band or in neighbouring ones. Instance j serves the pairs within band j-1 and between the bands j-1 and j; two linked sets of
these sizes differ in at most k shingles. For each instance

* the domain of all shingles is dealt by hash into n1 partitions of n2 parts each, the same parts for every set;
* a signature is the set's projection on a subset of the parts of one partition, and all subsets of a given size are enumerated:
  for k <= 3 one partition of k + 3 parts and all subsets of 3 parts; above that all single parts of pairs of parts.

At most k parts can differ, so some signature is equal on both sides. An empty projection says nothing and would be shared by
everything; there are ``spare`` more parts than k + 1, so a set with at most ``spare`` empty parts shares a signature that is not
empty, whatever the other set is. A set with more empty parts is signed again under the next deal of the domain; pairs of two such
sets meet there. Only a set that fails under all ``DEALS`` deals gives its empty projections as well.

Signatures travel packed by ranges of their value to tasks that look for equal ones. A signature that many rows of one batch
share is sent once and its rows go on directly. Sets that share a signature are candidates: each is compared on full sets with the
bucket's centre (the member with most bucket mates). Buckets that still hold several components are looked at member by member, in
blocks of bounded size. Members of the bucket's largest component need not meet each other, only the rest of the bucket, so a bucket
is read once if the rest fits a block. What meets is compared by parity maps: ``PARITY`` bits, each the parity of the set's shingles dealt to it. Two maps differ in no
more bits than the sets do in shingles, so what differs in more than k is out for good. The closest pairs that would join components
are compared on full sets; buckets where one of them fails are looked at again without the pairs that failed. What is open after
``ROUNDS`` rounds is compared on full sets throughout. Equal sets are one class, and classes are what is compared.

Nulls and edge cases: a null text or one without words has no shingles and is linked with nothing; fewer than 5 words are one
shingle; rows without id are linked with nothing; rows that share an id are one document and share their component; repeated texts
link to the smallest id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscry.llm import neardup
from tabscry.llm.common import map_arrow, prefilter_joins, written
from tabscry.llm.graph import components
from tabscry.llm.neardup import mixed, shingles
from tabscry.session import is_small

PERCENT = 80
DEALS = 6
SMALL_K, SUBSET = 3, 3
SLOT_SIGNATURES = 2_000_000  # about so many a slot
HELD = 3 * SLOT_SIGNATURES
BATCH_REPEATS = 8
BLOCK_ROWS, BLOCK_SHINGLES = 512, 120_000
LARGEST = 4  # so many times a block are the pieces of a bucket's largest component
PARITY = 2048
ROUNDS, TRIES = 5, 8
ENDS_BYTES = 8 * 1024 * 1024
ONE = np.uint64(1)


@lru_cache(maxsize=None)
def band(size: int, percent: int) -> int:
    """Number of the band of a set size."""
    low, number = 1, 0
    while low * 100 // percent < size:
        low, number = low * 100 // percent + 1, number + 1
    return number


@lru_cache(maxsize=None)
def distance(instance: int, percent: int) -> int:
    """k: in how many shingles two linked sets of an instance can differ."""
    low = 1
    for _ in range(instance - 1):
        low = low * 100 // percent + 1
    top = low * 100 // percent
    # |a| + |b| is largest for the top of the lower band and the largest size that can link with it.
    return (top + top * 100 // percent) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def constant(*numbers: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(repr(numbers).encode()))


def instance_signatures(items: np.ndarray, k: int, tag: int) -> list[np.ndarray]:
    """Signatures of one set in an instance with distance ``k``."""
    if k == 0:
        return [mixed(mixed(items).sum(keepdims=True) ^ constant(tag))]
    out = []
    for deal in range(DEALS):
        salt = constant(tag, deal)
        x = mixed(items ^ salt)
        parts, spare = (k + SUBSET, 0) if k <= SMALL_K else (k + 1 + 3 + k // 16, 3 + k // 16)
        parts += k > SMALL_K and parts % 2  # pairs of parts
        part = (((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.intp)
        count = np.bincount(part, minlength=parts)
        held = np.zeros(parts, np.uint64)
        np.add.at(held, part, mixed(x))
        last = deal == DEALS - 1
        if k <= SMALL_K:
            subsets = np.array(list(combinations(range(parts), SUBSET)))
            filled = count[subsets].sum(axis=1) > 0
            # A part's place in its subset is fixed, so the sum over places tells projections apart.
            own = mixed(mixed(held[subsets] + np.arange(1, SUBSET + 1, dtype=np.uint64) * salt).sum(axis=1) ^ mixed(np.arange(len(subsets), dtype=np.uint64) + salt))
            enough = filled.all()
        else:
            filled = count > 0
            own = mixed(held ^ mixed(np.arange(parts, dtype=np.uint64) + salt))
            enough = parts - filled.sum() <= spare
        out.append(own if last else own[filled])
        if enough:
            break
    return out


def signatures(items: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a non-empty set; the lowest bit tells that the set is of the instance's lower band."""
    at = band(len(items), percent)
    lower = instance_signatures(items, distance(at + 1, percent), at + 1)
    upper = instance_signatures(items, distance(at, percent), at) if at else []
    return np.concatenate([*(x | ONE for x in lower), *(x & ~ONE for x in upper)])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        size, digest = [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text)
            size.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        yield {"id": batch.column("id").to_pylist(), "n": size, "digest": digest, "node": [d and node_of(d) for d in digest]}


def node_of(digest: bytes) -> int:
    """A class's number while candidates are looked for; classes that share one are only compared needlessly."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _packed(percent: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Signatures of each set once a task, by slot."""
        seen: set[bytes] = set()
        for batch in batches:
            keys, nodes = [], []
            for text in batch.column("text").to_pylist():
                items = shingles(text)
                digest = xxhash.xxh3_128_digest(items.tobytes())
                if len(items) and digest not in seen:
                    seen.add(digest)
                    keys.append(signatures(items, percent))
                    nodes.append(np.full(len(keys[-1]), node_of(digest), np.int64))
            if not keys:
                continue
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            bucket = key >> ONE
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            length = np.diff(np.append(starts, len(key)))
            hot = np.repeat(length >= BATCH_REPEATS, length)
            packed = ~hot
            packed[(starts + length - 1)[length >= BATCH_REPEATS]] = True  # the last one has the lowest bit if any has
            slot = ((key >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
            for rows, sure in ((packed, False), (hot, True)):
                k, v, s = key[rows], node[rows], slot[rows].astype(np.int64)
                if len(k):
                    cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
                    yield {
                        "slot": s[np.concatenate([[0], cuts])], "sure": [sure] * (len(cuts) + 1),
                        "keys": np.split(k.view(np.int64), cuts), "nodes": np.split(v, cuts),
                    }

    return run


def shared(key: np.ndarray, node: np.ndarray, need_lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, node), and which of them lie in buckets with a mate and, if asked, a set of the lower band."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node = key[fresh], node[fresh]
    bucket = key >> ONE
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    length = np.diff(np.append(starts, len(key)))
    lower = np.bitwise_or.reduceat(key & ONE, starts) > 0
    return key, node, np.repeat((length > 1) & (lower | (not need_lower)), length)


def once(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The rows of one bucket of each membership; keys are sorted."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(starts, len(key)))
    member = mixed(node.view(np.uint64))
    marks = np.stack([length.astype(np.uint64), np.add.reduceat(member, starts), np.bitwise_xor.reduceat(mixed(member), starts)])
    first = np.unique(marks, axis=1, return_index=True)[1]
    return np.repeat(np.isin(np.arange(len(starts)), first), length)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """(key, node) of shared signatures; rows come sorted by slot, and a slot's distinct signatures fit a task."""
    slot, held, size, limit, whole = None, [], 0, HELD, True

    def settle(last: bool) -> Iterator[dict]:
        nonlocal held, size, limit, whole
        if not held:
            return
        key, node, met = shared(*(np.concatenate(x) for x in zip(*held, strict=True)), need_lower=last)
        k, v = key[met] >> ONE, node[met]
        if last and whole and len(k):
            rows = once(k, v)
            k, v = k[rows], v[rows]
        if len(k):
            yield {"key": k.view(np.int64), "node": v}
        if last:
            held, size, limit, whole = [], 0, HELD, True
        else:  # one member of each signature stays for those to come, one of the lower band where there is one
            stay = np.append((key >> ONE)[1:] != (key >> ONE)[:-1], True)
            held, size, whole = [(key[stay], node[stay])], int(stay.sum()), False
            limit = max(HELD, 2 * size)

    for batch in batches:
        for at, sure, keys, nodes in zip(*(batch.column(c) for c in ("slot", "sure", "keys", "nodes")), strict=True):
            key, node = keys.values.to_numpy().view(np.uint64), nodes.values.to_numpy()
            if sure.as_py():
                yield {"key": (key >> ONE).view(np.int64), "node": node}
                continue
            if at.as_py() != slot:
                yield from settle(True)
                slot = at.as_py()
            held.append((key, node))
            size += len(key)
            if size > limit:
                yield from settle(False)
    yield from settle(True)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        items = [shingles(t) for t in batch.column("text").to_pylist()]
        yield {"rep": batch.column("rep").to_pylist(), "items": [x.view(np.int64) for x in items], "parity": [parity(x) for x in items]}


def parity(items: np.ndarray) -> bytes:
    return np.packbits(np.bincount((mixed(items) % np.uint64(PARITY)).astype(np.intp), minlength=PARITY) & 1 > 0).tobytes()


def near_links(rep: list, comp: list, side: list[bool], sizes: list[int], maps: list[bytes], gone: list[list | None], percent: int, within: bool) -> list[tuple]:
    """Pairs of members that may be linked by their parity maps, closest first, up to ``TRIES`` for what would join components.

    ``gone`` lists what each member is known not to be linked with.
    """
    place = {r: i for i, r in enumerate(rep)}
    bits = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)
    n, comps, sides = np.array(sizes), np.unique(np.array(comp), return_inverse=True)[1], np.array(side)
    big = np.bincount(comps).argmax()
    found = []
    for i in np.flatnonzero(comps != big).tolist():  # pairs with the largest component are seen from the other end
        wanted = (comps != comps[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & ((comps == big) | (np.arange(len(rep)) > i))
        if not within:
            wanted &= sides != sides[i]
        wanted[[place[x] for x in gone[i] or () if x in place]] = False
        js = np.flatnonzero(wanted)
        apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1)
        near = apart <= (n[js] + n[i]) * (100 - percent) // (100 + percent)
        js, apart = js[near], apart[near]
        # For a member, the closest one of each other component is enough, and the closest ones of the largest.
        order = np.argsort(apart, kind="stable")
        of = comps[js[order]]
        first = np.union1d(np.unique(of, return_index=True)[1], np.flatnonzero(of == big)[:TRIES])
        found += [(int(apart[o]), i, int(js[o])) for o in order[first]]
    joined, taken, out = neardup.Union(), {}, []
    for _, i, j in sorted(found):
        ends = tuple(sorted((int(comps[i]), int(comps[j]))))
        if 0 < taken.get(ends, 0) < TRIES or (ends not in taken and joined.join(*ends)):
            taken[ends] = taken.get(ends, 0) + 1
            out.append((rep[i], rep[j]))
    return out


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows come sorted by bucket and block pair."""
        group, held = None, ([], [], [], [], [], [])

        def close() -> Iterator[dict]:
            if len(held[0]) > 1:
                links = near_links(*held, percent, group[1] == group[2])
                if links:
                    yield {"key": [group[0]] * len(links), "a": [x for x, _ in links], "b": [y for _, y in links]}
            for x in held:
                x.clear()

        for batch in batches:
            for key, low, high, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "rep", "component", "upper", "n", "parity", "gone")), strict=True):
                if group != (key, low, high):
                    yield from close()
                    group = (key, low, high)
                for x, v in zip(held, row, strict=True):
                    x.append(v)
        yield from close()

    return run


def needed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that few pairs name, without a shuffle of all sets; all sets for many pairs."""
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    return written(sets.join(F.broadcast(ends), "rep", "left_semi")) if is_small(ends, ENDS_BYTES) else sets


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``sets`` hold rep and items."""
    both = F.size(F.array_intersect("sa", "sb"))
    read = pairs.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("sb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("items").alias("sa")), "a")
    return written(read.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def blocked(cand: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, and into how many blocks their bucket's largest component and its rest go."""
    several = neardup.mixed_keys(cand, found)
    placed = written(cand.join(several, "key").join(found, F.col("rep") == found["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component")))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("load"))
    bucket = parts.groupBy("key").agg(F.max(F.struct("c", "component", "load")).alias("top"), F.sum("c").alias("c"), F.sum("load").alias("load"))
    blocks = lambda c, load, times: F.ceil(F.greatest(c / (times * BLOCK_ROWS), load / (times * BLOCK_SHINGLES))).cast("int")
    bucket = bucket.select(
        "key", F.col("top.component").alias("largest"),
        blocks(F.col("c") - F.col("top.c"), F.col("load") - F.col("top.load"), 1).alias("rest"), blocks(F.col("top.c"), F.col("top.load"), LARGEST).alias("pieces"),
    )
    return placed.join(bucket, "key").withColumn("big", F.col("component") == F.col("largest")).drop("largest")


def met_in_blocks(members: DataFrame) -> DataFrame:
    """The members dealt out to pairs of blocks (low, high) in which all pairs of different components meet.

    The rest's blocks are ``0 .. rest - 1``; the largest component's first piece joins each of them, the others follow.
    """
    own = F.when(F.col("big"), F.col("rest") - 1 + F.pmod(F.xxhash64("rep"), "pieces")).otherwise(F.pmod(F.xxhash64("rep"), "rest")).cast("int")
    last = F.when(F.col("big"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("pieces") - 2)
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("big") & (F.col("own") == F.col("rest") - 1)
    low, high = F.when(first, F.col("other")).otherwise(F.least("own", "other")), F.when(first, F.col("other")).otherwise(F.greatest("own", "other"))
    return spread.withColumns({"low": low, "high": high, "upper": F.col("big") | (F.col("own") > F.col("other"))}).drop("rest", "pieces", "big", "own", "other")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) after further links, from the links between components alone."""
    if links.isEmpty():
        return found
    of = lambda end, name: found.select(F.col("node").alias(end), F.col("component").alias(name))
    ends = links.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
    roots = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = found.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    return written(moved.select("node", F.coalesce("root", "component").alias("component")).union(roots.join(found, "node", "left_anti")))


def by_block(df: DataFrame) -> DataFrame:
    return df.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links with a Jaccard similarity of ``percent``)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = written(map_arrow(texts, _sized, f"id {kind}, n int, digest binary, node bigint"))
    has = rows.filter("n > 0 AND id IS NOT NULL")
    classes = has.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("node").alias("node"))

    total = has.agg(F.sum("n")).first()[0] or 0
    slots = max(8, int(0.6 * total) // SLOT_SIGNATURES)
    packs = map_arrow(texts.filter("id IS NOT NULL").select("text"), _packed(percent, slots), "slot bigint, sure boolean, keys array<bigint>, nodes array<bigint>")
    met = map_arrow(packs.repartition("slot").sortWithinPartitions("slot"), _met, "key bigint, node bigint")
    cand = written(met.join(classes, "node").select("key", "rep", "n").distinct())

    size = cand.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("load"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"))
    # Buckets with the same members are one.
    keys = size.filter("c > 1").groupBy("c", "s", "x").agg(F.min("key").alias("key"), F.first("load").alias("load"))
    cand = written(cand.join(keys.select("key", "c", "load"), "key"))
    mates = cand.groupBy("rep").agg(F.sum("c").alias("mates"))
    centre = cand.join(mates, "rep").groupBy("key").agg(F.max_by("rep", F.struct("mates", "n", "rep")).alias("a"), F.max_by("n", F.struct("mates", "n", "rep")).alias("na"))
    fits = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")
    pairs = written(cand.join(centre, "key").filter((F.col("rep") != F.col("a")) & fits).select("a", F.col("rep").alias("b")).distinct())

    prefilter_joins(docs.sparkSession)
    wanted = written(cand.groupBy("rep").agg(F.max("c").alias("c"))).filter("c > 1")
    sets = written(map_arrow(texts.join(wanted, texts["id"] == wanted["rep"]).select("rep", "text"), _sets, f"rep {kind}, items array<bigint>, parity binary"))
    final = components(verified(pairs, sets, percent))

    # With two members the centre has decided.
    cand = left = cand.filter("c > 2")
    gone = None
    for turn in range(ROUNDS + 1):
        members = blocked(left, final)
        if turn == ROUNDS:
            dealt = by_block(met_in_blocks(members.join(sets.select("rep", "items"), "rep")))
            final = merged(final, written(map_arrow(dealt, neardup._compared(percent), f"a {kind}, b {kind}")))
            break
        members = members.join(sets.select("rep", "parity"), "rep")
        if gone is None:
            members = members.withColumn("gone", F.lit(None).cast(f"array<{kind}>"))
        else:
            both = gone.union(gone.select("b", "a")).groupBy("a").agg(F.collect_set("b").alias("gone"))
            members = members.join(both.withColumnRenamed("a", "rep"), "rep", "left")
        near = written(map_arrow(by_block(met_in_blocks(members)), _near(percent), f"key bigint, a {kind}, b {kind}"))
        pairs = written(near.select("a", "b").distinct())
        close = verified(pairs, needed(sets, pairs), percent)
        failed = written(near.join(close, ["a", "b"], "left_anti"))
        final = merged(final, close)
        if failed.isEmpty():
            break
        new = failed.select("a", "b")
        gone = new if gone is None else gone.union(new)
        left = written(cand.join(failed.select("key").distinct(), "key", "left_semi"))

    groups = classes.join(final, classes["rep"] == final["node"], "left").select("digest", F.coalesce("component", "rep").alias("root"))
    out = rows.join(groups, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
