"""The PartEnum join: no linked pair without a shared signature, and components equal to brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from test_operators import BASE, EDGES, frame, passage, shingle_set

from tabscry.llm import jaccard


def brute(rows, percent=80):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingle_set(t))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: root(i) for i in sets}


def check(spark, rows, percent=80):
    got = jaccard.linked(frame(spark, [(i, t, "en") for i, t in rows]).repartition(3), percent=percent).collect()
    want = brute(rows, percent)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingle_set(t))) for i, t in rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 100, 400, 1500, 6000]:
        for _ in range(12 if size < 100 else 3):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            # The farthest set that still links: cut, grown, or part replaced.
            for gone, new in ((size - -(-size * percent // 100), 0), (0, size * 100 // percent - size), (size * (100 - percent) // (100 + percent),) * 2):
                b = np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
                if len(b) == 0:
                    continue
                both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                assert 100 * both >= percent * union
                x, y = (jaccard.signatures(np.unique(s), percent) for s in (a, b))
                met = np.intersect1d(x >> jaccard.ONE, y >> jaccard.ONE)
                assert len(met), (size, gone, new)
                lower = np.concatenate([x, y]) & jaccard.ONE > 0
                assert np.isin(met, np.concatenate([x, y])[lower] >> jaccard.ONE).any()


def test_other_sets_share_none():
    rng = np.random.default_rng(3)
    seen = Counter()
    for size in rng.integers(6, 300, 2000):
        seen.update(set((jaccard.signatures(rng.integers(0, 2**63, size).astype(np.uint64)) >> jaccard.ONE).tolist()))
    assert sum(c > 1 for c in seen.values()) <= 5


def test_parity_maps_never_differ_in_more_bits_than_the_sets(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 250)).astype(np.uint64)) for _ in range(2))
        maps = [np.frombuffer(jaccard.parity(x), np.uint64) for x in (a, b)]
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("rounds", [0, 1])
def test_what_is_open_after_the_rounds_is_compared_on_full_sets(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"x{rng.integers(0, 4)}" if rng.random() < 0.03 else w for w in BASE)) for i in range(60)]
    check(spark, rows, 75)


def test_edges(spark):
    check(spark, [(i, t) for i, t, _ in EDGES])


@pytest.mark.parametrize("percent", [60, 80])
def test_chains_and_hot_groups(spark, monkeypatch, percent):
    rng = np.random.default_rng(percent)
    rows = []
    for i in range(200):
        words = list(BASE[: 60 + i % 60])
        for at in rng.integers(0, len(words), rng.integers(0, 6)):
            words[at] = f"x{rng.integers(0, 3)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(passage(i, int(n)))) for i, n in enumerate(rng.integers(1, 12, 80))]
    rows += [(3000 + i, " ".join(passage(1, n, 3))) for i, n in enumerate(range(1, 40))]
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    check(spark, rows, percent)


def test_slots_that_do_not_fit_are_settled_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "HELD", 10)
    rng = np.random.default_rng(0)
    key, node = (rng.integers(0, 40, 300) << 3).astype(np.int64), rng.integers(0, 50, 300)
    batch = pa.RecordBatch.from_pydict({"slot": [0] * 100, "sure": [False] * 100, "keys": [k.tolist() for k in np.split(key | 1, 100)], "nodes": [n.tolist() for n in np.split(node, 100)]})
    got = {(k, n) for out in jaccard._met([batch]) for k, n in zip(out["key"].tolist(), out["node"].tolist(), strict=True)}
    rows = set(zip((key >> 1).tolist(), node.tolist(), strict=True))
    members = Counter(k for k, _ in rows)
    assert got == {(k, n) for k, n in rows if members[k] > 1}


def test_empty_table(spark):
    assert jaccard.linked(frame(spark, [])).count() == 0


def test_a_bucket_is_not_read_once_for_each_of_its_blocks(spark):
    n, rest = 6000, 40
    cand = spark.range(n).selectExpr("7L AS key", "id AS rep", "20 AS n", f"{n}L AS c", f"{20 * n}L AS load")
    found = spark.range(n - rest).selectExpr("id AS node", "0L AS component")
    rows = jaccard.met_in_blocks(jaccard.blocked(cand, found)).collect()
    assert len(rows) <= n + 3 * rest  # the rest once for each piece of the largest component
    assert Counter(r["rep"] for r in rows if r["rep"] < n - rest) == {i: 1 for i in range(n - rest)}


@pytest.mark.parametrize("largest", [3, 40, 150])
def test_all_pairs_of_different_components_meet(spark, monkeypatch, largest):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    n = 160
    component = [0 if i < largest else i - i % 2 for i in range(n)]
    cand = spark.range(n).selectExpr("7L AS key", "id AS rep", "20 AS n", f"{n}L AS c", f"{20 * n}L AS load")
    found = spark.createDataFrame(list(enumerate(component)), "node bigint, component bigint")
    groups = {}
    for r in jaccard.met_in_blocks(jaccard.blocked(cand, found)).collect():
        assert r["component"] == component[r["rep"]]
        groups.setdefault((r["low"], r["high"]), []).append((r["rep"], r["upper"]))
    met = Counter()
    for (low, high), members in groups.items():
        met.update(tuple(sorted((a, b))) for (a, x), (b, y) in combinations(members, 2) if component[a] != component[b] and (low == high or x != y))
    assert met == {(a, b): 1 for a, b in combinations(range(n), 2) if component[a] != component[b]}


def test_few_pairs_do_not_move_all_sets(spark, tmp_path):
    spark.range(1000).selectExpr("id AS rep", "array(id) AS items", "binary('x') AS parity").write.parquet(str(tmp_path / "sets"))
    spark.createDataFrame([(3, 5), (5, 9), (7, 2000)], "a bigint, b bigint").write.parquet(str(tmp_path / "pairs"))
    sets, pairs = (spark.read.parquet(str(tmp_path / name)) for name in ("sets", "pairs"))
    assert sorted(r["rep"] for r in jaccard.needed(sets, pairs).collect()) == [3, 5, 7, 9]
