"""Every training-data operator on small frames with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscry.llm import common, decontam, idcoder, langid, neardup, packing, pii, quality, search, substrings, urlrep
from tabscry.llm.queries import ORACLES, QUERIES

CLASH = ", id long, mark long, words string, score double, n_words long, own int, rep long, component_id long"


def frame(spark, rows, extra=True):
    data = [(i, t, lang) + ((7, 1, "w", 0.5, 3, 1, 2, 9) if extra else ()) for i, t, lang in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string" + (CLASH if extra else ""))


def passage(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


BASE = passage(1, 120)
EDGES = [
    (1, " ".join(BASE), "en"),
    (2, " ".join(BASE), "en"),  # exact copy
    (3, " ".join([*BASE[:60], "changed", *BASE[61:]]).upper(), "en"),  # near copy in capitals
    (4, None, "en"),
    (5, "", None),
    (6, " \n\t ", "de"),
    (7, "one two", "de"),
    (8, "one two", "de"),
    (9, " ".join(passage(2, 30_000, 5000)), "fr"),  # very long
    (10, " ".join([*passage(3, 40), *BASE[20:90], *passage(4, 40)]), "fr"),
    (10, "the same id with another text", "fr"),
    (11, "same same same same same same same same", "en"),
    (11, "same same same same same same same same", "en"),  # a repeated row
    (None, " ".join(BASE), "en"),
    (12, "é ß ☃ 漢字 \u2028 a\x00b", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, EDGES).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows, percent=85):
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


def check_components(spark, rows, **how):
    got = neardup.near_duplicates(frame(spark, [(i, t, "en") for i, t in rows]), **how).collect()
    want = brute_components(rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingle_set(t))) for i, t in rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_near_duplicates_edges(spark):
    check_components(spark, [(i, t) for i, t, _ in EDGES])


def test_near_duplicates_of_one_hot_group_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        words = list(BASE)
        for at in rng.integers(0, len(words), rng.integers(0, 5)):
            words[at] = f"x{rng.integers(0, 3)}"
        rows.append((1000 - i, " ".join(words)))
    check_components(spark, rows, block=16)


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(0)
    one = neardup.sketch(np.array([5], np.uint64))
    assert (one < np.iinfo(np.uint64).max).all()
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    agree = np.mean([(neardup.sketch(x + np.uint64(s), 256) == neardup.sketch(y + np.uint64(s), 256)).mean() for s in range(20)])
    assert abs(agree - 800 / 1200) < 0.03


def without_windows(rows, window):
    words = {k: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for k, (_, t) in enumerate(rows)}
    least = {}
    for k, (i, _) in enumerate(rows):
        for p in range(len(words[k]) - window + 1 if i is not None else 0):
            g = tuple(words[k][p : p + window])
            least[g] = min(i, least.get(g, i))
    out = []
    for k, (i, _) in enumerate(rows):
        gone = set()
        for p in range(len(words[k]) - window + 1 if i is not None else 0):
            if least[tuple(words[k][p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(w for q, w in enumerate(words[k]) if q not in gone)
        out.append((i, len(words[k]), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("window", "bucket"), [(50, 2000), (50, 2), (10, 1), (4, 3)])
def test_substrings(spark, docs, window, bucket):
    got = substrings.without_repeats(docs, window=window, bucket_runs=bucket)
    assert Counter(map(tuple, got.collect())) == without_windows([(i, t) for i, t, _ in EDGES], window)


def test_substrings_of_a_common_passage(spark):
    rows = [(i, " ".join([*passage(100 + i, 20), *BASE[: 40 + i % 30], *passage(200 + i, 20)])) for i in range(60)]
    got = substrings.without_repeats(frame(spark, [(i, t, "en") for i, t in rows]), window=12, bucket_runs=4)
    assert Counter(map(tuple, got.collect())) == without_windows(rows, 12)


def test_decontamination(spark, docs):
    items = spark.createDataFrame(
        [(1, " ".join(BASE[30:45])), (2, "ONE two"), (3, None), (4, ""), (5, " ".join(BASE[30:45])), (None, "漢字"), (20, "same same")], "item_id long, text string"
    )
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = defaultdict(set)
    for r in items.collect():
        w = words(r["text"])
        for p in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[p : p + 10])].add(r["item_id"])
    want = []
    for i, t, _ in EDGES:
        w, hit, found = words(t), set(), set()
        for size in {len(g) for g in grams}:
            for p in range(len(w) - size + 1):
                g = tuple(w[p : p + size])
                if g in grams:
                    hit.update(range(p, p + size))
                    found |= grams[g] - {None}
        listed = ",".join(sorted(map(str, found)))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    for limit in (10**6, 0):  # broadcast, and the way beyond its bound
        got = decontam.contamination(docs, items, broadcast_grams=limit)
        assert Counter(map(tuple, got.collect())) == Counter(want)
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns
    # Row by row: a clean row stays, also when another row of the same (or no) id is hit.
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, *_, b in want if not b)
    left = {r["doc_id"]: r["text"] for r in decontam.without_spans(docs, items).collect() if r["doc_id"] in (1, 7)}
    assert left[7] == "" and "w" in left[1] and len(words(left[1])) == 105


def test_decontamination_without_or_with_repeated_ids(spark):
    """Each row is judged by its own text, whatever its id; columns may carry the names of the joined ones."""
    hit, other = " ".join(passage(5, 30)), " ".join(passage(6, 30, 90))
    items = spark.createDataFrame([("a", " ".join(passage(5, 30)[4:18]))], "item_id string, text string")
    rows = [(None, hit, 1, "x"), (None, other, 2, "x"), (3, hit, 3, "x"), (3, other, 4, "x"), (4, None, 5, "x"), (4, other, 6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, hit_text string")
    assert sorted(r["spans"] for r in decontam.clean_documents(docs, items).collect()) == [2, 4, 5, 6]
    left = decontam.without_spans(docs, items).collect()
    cut = " ".join([*passage(5, 30)[:4], *passage(5, 30)[18:]])
    assert Counter(map(tuple, left)) == Counter([(None, cut), (None, other), (3, cut), (3, other), (4, ""), (4, other)])
    none = items.limit(0)
    assert decontam.clean_documents(docs, none).count() == 6 and decontam.without_spans(docs.limit(0), items).count() == 0


def test_url_judgement(spark):
    rows = [(1, "HTTPS://A.B.example.COM/en/x?q#f"), (2, "https://www.example.com/en/"), (3, "no scheme"), (4, None), (5, "x://h.net"), (6, "x://h.net/es/1"), (6, "x://h.net/es/1"), (7, "http://h.net/fr?x"), (8, "x://com/a"), (9, "x://xcom/a"), (10, "")]
    rows += [(100 + i, f"http://bad.org/{i}") for i in range(60)] + [(300 + i, f"http://good.org/{i}") for i in range(60)]
    pages = spark.createDataFrame([(i, u, "x", 0.1) for i, u in rows], "page_id long, url string, host string, mean double")
    marks = spark.createDataFrame([(i, int(100 <= i < 160)) for i, _ in rows if i >= 100 and i != 159] + [(None, 1), (5, None)], "page_id long, bad int")
    got = {r["page_id"]: r for r in urlrep.judge(pages, marks).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.b.example.com", "/en/x", "example.com/en/", "block")
    assert (got[2]["rule"], got[2]["verdict"]) == ("www.example.com/en/", "allow")
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == ("", "", None, "allow") for i in (3, 4, 10))
    assert (got[5]["path"], got[5]["rule"]) == ("", None) and got[6]["verdict"] == "block" and got[7]["rule"] is None
    assert got[8]["rule"] == "com/" and got[9]["rule"] is None
    assert got[159]["verdict"] == "block" and got[300]["verdict"] == "allow"  # 159 itself is not labelled
    assert urlrep.judge(pages, marks).count() == len(rows)
    assert urlrep.judge(pages, marks.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0
    assert urlrep.judge(pages.limit(0), marks).count() == 0
    kept = urlrep.allowed(pages, marks)
    assert kept.columns == pages.columns
    judged = [r["page_id"] for r in urlrep.judge(pages, marks).collect() if r["verdict"] == "allow"]
    assert Counter(r["page_id"] for r in kept.collect()) == Counter(judged)
    same_id = spark.createDataFrame([(None, "x://h.net/es/1", 1), (None, "x://h.net", 2), (7, "x://h.net/fr/", 3), (7, "x://com/a", 4)], "page_id long, url string, bad_host int")
    assert sorted(r["bad_host"] for r in urlrep.allowed(same_id, marks).collect()) == [2, 4]


def test_samples_stay_bounded_and_keep_rare_languages(spark):
    """Missing and repeated ids do not exceed a sample's bound; every language is learned at any size."""
    rows = [(None, f"t{i}", "en") for i in range(3000)] + [(7, f"u{i}", "en") for i in range(3000)] + [(i + 10, f"v{i}", "en") for i in range(3000)]
    rows += [(None, "same text", "en")] * 1000 + [(20_000 + i, "xylo quorb", "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string").repartition(4)
    got = common.sample_by_id(docs, len(rows), 500).collect()
    assert 200 <= len(got) <= 600 and len({r["id"] for r in got if r["id"] is not None}) == sum(r["id"] is not None for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, common.sample_by_id(docs.repartition(9), len(rows), 500).collect()), key=str)
    assert common.sample_by_id(docs, len(rows), len(rows)).count() == len(rows)
    model = langid.fit(docs, F.lit(True), doc_id="id", max_docs=300, lang_docs=20)
    assert model.langs == ["en", "rare"] and model.score("xylo quorb")[0] == "rare"


def test_suffixes_of_two_labels_against_sql(spark, tmp_path):
    """Hosts below suffixes such as co.uk get the same levels in the job and in its SQL."""
    hosts = ["a.one.co.uk", "b.one.co.uk", "two.co.uk", "co.uk", "uk", "x.three.com.au", "four.com", "www.four.com", "net"]
    pages = [(i, f"http://{hosts[i % len(hosts)]}/p{i}") for i in range(180)]
    marks = [(i, i % 3 % 2, int(i % len(hosts) < 2)) for i in range(0, 180, 2)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op7_url_reputation"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(ORACLES["op7_url_reputation"]).df()
    columns = ["page_id", "host", "path", "rule", "verdict"]
    clean = lambda f: Counter(map(tuple, f[columns].astype(object).where(f[columns].notna(), None).to_numpy().tolist()))
    assert clean(got) == clean(want) and set(got["verdict"]) == {"allow", "block"}


def test_packing(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, end_id=1, with_ids=True).collect()
    want = Counter((i, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t, _ in EDGES)
    sequences = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append(r)
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        assert sum(r["length"] for r in rows) <= 2048
    # Distinct ids: whole documents come back from their pieces.
    whole = defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append((r["start"], r["ids"]))
    for i in {i for i, *_ in EDGES} - {10, 11}:
        ids = b"".join(x for _, x in sorted(whole[i]))
        assert (i, zlib.crc32(ids)) in want
    assert sum(r["length"] for r in got) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in EDGES)


def test_packer_cuts_exactly_and_hardly_pads():
    rng = np.random.default_rng(3)
    p = packing.Packer(0, 2048, 50, 4)
    sizes = [int(x) for x in rng.integers(1, 5000, 300)]
    for k, n in enumerate(sizes):
        p.add((k, np.full(n, k, "<u4").tobytes(), n))
    p.pack(last=True)
    total, got, seen = Counter(), Counter(), defaultdict(set)
    for doc, start, length, ids, *_, sequence, offset, tier, _ in p.flush():
        total[sequence] += length
        got[doc] += length
        assert length == len(ids) // 4 and total[sequence] <= tier <= 2048
        seen[doc].add(start)
    assert [got[k] for k in range(300)] == sizes
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in total.values())
    assert padding <= 2048


def test_token_files(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in idcoder.encoded(docs, path, end_id=2).collect())
    order, want, at = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), [], 0
    for i, t, _ in order:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


@pytest.mark.parametrize("sizes", [[1], [5, 4096, 17], [3] * 40])
def test_coder_round_trip(sizes):
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.3, n).clip(0, 65535) for n in sizes] + [np.zeros(50, int), np.full(30, 65535)]
    coded = idcoder.encode_blocks(blocks)
    back = idcoder.decode_blocks(coded, [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    assert len(coded[-2]) < 50


def test_damaged_block_is_refused(spark, tmp_path, docs):
    path = str(tmp_path / "ids")
    idcoder.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2, path)
    flip = F.concat(F.expr("substring(payload, 1, 12)"), F.unhex(F.lit("00000000")), F.expr("substring(payload, 17)"))
    spark.read.parquet(path).withColumn("payload", flip).write.parquet(path + "-bad")
    with pytest.raises(Exception, match="damaged"):
        idcoder.read_documents(spark, path + "-bad").collect()


def test_base_spans_match_plain_patterns():
    def plain(t):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for k, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
            for m in re.finditer(pattern, t):
                d = re.sub("[^0-9]", "", m[0])
                if low <= len(d) <= high and (k == 3 or pii.luhn(d)):
                    out.append((k, *m.span()))
        return out

    rng = np.random.default_rng(2)
    for _ in range(20_000):
        t = "".join(rng.choice(list("a.@+1 -9(3)_%2.Z\n@"), rng.integers(0, 50)))
        assert plain(t) == pii.base_spans(t), t
    assert pii.base_spans("x" * 200_000 + "1" * 200_000) == []
    assert pii.joined(pii.base_spans("4539 1488 0343 6467")) == "card:0:19"


def test_personal_data_model(spark, docs, sf_dir):
    tagger = pii.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rng = np.random.default_rng(11)
    right, wrong = 0, 0
    for _ in range(200):
        kind, item = pii.variant(rng)
        text = f"some words before {item} and some after"
        spans = pii.tag_texts([text], tagger)[0][1]
        right += any(k == kind and a >= 18 and b <= 18 + len(item) for k, a, b in spans) if kind >= 0 else 0
        wrong += kind < 0 and bool(spans)
    assert right > 120 and wrong <= 2
    rows = pii.find(docs, tagger).collect()
    assert len(rows) == len(EDGES) and all(r["n_email"] == 0 for r in rows)
    one = frame(spark, [(1, "mail a.b@c.example.org or +1 (706) 555-3138, host 10.0.0.1.", "en"), (2, None, "en")])
    out = pii.redacted(one, tagger)
    assert out.columns == one.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE], host [IP].", None]


SPELLED_OUT = [
    "jane.doe [AT] example [DOT] com",
    "jane.doe{at}example{dot}com",
    "jane at example dot com",
    "jane.doe\uff20example.com",
    "Jane (At) Example (Dot) Org",
]
LONG = [
    "alexander.montgomery-smith [at] example [dot] org",
    "maximiliana.konstantinopolska-featherstonehaugh.the.third.of.her.name [at] example [dot] org",
    "jane.doe [at] department-of-rather-long-names [dot] faculty-of-even-longer-names [dot] example [dot] org",
]


@pytest.fixture(scope="module")
def tagger(spark, sf_dir):
    return pii.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@pytest.mark.parametrize("item", LONG)
def test_long_addresses_are_found_whole(tagger, item):
    for before, after in (("Please write to ", " before noon."), ("", ""), ("word " * 30 + "mail: ", " and " + "more words " * 20)):
        text = before + item + after
        assert pii.tag_texts([text], tagger)[0][1] == [(0, len(before), len(before) + len(item))], text
        assert pii.redact(text, pii.tag_texts([text], tagger)[0][1]) == f"{before}[EMAIL]{after}"


@pytest.mark.parametrize("item", SPELLED_OUT)
def test_at_signs_in_any_spelling_are_read(tagger, item):
    text = f"Please write to {item} before noon."
    assert pii.tag_texts([text], tagger)[0][1] == [(0, 16, 16 + len(item))]


def test_digits_of_any_script_are_read(tagger):
    item = "4539 1488 0343 6467".translate({48 + d: 0x660 + d for d in range(10)})
    assert pii.tag_texts([f"the card is {item} and more"], tagger)[0] == ([], [(2, 12, 31)])
    assert pii.tag_texts(["look at example.com, then at the red dot there"], tagger)[0][1] == []


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 1), (7, 0), (9, 1), (11, 0), (None, 1), (12, None), (77, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    rows = quality.classify(docs, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (4, 5, 6)} == {next(r["score"] for r in rows if r["doc_id"] == 4)}
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.kept_documents(docs, none).columns == docs.columns


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_language(spark, docs):
    model = langid.fit(docs, F.lit(True))
    assert model.langs == ["de", "en", "fr"]
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        if r["doc_id"] in (4, 5, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] == 7:
            assert r["lang_pred"] == "de"
    assert model.score("twos")[0] == "de"  # unseen: by its grams
    none = langid.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_search(spark, docs):
    got = defaultdict(list)
    for r in search.top_k(docs, "id % 1 = 0", k=3, query_block=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    rows = [(i, search.terms(t)) for i, t, _ in EDGES]
    n, mean = len(rows), sum(len(w) for _, w in rows) / len(rows)
    df = Counter(t for _, w in rows for t in set(w))
    assert set(got) <= {i for i, _ in rows}
    for i in (1, 3, 7, 9):
        own = sorted((df[t], t) for t in set(next(w for k, w in rows if k == i)) if df[t] > 1)[:8]
        scores = []
        for k, w in rows:
            s = sum(np.log(1 + (n - d + 0.5) / (d + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for d, t in own if t in w)
            if s and k is not None:
                scores.append((-round(float(s), 6), k))
        assert [(d, -s) for d, s in got[i]] == [(k, s) for s, k in sorted(scores)[:3]]


def test_search_with_every_term_of_the_query(spark, docs, sf_dir):
    def want(rows, asked, k):
        words = [(i, search.terms(t)) for i, t in rows]
        n, mean = len(words), sum(len(w) for _, w in words) / len(words)
        held = [(i, Counter(w), len(w)) for i, w in words]
        df = Counter(t for _, c, _ in held for t in c)
        for q in asked:
            own = {t for i, c, _ in held if i == q for t in c}
            scores = [(i, sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * m / mean)) for t in own & set(c))) for i, c, m in held if i is not None]
            yield q, sorted(((i, float(s)) for i, s in scores if s), key=lambda x: (-round(x[1], 6), x[0]))[:k]

    def got(out):
        found = defaultdict(list)
        for r in out.orderBy("query_id", "rank").collect():
            found[r["query_id"]].append((r["doc_id"], r["score"]))
        return found

    corpus = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    query = QUERIES["op3_search"](spark, sf_dir)
    edges = search.top_k(docs, "id % 1 = 0", k=3, query_terms=None, query_block=4)
    for rows, out, asked, k in ((corpus, query, [i for i, _ in corpus if i % 20 == 0], 10), ([x[:2] for x in EDGES], edges, {i for i, *_ in EDGES} - {None}, 3)):
        found = got(out)
        for q, best in want(rows, asked, k):
            assert [i for i, _ in found[q]] == [i for i, _ in best]
            assert np.allclose([s for _, s in found[q]], [s for _, s in best], rtol=0, atol=2e-6)


def test_search_in_rounds_returns_few_rows(spark, monkeypatch):
    words = [f"w{j}" for j in range(40)]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30)).tolist()), "en") for i in range(240)]
    rows += [(300 + i, rows[i % 3][1], "en") for i in range(30)] + [(i, rows[i][1], "en") for i in range(3)]  # copies, repeated ids
    made = []
    plain = search.written
    monkeypatch.setattr(search, "written", lambda df: made.append(plain(df)) or made[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(24)
    out = {}
    for name, first in (("one", 10_000), ("many", 40)):
        monkeypatch.setattr(search, "FIRST_DOCS", first)
        monkeypatch.setattr(search, "FIRST_TASKS", 2)
        monkeypatch.setattr(search, "GROWTH", 2)
        made.clear()
        out[name] = search.top_k(docs, "id % 5 = 0", k=4, query_terms=None).orderBy("query_id", "rank").collect()
        found = [d for d in made if "query_id" in d.columns]
        queries = len({r["query_id"] for r in out[name]})
        # A search of 24 shards by themselves returns up to 24 * 4 rows a query.
        assert len(found) == {"one": 1, "many": 4}[name] and sum(d.count() for d in found) <= 8 * 4 * queries
    assert out["one"] == out["many"]
    words = [(i, search.terms(t)) for i, t, _ in rows]
    n, mean = len(words), sum(len(w) for _, w in words) / len(words)
    df = Counter(t for _, w in words for t in set(w))
    for q in (0, 5, 300, 305):
        own = {t for i, w in words if i == q for t in w}
        scores = [(i, sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in own & set(w))) for i, w in words]
        want = sorted(((-round(float(s), 6), i) for i, s in scores if s))[:4]
        assert [r["doc_id"] for r in out["many"] if r["query_id"] == q] == [i for _, i in want]


def test_runs_of_an_index_carry_floors(monkeypatch):
    monkeypatch.setattr(search, "RUN_DOCS", 7)
    monkeypatch.setattr(search, "WAND_POSTINGS", 6)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{j}" for j in range(25)], rng.integers(0, 20)).tolist()) for _ in range(60)] + ["w1 w2 w3"] * 20
    codes = [np.array(sorted(rng.choice(25, size, replace=False))) for size in (1, 2, 3, 8, 9, 20, 25)]
    idf = rng.random(25) + 0.1
    queries = type("Sent", (), {"value": ([f"w{j}" for j in range(25)], idf, list(range(7)), [0, *np.cumsum([len(c) for c in codes]).tolist()], np.concatenate(codes))})
    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, a + 5)), "text": texts[a : a + 5]}) for a in range(0, 80, 5)]
    got = defaultdict(list)
    for out in search._searched(queries, None, 9.0, 3)(iter(batches)):
        for q, i, s in zip(out["query_id"], out["doc_id"], out["score"], strict=True):
            got[q].append((-s, i))
    for q, own in enumerate(codes):
        scores = []
        for i, t in enumerate(texts):
            w = search.terms(t)
            s = sum(idf[j] * w.count(f"w{j}") * 2.2 / (w.count(f"w{j}") + 1.2 * (0.25 + 0.75 * len(w) / 9.0)) for j in own.tolist() if f"w{j}" in w)
            if s:
                scores.append((-round(float(s), 6), i))
        assert [i for _, i in got[q]] == [i for _, i in sorted(scores)[:3]]


def test_terms_of_many_batches_are_numbered_at_once(monkeypatch):
    texts = [f"w{i % 7} w{i % 3} other" if i % 5 else None for i in range(200)]
    queries = type("Sent", (), {"value": ([f"w{j}" for j in range(7)], np.ones(7), [0, 1], [0, 3, 7], np.arange(7))})
    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, a + 10)), "text": texts[a : a + 10]}) for a in range(0, 200, 10)]
    calls, numbered = [], search.numbered_terms
    monkeypatch.setattr(search, "numbered_terms", lambda t: calls.append(len(t)) or numbered(t))
    out = {}
    for at_once in (10, 4096):
        monkeypatch.setattr(search, "ADD_DOCS", at_once)
        out[at_once] = list(search._searched(queries, None, 3.0, 5)(iter(batches)))
    assert out[10] == out[4096] and len(out[10][0]["score"]) == 10
    assert calls == [10] * 20 + [0, 200]


def test_texts_are_read_once_for_all_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(11)
    docs = spark.createDataFrame([(i, " ".join(rng.choice([f"w{j}" for j in range(50)], rng.integers(0, 30)).tolist())) for i in range(150)], "doc_id long, text string")
    seen, plain = [], search.map_arrow
    monkeypatch.setattr(search, "map_arrow", lambda df, *a: seen.append(df.columns) or plain(df, *a))
    monkeypatch.setattr(search, "FIRST_DOCS", 60)
    out = {}
    for block in (1000, 4):
        seen.clear()
        out[block] = search.top_k(docs, "id % 5 = 0", k=4, query_terms=None, query_block=block).orderBy("query_id", "rank").collect()
        # Once to count terms, once for the queries, once for each of the two rounds.
        assert sum("text" in columns for columns in seen) == 4
    assert out[1000] == out[4] and len(seen) > 8


def test_written_rows_are_indexed_as_texts_are(monkeypatch):
    monkeypatch.setattr(search, "RUN_DOCS", 40)
    monkeypatch.setattr(search, "PACK_DOCS", 15)
    rng = np.random.default_rng(12)
    words = [f"w{j}" for j in range(30)] + ["\u00e9t\u00e9", "\u6771\u4eac"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40)).tolist()) for _ in range(95)] + ["w1 " * 300, None, " ", "w2"]
    ids = [None, *range(1, 99)]
    batches = [pa.RecordBatch.from_pydict({"id": ids[a : a + 10], "text": texts[a : a + 10]}) for a in range(0, 99, 10)]
    vocabulary, idf = pa.array(words[:28:2] + words[30:] + ["none"]), rng.random(17) + 0.1
    rows = [{c: (pa.array(v) if c == "id" else pa.array(v, pa.binary())) for c, v in row.items()} for row in search._packed(iter(batches))]
    assert len(rows) == 5 and {len(row["tf"][0].as_py()) // (len(row["term"][0].as_py()) // 4) for row in rows} == {1, 2}
    own, scores = rng.permutation(17).astype(np.int32), []
    for given in (batches, [pa.RecordBatch.from_pydict(row) for row in rows]):
        found, runs = {}, 0
        for index in search.indexes(iter(given), lambda: search.Index(vocabulary, idf, 9.0)):
            whole, few = index.summed(own), index.score(own, np.arange(len(index.ids)))
            assert whole.tolist() == few.tolist() and sorted(index.ids) == index.ids
            found |= dict(zip(index.ids, whole.tolist(), strict=True))
            runs += 1
        assert runs > 1
        scores.append(found)
    assert scores[0] == scores[1] and 90 < len(scores[0]) < 98 and 96 not in scores[0]


def test_lists_multiplied_sliced_and_gathered_give_the_sums(monkeypatch):
    monkeypatch.setattr(search, "DENSE_SHARE", 0.3)
    monkeypatch.setattr(search, "SHORT", 6)
    monkeypatch.setattr(search, "MATRIX_QUERIES", 7)
    monkeypatch.setattr(search, "WAND_POSTINGS", 3)
    rng = np.random.default_rng(13)
    share = np.array([0.6] * 5 + [0.15] * 20 + [0.02] * 40)
    index = search.Index(pa.array([f"w{j}" for j in range(65)]), rng.random(65) + 0.1, 12.0)
    index.add(list(range(200)), [" ".join(f"w{j}" for j in np.flatnonzero(rng.random(65) < share)) for _ in range(200)])
    index.close()
    assert 4 <= len(index.matrix) <= 6 and len(index.slices[0]) >= 25 and np.count_nonzero(index.slot < 0) >= 20
    queries = [rng.permutation(65)[:size] for size in (65, 30, 12, 3, 1, 0, 9, 40, 2, 20)] + [np.arange(5), np.arange(5, 25), np.arange(25, 65)]
    for floor in (0.0, 1.5):
        for own, best in zip(queries, index.best(queries, np.full(len(queries), floor), 6), strict=True):
            total = np.round(index.summed(own), 6)
            order = sorted(np.flatnonzero(index.summed(own)).tolist(), key=lambda d: (-total[d], d))[:6]
            assert best == [(total[d], d) for d in order if total[d] >= floor]


def test_candidates_are_scored_as_whole_lists_are():
    rng = np.random.default_rng(6)
    index = search.Index(pa.array([f"w{j}" for j in range(40)]), rng.random(40) + 0.1, 12.0)
    index.add(list(range(90)), [" ".join(rng.choice([f"w{j}" for j in range(60)], rng.integers(0, 30)).tolist()) for _ in range(90)])
    index.close()
    for size in (0, 1, 7, 40):
        own = rng.permutation(40)[:size]
        docs = np.sort(rng.choice(len(index.ids), 20, replace=False))
        assert index.score(own, docs).tolist() == index.summed(own)[docs].tolist()
    assert index.score(own, docs[:0]).tolist() == []


def test_block_max_wand_matches_full_scoring():
    rng = np.random.default_rng(8)
    for _ in range(60):
        lists = []
        for _ in range(rng.integers(1, 6)):
            p = search.Postings()
            p.docs = sorted(rng.choice(600, rng.integers(1, 400), replace=False).tolist())
            p.weights = rng.random(len(p.docs)).tolist()
            p.close(float(rng.random() * 3 + 0.1))
            lists.append(p)
        total = defaultdict(float)
        for p in lists:
            for d, w in zip(p.docs, p.weights, strict=True):
                total[d] += w
        want = sorted(((-round(s, 6), d) for d, s in total.items()))[:10]
        assert sorted((-s, -d) for s, d in search.search(lists, 10)) == want


def test_empty_tables(spark, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        neardup.near_duplicates(nothing), substrings.without_repeats(nothing), decontam.contamination(nothing, items), packing.pack(nothing, path, 1),
        idcoder.encoded(nothing, path, 2), search.top_k(nothing, "id % 20 = 0"), pii.find(nothing, pii.fit(nothing, made=50, steps=2)),
    ):
        assert out.count() == 0 and out.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir) is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op2_quality_classifier"](spark, sf).join(labels, "doc_id").filter("held_out")
    assert out.filter("predicted = quality").count() >= 0.95 * out.count()
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op9_language_id"](spark, sf).join(lang, "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() >= 0.98 * out.count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "benchmark_decontamination", "personal_data", "packing"]
    seen = []
    at = docs
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf_dir).cache()
        seen.append(at)
    rejected, single, clean, redacted, packed = (x.toPandas() for x in seen)
    assert all(set(x.columns) == set(docs.columns) for x in (rejected, single, clean, redacted))
    roots = brute_components(list(zip(rejected.doc_id.tolist(), rejected.text.tolist(), strict=True)), 80)
    assert sorted(single.doc_id) == sorted({i for i, r in roots.items() if i == r})
    hits = decontam.contamination(seen[1], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("NOT contaminated")
    assert sorted(clean.doc_id) == sorted(r["doc_id"] for r in hits.collect())
    assert sorted(redacted.doc_id) == sorted(clean.doc_id)
    assert not any(pii.base_spans(t) for t in redacted.text) and (redacted.n_chars == redacted.text.str.len()).all()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(redacted.doc_id, redacted.text, strict=True)}
    assert packed.groupby("doc_id").length.sum().to_dict() == want


def test_pipeline_removes_near_copies_from_080(spark, sf_dir):
    import corpus_pipeline

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    top = max(i for i, _ in rows)
    changed = lambda words, places: " ".join("changed" if k in places else w for k, w in enumerate(words))
    # One word changes 5 of 116 shingles: 0.917 for one place, 0.841 for two, 0.771 for three; 0.80 is 88 of 110.
    rows += [(top + 1, " ".join(BASE)), (top + 2, changed(BASE, {30, 70})), (top + 3, changed(passage(9, 120), {})), (top + 4, changed(passage(9, 120), {20, 50, 80}))]
    exact = passage(10, 103)
    rows += [(top + 5, " ".join(exact)), (top + 6, " ".join([*exact[:92], *passage(11, 11, 10**6)]))]
    sets = {i: shingle_set(t) for i, t in rows}
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= likeness(top + 1, top + 2) < 0.85 and likeness(top + 3, top + 4) < 0.8 and likeness(top + 5, top + 6) == 0.8
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    single = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, [(i, t, "en") for i, t in rows]), sf_dir)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({i for i in sets if root(i) == i})
