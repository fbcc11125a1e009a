"""Edge frames: empty, all null, constant, ties, null keys, blanks, one point."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabscry.functions.numeric import greatest_or_null
from tabscry.functions.temporal import parse_temporal, stamp
from tabscry.operators import profiling as p
from tabscry.operators import repair as r
from tabscry.operators import sampling
from tabscry.operators import scans as s
from tabscry.operators import series as ser
from tabscry.operators import textops as to
from tabscry.operators import typing_rules as t


def rows(df):
    return [tuple(x) for x in df.collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1.0, 5.0, 2.0, None), (2.0, 5.0, 4.0, None), (3.0, 5.0, 6.0, None)], "x double, flat double, y double, gone double")


def test_correlation_of_constant_and_missing_columns_is_null(numbers):
    got = {c: (v, g) for c, v, _, g in rows(p.correlations(numbers, "x"))}
    assert got == {"y": (1.0, "positive"), "flat": (None, "unknown"), "gone": (None, "unknown")}


def test_empty_table(spark, numbers):
    empty = numbers.limit(0)
    assert rows(s.scan_nulls(empty)) == [(c, 0, 0, None) for c in ("x", "flat", "y", "gone")]
    assert rows(p.table_profile(empty)) == [(0, 0, 4)]
    assert {x[-1] for x in rows(p.distribution_shape(p.distribution(empty)))} == {None}
    assert rows(ser.histogram(empty, "x")) == []
    assert rows(p.category_groups(empty, "x")) == []
    assert rows(s.conflict_row_count(empty, "x", ["y"])) == [(0,)]
    assert rows(r.fill(empty, "x", "mode")) == []
    assert {x["fine_type"] for x in t.column_types(t.name_hints(t.evidence(empty))).collect()} <= {"identifier", "continuous_numeric"}


def test_distribution_counts_nulls_of_all_null_column(numbers):
    got = {x["column_name"]: x for x in p.distribution(numbers).collect()}
    assert (got["gone"]["total_count"], got["gone"]["null_count"], got["gone"]["p50"]) == (3, 3, None)
    assert got["x"]["p50"] == 2.0


def test_unique_rows_count_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert rows(p.table_profile(df)) == [(3, 2, 2)]


def test_histogram_edges(spark, numbers):
    assert rows(ser.histogram(numbers, "flat")) == []
    got = sorted(rows(ser.histogram(numbers, "x", bins=2)))
    assert got == [(1, 1), (3, 1), (6, 1)]  # fewer than five bins are not used
    assert sum(n for _, n in got) == 3


def test_fractions_are_kept_and_text_is_not_a_number(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string")
    assert rows(p.numeric_stats(df, ["v"])) == [("v", 1.5, 1.5, 1.5, 1.5, None)]
    assert rows(p.non_numeric_counts(df, ["v"])) == [("v", 3, 1)]


def test_cleaned_numbers(spark):
    df = spark.createDataFrame([("1,200",), ("$5",), ("12%",), ("(3.5)",), ("a1",), ("",)], "v string")
    got = [x[0] for x in rows(df.select(p.cleaned_number(F.col("v"))))]
    assert got == [1200.0, 5.0, 12.0, -3.5, None, None]


def test_ties_are_broken_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    assert sorted(rows(r.fill(df, "v", "mode"))) == [("a",), ("a",), ("b",)]
    assert [x[0] for x in rows(p.category_groups(df, "v", 1))] == ["a"]


def test_blank_categories_never_count(spark):
    df = spark.createDataFrame([(" ",), ("",), ("a",), ("b",), ("b",), (None,)], "v string")
    assert sorted(rows(ser.top_with_other(df, "v", 1))) == [("Other", 1), ("b", 2)]
    assert sorted(rows(ser.top_with_other(df, "v", 2))) == [("a", 1), ("b", 2)]
    assert sorted(rows(ser.top_with_other(df, "v"))) == [("a", 1), ("b", 2)]


def test_null_group_keys_are_no_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("g", 1), ("g", None), ("g", 3)], "k string, v int")
    assert rows(s.scan_conflicts(df, "v", ["k"])) == [("v", 1, 1, 1.0, 2)]
    assert rows(s.conflict_row_count(df, "v", ["k"])) == [(3,)]
    assert s.conflict_rows(df, "v", ["k"]).count() == 3
    with pytest.raises(ValueError, match="group_columns_unknown"):
        s.scan_conflicts(df, "v", ["nope"])
    with pytest.raises(ValueError, match="group_columns_missing"):
        s.scan_conflicts(df, "v", [])


def test_conflict_repair_leaves_nulls_and_sound_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", 7), ("b", None)], "k string, v int")
    out = sorted(rows(r.repair_conflicts(df, "v", ["k"], "mode")), key=str)
    assert out == sorted([("a", 1), ("a", 1), ("a", 1), ("a", None), ("b", 7), ("b", None)], key=str)
    every = rows(r.repair_conflicts(df, "v", ["k"], "mode", only_conflicting=False, fill_nulls=True))
    assert sorted(every) == [("a", 1)] * 4 + [("b", 7)] * 2


def test_group_median_with_segments_and_null_keys(spark):
    df = spark.createDataFrame(
        [(1, "a", "x||y", 1.0), (2, "a", "x||y", 3.0), (3, "a", "x||y", None), (4, "a", "x", None), (5, None, "x", None)],
        "id int, k string, seg string, v double",
    )
    got = {x["id"]: x["v"] for x in r.fill_group_median(df, "v", ["k"], ["seg"]).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 2.0, 4: None, 5: None}


def test_greatest_is_null_with_a_null(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    assert [x[0] for x in rows(df.select(greatest_or_null([F.col("a"), F.col("b")])))] == [2, None]


def test_temporal_spellings(spark):
    texts = ["2024-01-02 03:04:05", "20240102", "1704164645", "1704164645000", "hello", "", None, "123"]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    got = [x[0] for x in rows(df.select(stamp(parse_temporal(F.col("s")))))]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-02 03:04:05", None, None, None, None]


def test_one_time_point_falls_back_and_is_dropped(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0)] * 3, "ts timestamp, v double")
    assert rows(ser.time_series_adaptive(df, "ts", "v")) == []
    hours = spark.createDataFrame([(datetime(2024, 1, 1, h), 1.0) for h in range(4)], "ts timestamp, v double")
    assert {x["grain"] for x in ser.time_series_adaptive(hours, "ts", "v").collect()} == {"hour"}


def test_periodicity_gaps(spark):
    days = [datetime(2024, 1, d) for d in (1, 2, 4, 5, 7, 8)]
    df = spark.createDataFrame([(d, float(i % 2)) for i, d in enumerate(days)], "ts timestamp, v double")
    plain = {x["lag"]: x["correlation"] for x in p.periodicity(df, "ts", "v").collect()}
    filled = {x["lag"]: x["correlation"] for x in p.periodicity(df, "ts", "v", fill_gaps=True).collect()}
    assert plain[1] == pytest.approx(-1.0) and plain[30] is None
    assert filled[1] is None  # with gaps every present pair is (0, 1): no spread
    assert rows(p.dominant_period(p.periodicity(df, "ts", "v"))) == [(1, -1.0, True)]


def test_equal_spacing(spark):
    df = spark.createDataFrame([(float(i), float(i * 3 + 1), float(i * i), 4.0) for i in range(6)], "a double, b double, c double, d double")
    got = {x["column_name"]: x["equally_spaced"] for x in p.numeric_flags(df).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True}


def test_type_rules_in_order(spark):
    df = spark.createDataFrame(
        [(i, i % 2, f"{i % 3}", f"user{i}@x", "2024-01-02", i / 100, "p.png") for i in range(100)],
        "order_id int, flag int, grade string, updated_by string, when_seen string, pct double, shot string",
    )
    got = {x["column_name"]: (x["fine_type"], x["semantic_type"], x["role"]) for x in t.understand(df).collect()}
    assert got["order_id"] == ("identifier", "id", "id")
    assert got["flag"][0] == "binary"
    assert got["updated_by"][0] != "datetime"  # a temporal name without a single date
    assert got["when_seen"] == ("datetime", "temporal", "time")
    assert got["shot"][1] == "image"


def test_sampling_strategies(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    assert sampling.smart_sample(df, ["k"], has_time=False, target=100).count() == 50
    assert sampling.smart_sample(df, ["k"], has_time=True, target=9).count() == 9
    picked = sampling.smart_sample(df, ["k"], has_time=False, target=10)
    assert picked.count() == 10
    assert sorted(rows(picked)) == sorted(rows(sampling.random_rows(df.repartition(7), ["k"], 10)))
    assert [x["k"] for x in sampling.systematic(df, ["k"], 10, 3).orderBy("k").collect()] == [9, 19, 29]


def test_text_edges(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "One. Two two! ")], "id int, text string")
    assert rows(to.count_tokens(df, ["text"])) == [("text", 2, 4)]
    got = {x["id"]: x["summary"] for x in to.summarize_rows(df, "id", "text", 1).collect()}
    assert got == {1: "", 2: "", 3: "Two two"}
    labelled = {x["id"]: x["primary_label"] for x in to.classify_keywords(df, "text", {"a": ["one"], "b": ["two"]}).collect()}
    assert labelled == {1: None, 2: None, 3: "b"}
    same = to.text_jaccard(df.withColumn("b", F.col("text")), "text", "b")
    assert {x["id"]: x["similarity"] for x in same.collect()} == {1: 0.0, 2: 0.0, 3: 1.0}


def test_map_with_model_skips_nulls_and_retries(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string").coalesce(1)

    def make():
        state = {"n": 0}

        def model(prompts):
            state["n"] += 1
            if state["n"] == 1:
                raise RuntimeError("busy")
            return [x.upper() for x in prompts]

        return model

    got = rows(to.map_with_model(df, "text", "say", make()))
    assert sorted(got) == [(1, "a", "SAY\nA"), (2, None, None)]


def test_salted_join_equals_plain_join(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id"))
    right = spark.createDataFrame([("hot", 5), ("cold", 6)], "k string, v int")
    out = to.salted_join(left, right, ["k"], F.col("id"), 4)
    assert out.count() == 1000 and {x["v"] for x in out.collect()} == {5}


def test_drift_keeps_columns_of_one_side(spark):
    a = p.drift_profile(spark.createDataFrame([(1, 2)], "x int, y int"), ["x", "y"])
    b = p.drift_profile(spark.createDataFrame([(1,), (4,)], "x int"), ["x"])
    got = {x["column_name"]: (x["total_rows_delta"], x["max_value_delta"]) for x in p.profile_drift(a, b).collect()}
    assert got == {"x": (1, 3.0), "y": (None, None)}


def test_evidence_of_nested_null_and_empty_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", [1, None], None), (2, "a", [1], None), (3, None, [None, 1], None)], "n long, s string, a array<int>, z string"
    )
    got = {r["column_name"]: r for r in t.evidence(df).collect()}
    assert [got[x]["distinct_count"] for x in "nsaz"] == [3, 1, 3, 0]
    assert [got[x]["null_count"] for x in "nsaz"] == [0, 1, 0, 3]
    assert got["n"]["all_integers"] and not got["n"]["in_0_1"] and got["z"]["avg_length"] == 0.0
    assert {r["total_count"] for r in t.evidence(df.limit(0)).collect()} == {0}
    near = {r["column_name"]: r["distinct_count"] for r in t.evidence(df, approx=True).collect()}
    assert near == {"n": 3, "s": 1, "a": 3, "z": 0}


def test_conflicts_of_many_columns_equal_those_of_each(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, None, 2.0), (None, "x", 3.0)], "k int, s string, v double")
    both = {r["column_name"]: r for r in s.scan_conflicts(df, ["s", "v"], ["k"]).collect()}
    assert both == {n: s.scan_conflicts(df, n, ["k"]).first() for n in ("s", "v")}
    assert (both["s"]["total_groups"], both["s"]["conflict_groups"]) == (1, 1)


def test_conflicts_of_nested_values(spark):
    df = spark.createDataFrame([(1, [1, None]), (1, [1]), (2, [None, 1]), (2, [None, 1])], "k int, a array<int>")
    assert s.scan_conflicts(df, "a", ["k"]).first()["conflict_groups"] == 1


def test_a_model_gets_no_missing_text(spark):
    from tabscry.operators import textops as to

    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, text string")
    got = {x["id"]: x["ai_response"] for x in to.map_with_model(df, "text", "Say", lambda prompts: [p.upper() for p in prompts]).collect()}
    assert got[2] is None and got[1].startswith("SAY") and got[1].endswith("A B") and got[3] is not None


@pytest.mark.parametrize("frequent, most_sent", [(1, 0), (3, 1000), (200_000, 1000)])
def test_group_summaries_carry_no_sentence_per_word(spark, monkeypatch, frequent, most_sent):
    texts = [("a", "the cat sat. The dog. the cat sat"), ("a", "a dog sat! ... 12"), ("b", "one two. two. two one one"), (None, "the the"), ("a", None)]
    df = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(texts * 3)], "id long, g string, text string")
    joined, join = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, *args, **named: joined.append(set(self.columns)) or join(self, *args, **named))
    how = {} if frequent == 200_000 else {"frequent": frequent, "most_sent": most_sent}
    got = sorted((r["g"], r["sentence_no"], r["sentence"], r["copies"], r["score"]) for r in to.summarize_groups(df, "g", "id", "text", 2, **how).collect())
    # Words of a: the 9, cat 6, sat 9, dog 6, a 3; of b: one 9, two 9.
    assert got == [("a", 1, "the cat sat", 6, 8.0), ("a", 2, "The dog", 3, 7.5), ("b", 1, "one two", 3, 9.0), ("b", 2, "two", 3, 9.0)]
    assert joined and not any({"word", "sentence"} <= columns for columns in joined)


def test_distinct_counts_of_narrow_cells(spark, monkeypatch):
    monkeypatch.setattr(p, "PIECE_BYTES", 64)
    rows = [(1, 0.0, "a", [1, None], None), (2, -0.0, "b", [1], None), (None, float("nan"), "b", None, None), (2, float("nan"), None, [1, None], None)] * 5
    df = spark.createDataFrame(rows, "k int, d double, s string, a array<int>, z string")
    got = {r["column_name"]: r["distinct_count"] for r in p.wide_profile(df).collect()}
    assert got == {"k": 2, "d": 2, "s": 2, "a": 2, "z": 0}
    unique = {r["column_name"]: r["unique_pct"] for r in p.display_stats(df, ["k", "s", "z"]).collect()}
    assert unique == {"k": 10.0, "s": 10.0, "z": 0.0}
    assert {r["distinct_count"] for r in p.wide_profile(df.limit(0)).collect()} == {0}


@pytest.mark.parametrize("of", [p.wide_profile, p.display_stats])
def test_no_row_is_expanded_for_its_distinct_values(spark, of):
    df = spark.createDataFrame([(1, "a", 1.0)], "k int, s string, v double")
    assert "Expand" not in of(df)._jdf.queryExecution().executedPlan().toString()
