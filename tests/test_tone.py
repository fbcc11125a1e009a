"""Learned tone: weights by hand, negations, copies, and accuracy on held-out rows."""

import math

import pytest
from pyspark.sql import functions as F

from tabscry.operators import tone as tn
from tabscry.queries.registry import table


def terms(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return {r["id"]: r["_terms"] and sorted(r["_terms"]) for r in tn.with_terms(df, "text").collect()}


def test_terms_after_a_negation(spark):
    got = terms(spark, ["It is not very good, good.", "Good", "", None, "no", "never never say"])
    assert got[0] == sorted(["it", "is", "not", "!very", "!good", "good"])
    assert (got[1], got[2], got[3], got[4], got[5]) == (["good"], [], None, ["no"], sorted(["never", "!never", "!say"]))


def test_weights_and_scores_by_hand(spark):
    train = spark.createDataFrame([("good day", 0), ("good", 0), ("bad day", 1), ("not good", 1), (None, 1), ("bad", None)], "text string, y int")
    weights = {r["term"]: r["weight"] for r in tn.learn_weights(train, "text", "y", min_texts=1, sure=0).collect()}
    odds = lambda a, b: math.floor(1000 * math.log((a + 0.5) * (2.5 - b) / ((2.5 - a) * (b + 0.5))))
    # "day" is as frequent with both labels and has no weight.
    assert weights == {"": 0, "good": odds(0, 2), "bad": odds(1, 0), "not": odds(1, 0), "!good": odds(1, 0)}
    assert tn.learn_weights(train, "text", "y", min_texts=1).count() == 1  # four rows are sure of nothing
    learned = tn.learn_weights(train, "text", "y", min_texts=1, sure=0)
    rows = [(1, "bad"), (2, "bad"), (None, "bad"), (3, "good"), (4, "other words"), (5, None), (6, "")]
    out = tn.tone(spark.createDataFrame(rows, "k int, text string"), "text", learned).collect()
    assert sorted((str(r["k"]), r["log_odds"], r["tone"]) for r in out) == sorted(
        [("1", weights["bad"], 1), ("2", weights["bad"], 1), ("None", weights["bad"], 1), ("3", weights["good"], 0), ("4", 0, 0), ("5", None, None), ("6", 0, 0)]
    )


def test_large_weights_are_joined_by_salt(spark, monkeypatch):
    train = spark.createDataFrame([("good day", 0), ("bad day", 1)], "text string, y int")
    learned = tn.learn_weights(train, "text", "y", min_texts=1, sure=0)
    rows = spark.createDataFrame([(1, "bad day"), (2, "good")], "k int, text string")
    small = sorted(tuple(r) for r in tn.tone(rows, "text", learned).collect())
    monkeypatch.setattr(tn, "is_small", lambda df: False)
    assert sorted(tuple(r) for r in tn.tone(rows, "text", learned).collect()) == small


def test_no_rows(spark):
    none = spark.createDataFrame([], "text string, y int")
    learned = tn.learn_weights(none, "text", "y")
    assert [tuple(r) for r in learned.collect()] == [("", 0)]
    assert tn.tone(none, "text", learned).count() == 0


@pytest.mark.skipif("not __import__('os').path.exists('/root/testdata/sf0.1')", reason="needs the larger tables")
def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    held = F.pmod(F.xxhash64(F.sha2("text", 256)), F.lit(3)) == 0  # equal texts on one side
    learned = tn.learn_weights(rows.filter(~held), "text", "toxic")
    out = tn.tone(rows.filter(held), "text", learned).select("toxic", "tone").collect()
    right = {y: [r["tone"] == y for r in out if r["toxic"] == y] for y in (0, 1)}
    recalls = {y: sum(v) / len(v) for y, v in right.items()}
    print("held-out recalls", recalls, {y: len(v) for y, v in right.items()})
    assert len(right[1]) >= 10 and sum(recalls.values()) / 2 >= 0.8
