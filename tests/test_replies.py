"""Replies whose schema is found: nested formats, bad text, disagreeing types."""

import pytest

from tabscry.operators.replies import as_ddl, read_replies, reply_type


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, answer string")


def test_nested_replies(spark):
    texts = ['{"name": "Ann", "mail": {"at": "x.org", "ok": true}, "tags": ["a", "b"]}', '{"name": null, "n": 12345678901, "mail": {"at": "y.org"}}', None]
    df = frame(spark, [*texts, '{"name": "cut', "", "plain words"])
    kind = reply_type(df, "answer")
    assert kind == "STRUCT<mail: STRUCT<at: STRING, ok: BOOLEAN>, n: BIGINT, name: STRING, tags: ARRAY<STRING>>" or "n: DECIMAL" in kind
    got = {r["id"]: r for r in read_replies(df, "answer").collect()}
    assert len(got) == 6
    assert (got[0]["reply"]["name"], got[0]["reply"]["mail"]["at"], got[0]["reply"]["tags"], got[0]["reply"]["n"]) == ("Ann", "x.org", ["a", "b"], None)
    assert (got[1]["reply"]["name"], got[1]["reply"]["n"], got[1]["reply"]["mail"]["ok"]) == (None, 12345678901, None)
    assert (got[2]["reply"], got[2]["bad_reply"]) == (None, None)
    assert [got[i]["bad_reply"] for i in (0, 1, 3, 5)] == [None, None, '{"name": "cut', "plain words"]


def test_a_field_of_several_types_stays_a_variant(spark):
    df = frame(spark, ['{"a": 1}', '{"a": "one"}', '{"a": [1]}'])
    assert reply_type(df, "answer") == "STRUCT<a: VARIANT>"
    got = read_replies(df, "answer").selectExpr("id", "try_variant_get(reply.a, '$', 'string') AS a").collect()
    assert {r["id"]: r["a"] for r in got}[1] == "one"


@pytest.mark.parametrize("texts", [[], [None, None], ["{", "]"]])
def test_nothing_to_learn_from(spark, texts):
    out = read_replies(frame(spark, texts), "answer").collect()
    assert [(r["reply"], r["bad_reply"]) for r in out] == [(None, t) for t in texts]


def test_a_callers_type_leaves_misfits_null(spark):
    out = read_replies(frame(spark, ['{"k": "x"}', '{"k": "7"}']), "answer", "STRUCT<k: INT>").collect()
    assert [r["reply"] and r["reply"]["k"] for r in out] == [None, 7]


def test_keys_that_are_data_are_refused(spark):
    with pytest.raises(ValueError, match="different keys"):
        reply_type(frame(spark, [f'{{"key{i}": 1}}' for i in range(60)]), "answer", max_fields=20)


def test_names_are_not_types():
    assert as_ddl("OBJECT<`OBJECT<VOID`: VOID, b: ARRAY<OBJECT<c: BIGINT>>>") == "STRUCT<`OBJECT<VOID`: STRING, b: ARRAY<STRUCT<c: BIGINT>>>"
