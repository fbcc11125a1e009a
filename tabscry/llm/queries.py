"""Registered queries of the training-data operators, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscry.llm import decontam, idcoder, jaccard, langid, neardup, packing, phrases, pii, quality, ranked, search, sql, substrings, urlrep
from tabscry.queries.registry import table
from tabscry.session import SETTINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in SETTINGS.items():
                spark.conf.set(key, value)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


@query("op1_near_duplicates", sql.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned without the ids whose crc32 mod 5 is 0."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("id"), 5, 0))
    return quality.classify(docs, model).select("doc_id", quality.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


@query("op3_search", sql.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 documents for all terms of every document whose id is divisible by 20, against all documents."""
    return search.top_k(table(spark, sf_dir, "documents"), "id % 20 = 0", query_terms=None)


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those the model adds."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in coded files and read back."""
    return idcoder.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query("op7_url_reputation", sql.OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by rule, else by its host's reputation over labelled pages."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urlrep.judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


@query("op8_decontaminate", sql.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned without the ids whose crc32 mod 4 is 2."""
    docs = table(spark, sf_dir, "documents")
    out = quality.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs, ~out)
    return langid.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op10_substring_dedup", sql.OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that start in a document with a smaller id."""
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


@query("op11_jaccard_join", sql.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over links with a Jaccard similarity of 0.8 on 5-word shingles."""
    return jaccard.linked(table(spark, sf_dir, "documents"))


@query("op12_collocations", sql.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op13_ranked_search", sql.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
