"""Tone of a text from word odds counted on labelled rows.

A word within ``NEGATION_REACH`` words after a negation is a term of its own,
so "not good" and "good" are learned apart. The weight of a term is the log of
its odds between the two labels, in whole thousandths, so that sums do not
depend on their order. The odds are taken at their bound towards zero,
``SURE`` standard errors in, so a term seen by chance weighs little, and one
whose bound passes zero has no weight. Two aggregations learn the weights;
nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscry.functions import text as tx
from tabscry.functions.numeric import rounded
from tabscry.operators.textops import salted_join
from tabscry.session import is_small, spread

NEGATIONS = ("not", "no", "never", "without", "cannot")
NEGATION_REACH = 2
MIN_TEXTS = 5
SURE = 2.0

# The term every text holds once; its weight is the log odds of the labels.
EVERY_TEXT = ""

c = F.col


def with_terms(df: DataFrame, text: str, name: str = "_terms") -> DataFrame:
    """The distinct terms of each text, negated words marked by a leading '!'; null without a text."""
    listed = df.withColumn("_w", tx.words(c(text)))
    n = F.size("_w")
    marked = F.transform("_w", lambda w: w.isin(*NEGATIONS))
    near = F.transform("_w", lambda w: F.lit(False))
    for back in range(1, NEGATION_REACH + 1):
        shift = F.least(F.lit(back), n)
        moved = F.concat(F.array_repeat(F.lit(False), shift), F.slice("_marked", F.lit(1), n - shift))
        near = F.zip_with(near, moved, lambda a, b: a | b)
    terms = F.zip_with("_w", near, lambda w, negated: F.when(negated, F.concat(F.lit("!"), w)).otherwise(w))
    return listed.withColumn("_marked", marked).withColumn(name, F.array_distinct(terms)).drop("_w", "_marked")


def learn_weights(train: DataFrame, text: str, label: str, min_texts: int = MIN_TEXTS, sure: float = SURE) -> DataFrame:
    """Weight of every telling term in at least ``min_texts`` labelled texts: term, weight, in thousandths of log odds for label 1.

    Rows without a text or a label of 0 or 1 teach nothing. Without any row
    the weights are empty but for the term of every text.
    """
    rows = with_terms(spread(train.select(text, label)).filter(c(text).isNotNull() & c(label).isin(0, 1)), text)
    terms = F.concat(F.array(F.lit(EVERY_TEXT)), c("_terms"))
    counts = (
        rows.select(c(label).alias("y"), F.explode(terms).alias("term"))
        .groupBy("term")
        .agg(F.count_if(c("y") == 1).cast("double").alias("ones"), F.count_if(c("y") == 0).cast("double").alias("zeros"))
    )
    total = rows.agg(F.count_if(c(label) == 1).cast("double").alias("n1"), F.count_if(c(label) == 0).cast("double").alias("n0"))
    prior = total.select(F.lit(EVERY_TEXT).alias("term"), F.floor(1000 * F.log((2 * c("n1") + 1) / (2 * c("n0") + 1))).alias("weight"))
    # Texts with and without the term, by label.
    cells = [c("ones") + 0.5, c("n1") - c("ones") + 0.5, c("zeros") + 0.5, c("n0") - c("zeros") + 0.5]
    log_ratio = F.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    spread_of = F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3])
    learned = (
        counts.filter((c("term") != EVERY_TEXT) & (c("ones") + c("zeros") >= min_texts))
        .join(F.broadcast(total), F.lit(True))
        .select("term", log_ratio.alias("r"), (F.abs(log_ratio) - sure * spread_of).alias("bound"))
        .filter(c("bound") > 0)
        .select("term", F.floor(1000 * F.when(c("r") < 0, -c("bound")).otherwise(c("bound"))).alias("weight"))
    )
    return learned.unionByName(prior)


def stored_weights(weights: DataFrame, path: str) -> DataFrame:
    """Write the weights once and read them back, with a size that is known when they are joined."""
    weights.write.mode("overwrite").parquet(path)
    return weights.sparkSession.read.schema(weights.schema).parquet(path)


def tone(df: DataFrame, text: str, weights: DataFrame) -> DataFrame:
    """Every row with ``log_odds`` (thousandths), ``tone_score`` (0 to 1 for label 1) and ``tone`` (1 or 0).

    Equal texts are added up together and divided by their number, so a text
    with very many copies is combined before the shuffle and weighs nothing
    more. A null text has a null result; one without known terms gets the odds
    of the labels.
    """
    rows = df.withColumn("_text_id", F.sha2(c(text), 256))
    found = with_terms(spread(rows.select("_text_id", text)).filter(c(text).isNotNull()), text)
    terms = found.select("_text_id", F.explode(F.concat(F.array(F.lit(EVERY_TEXT)), c("_terms"))).alias("term"))
    if is_small(weights):
        joined = terms.join(F.broadcast(weights), "term")
    else:
        joined = salted_join(terms, weights, ["term"], c("_text_id"))
    sums = joined.groupBy("_text_id").agg(F.sum("weight").alias("_sum"), F.count_if(c("term") == EVERY_TEXT).alias("_copies"))
    odds = sums.select("_text_id", F.expr("_sum div _copies").alias("log_odds"))
    scored = rows.join(odds, "_text_id", "left").drop("_text_id")
    share = rounded(1 / (1 + F.exp(-c("log_odds") / 1000)))
    return scored.withColumn("tone_score", share).withColumn("tone", (c("log_odds") > 0).cast("int"))
