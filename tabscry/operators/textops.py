"""Text functions over columns: counts, labels, filters, summaries, extraction.

Each keeps the inputs and outputs of a model-backed function and scores with
word lists and patterns instead; ``map_with_model`` takes a caller's model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscry.functions import text as tx
from tabscry.functions.numeric import ratio, rounded
from tabscry.operators.profiling import summarize
from tabscry.session import cut, spread

TOP_GROUPS = 10
SALTS = 16
# Words, and sentences, of which at most so many are sent to every executor.
FREQUENT_WORDS = 200_000
SENT_ROWS = 100_000

c = F.col


def count_tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value and estimated tokens per text column."""
    metrics = {n: {"row_count": F.count(n), "token_count": F.coalesce(F.sum(tx.token_count(c(n))), F.lit(0))} for n in columns}
    return summarize(df, metrics)


def token_budget(df: DataFrame, column: str, tasks: Sequence[tuple[str, str, bool, bool]]) -> DataFrame:
    """Estimated tokens per task of a column workflow, with the total.

    A task is (name, instruction, per_row, reads_text): per-row tasks pay the
    instruction for every row, tasks that read the text pay the column.
    """
    counted = count_tokens(df, [column])
    entries = []
    for name, instruction, per_row, reads_text in tasks:
        instruction_tokens = F.lit(max(1, len(instruction) // 4) if instruction else 0).cast("long")
        cost = instruction_tokens * c("row_count") if per_row else instruction_tokens
        if reads_text:
            cost = cost + c("token_count")
        entries.append(F.struct(F.lit(name).alias("task"), c("row_count").alias("row_count"), instruction_tokens.alias("instruction_tokens"), cost.alias("tokens")))
    rows = counted.select(F.inline(F.array(*entries)))
    everything = Window.partitionBy()  # one row per task
    return rows.withColumn("total_tokens", F.sum("tokens").over(everything))


def classify_keywords(df: DataFrame, text: str, labels: dict[str, Sequence[str]]) -> DataFrame:
    """Labels by word-list hits: primary label, confidence, all labels and scores.

    Labels are ordered by score, then name; a text without any hit gets no label.
    """
    counted = spread(df).withColumn("_words", tx.words(c(text)))
    found = F.array(*[F.struct((-tx.hits(c("_words"), lex)).alias("minus"), F.lit(name).alias("label")) for name, lex in labels.items()])
    ranked = counted.withColumn("_ranked", F.array_sort(found)).drop("_words")
    total = -F.aggregate("_ranked", F.lit(0).cast("long"), lambda acc, s: acc + s.minus)
    top = c("_ranked")[0]
    return ranked.withColumn("_total", total).select(
        *df.columns,
        F.when(c("_total") > 0, top.label).alias("primary_label"),
        F.when(c("_total") > 0, ratio(-top.minus, c("_total"), 6)).alias("primary_confidence"),
        F.transform("_ranked", lambda s: s.label).alias("labels"),
        F.transform("_ranked", lambda s: F.coalesce(ratio(-s.minus, c("_total"), 6), F.lit(0.0))).alias("scores"),
    )


def classify_model(train: DataFrame, target: DataFrame, text: str, label: str, features: int = 1 << 14) -> DataFrame:
    """Labels learned by logistic regression on hashed word counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    steps = [
        HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01),
    ]
    model = Pipeline(stages=steps).fit(train.select(tx.words(c(text)).alias("_words"), c(label).cast("double")))
    scored = model.transform(target.withColumn("_words", tx.words(c(text))))
    return scored.select(
        *target.columns,
        c("prediction").cast("int").alias("primary_label"),
        F.array_max(vector_to_array("probability")).alias("primary_confidence"),
    )


def relevance(text: Column, terms: Sequence[str]) -> Column:
    """Share of the terms that occur in the text."""
    wanted = F.array(*[F.lit(t) for t in terms])
    return F.size(F.array_intersect(tx.words(text), wanted)) / F.lit(float(len(set(terms))))


def semantic_filter(df: DataFrame, text: str, terms: Sequence[str], at_least: float) -> DataFrame:
    """Rows whose text covers at least the given share of the terms."""
    return spread(df).withColumn("relevance", rounded(relevance(c(text), terms))).filter(c("relevance") >= at_least)


def group_terms(df: DataFrame, group: str, text: str, k: int = 5, top_groups: int = TOP_GROUPS) -> DataFrame:
    """Rows and the k most telling terms of the largest groups.

    The texts are read once: every word adds to the term count, and the first
    of its kind in a text, marked by a leading blank, to the text count. Both
    are combined map-side.
    """
    word_list = tx.words(c(text))
    marked = F.concat(word_list, F.transform(F.array_distinct(word_list), lambda w: F.concat(F.lit(" "), w)))
    counts = (
        spread(df.select(group, text))
        .filter(c(group).isNotNull())
        .select(group, F.explode(marked).alias("mark"))
        .groupBy(group, "mark")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = c("mark").startswith(" ")
    per_group = counts.groupBy(group, F.ltrim("mark").alias("term")).agg(
        F.sum(F.when(first, 0).otherwise(c("n"))).alias("tf"), F.sum(F.when(first, c("n")).otherwise(0)).alias("df")
    )
    sizes = df.filter(c(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("group_rows"))
    corpus = sizes.agg(F.sum("group_rows").alias("corpus_rows"))
    largest = sizes.orderBy(F.desc("group_rows"), F.asc(group)).limit(top_groups)
    in_texts = per_group.groupBy("term").agg(F.sum("df").alias("text_count"))
    scored = (
        per_group.join(F.broadcast(largest), group)
        .join(in_texts, "term")
        .join(F.broadcast(corpus), F.lit(True))
        .withColumn("score", rounded(c("tf") * F.log(c("corpus_rows") / c("text_count")), 4))
    )
    by_score = Window.partitionBy(group).orderBy(F.desc("score"), F.asc("term"))
    return (
        scored.withColumn("term_no", F.row_number().over(by_score))
        .filter(c("term_no") <= k)
        .select(group, "group_rows", "term_no", "term", "score")
    )


def sentiment_score(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """(positive - negative) / (positive + negative) hits, 0 without any."""
    word_list = tx.words(text)
    plus, minus = tx.hits(word_list, positive), tx.hits(word_list, negative)
    return F.coalesce(ratio(plus - minus, plus + minus, 6), F.when(text.isNotNull(), F.lit(0.0)))


def sentiment_label(score: Column, margin: float = 0.1) -> Column:
    return F.when(score > margin, "positive").when(score < -margin, "negative").when(score.isNotNull(), "neutral")


def sentiment(df: DataFrame, text: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    scored = spread(df).withColumn("sentiment_score", sentiment_score(c(text), positive, negative))
    return scored.withColumn("primary_sentiment", sentiment_label(c("sentiment_score")))


def sentiment_by_group(
    df: DataFrame, group: str, columns: Sequence[str], positive: Sequence[str], negative: Sequence[str]
) -> DataFrame:
    """Mean score per group and text column: scored per row, then averaged."""
    return (
        df.unpivot([group], list(columns), "column_name", "text")
        .filter(c("text").isNotNull())
        .withColumn("score", sentiment_score(c("text"), positive, negative))
        .groupBy(group, "column_name")
        .agg(F.count(F.lit(1)).alias("texts"), rounded(F.avg("score"), 4).alias("mean_score"))
    )


def summarize_rows(df: DataFrame, key: str, text: str, n: int = 2) -> DataFrame:
    """The n sentences of each text with the highest mean word frequency, in text order.

    Every row comes back, whatever its key. Equal texts are summarised once, under the digest of their text; a null text
    has an empty summary.
    """
    rows = df.select(key, text, F.sha2(c(text), 256).alias("_text_id"))
    placed = rows.select("_text_id", text).filter(c(text).isNotNull()).dropDuplicates(["_text_id"])
    parts = placed.select("_text_id", F.posexplode(tx.sentences(c(text))).alias("sentence_no", "sentence"))
    tokens = parts.select("_text_id", "sentence_no", F.explode(tx.words(c("sentence"))).alias("word"))
    counted = tokens.withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy("_text_id", "word")))
    scored = counted.groupBy("_text_id", "sentence_no").agg(rounded(F.avg("freq")).alias("score"))
    best = Window.partitionBy("_text_id").orderBy(F.desc("score"), F.asc("sentence_no"))
    picked = scored.withColumn("_rank", F.row_number().over(best)).filter(c("_rank") <= n)
    # At most n numbers per text.
    numbers = picked.groupBy("_text_id").agg(F.array_sort(F.collect_list("sentence_no")).alias("_picked"))
    summary = F.array_join(F.transform("_picked", lambda i: F.get(tx.sentences(c(text)), i)), ". ")
    return rows.join(numbers, "_text_id", "left").select(key, F.coalesce(summary, F.lit("")).alias("summary"))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Column, salts: int = SALTS) -> DataFrame:
    """Inner join whose hot left keys are spread over ``salts`` tasks.

    The right side, one row per key, is repeated once per salt.
    """
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*keys, "_salt"]).drop("_salt")


def summarize_groups(df: DataFrame, group: str, key: str, text: str, n: int = 3, frequent: int = FREQUENT_WORDS, most_sent: int = SENT_ROWS) -> DataFrame:
    """The n sentences of each group with the highest mean word frequency in the group.

    A sentence meets the frequencies of its words under a 128-bit digest, where copies fold, so no word carries a
    sentence through a shuffle. Words with at least 1 / ``frequent`` of all occurrences, of which there are at most
    ``frequent``, are sent out; only the others, each of them rare, are shuffled. Sentences that reach the n-th best
    score of their group are then found again in the texts, counted and ranked.
    """
    sentences = spread(df.select(group, text)).filter(c(group).isNotNull()).select(group, F.explode(tx.sentences(c(text))).alias("sentence"))
    digest = [F.xxhash64("sentence").alias("_h1"), F.xxhash64(F.lit(1), "sentence").alias("_h2")]
    named = sentences.select(group, "sentence", *digest)
    tokens = named.select(group, "_h1", "_h2", F.explode(tx.words(c("sentence"))).alias("word"))
    freq = cut(tokens.groupBy(group, "word").agg(F.count(F.lit(1)).alias("freq")))
    total = freq.agg(F.sum("freq")).first()[0] or 0
    is_frequent = c("freq") * F.lit(frequent) >= F.lit(total)
    sent = F.broadcast(freq.filter(is_frequent))
    keys = [group, "_h1", "_h2"]
    common = tokens.join(sent, [group, "word"]).select(*keys, "freq")
    rare = tokens.join(sent, [group, "word"], "left_anti").join(freq.filter(~is_frequent), [group, "word"]).select(*keys, "freq")
    scored = common.unionByName(rare).groupBy(*keys).agg(rounded(F.avg("freq"), 4).alias("score"))
    # Ties are kept: equal scores are told apart by the sentences themselves.
    reached = scored.withColumn("_rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc("score"))))
    reached = cut(reached.filter(c("_rank") <= n).drop("_rank"))
    found = named.join(F.broadcast(reached) if reached.count() <= most_sent else reached, keys)
    copies = found.groupBy(group, "sentence").agg(F.first("score").alias("score"), F.count(F.lit(1)).alias("copies"))
    best = Window.partitionBy(group).orderBy(F.desc("score"), F.asc("sentence"))
    return (
        copies.withColumn("sentence_no", F.row_number().over(best))
        .filter(c("sentence_no") <= n)
        .select(group, "sentence_no", "sentence", "copies", "score")
    )


def classify_and_summarize(df: DataFrame, key: str, text: str, labels: dict[str, Sequence[str]], n: int = 1) -> DataFrame:
    """Label and summary of every row; rows without a key, or with a repeated one, keep their own."""
    held = df.select(F.struct(key, text).alias("_row"), text)
    both = classify_keywords(summarize_rows(held, "_row", text, n).select("_row", f"_row.{text}", "summary"), text, labels)
    return both.select(f"_row.{key}", "primary_label", "primary_confidence", "summary")


def text_jaccard(df: DataFrame, left: str, right: str, k: int = 2, name: str = "similarity") -> DataFrame:
    """Jaccard similarity of the word shingles of two text columns."""
    listed = spread(df).withColumn("_a", tx.words(c(left))).withColumn("_b", tx.words(c(right)))
    both = listed.withColumn("_a", tx.shingles(c("_a"), k)).withColumn("_b", tx.shingles(c("_b"), k))
    shared = F.size(F.array_intersect("_a", "_b"))
    either = F.size("_a") + F.size("_b") - shared
    return both.withColumn(name, F.coalesce(ratio(shared, either, 6), F.lit(0.0))).drop("_a", "_b")


def embed_text(df: DataFrame, text: str, dims: int = 256, name: str = "embedding") -> DataFrame:
    """Hashed bag of words of unit length as an array of floats."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims).transform(df.withColumn("_words", tx.words(c(text))))
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return unit.select(*df.columns, vector_to_array("_unit", "float32").alias(name))


def redact_pii(df: DataFrame, text: str, kinds: Sequence[str] | None = None, name: str = "redacted") -> DataFrame:
    return spread(df).withColumn(name, tx.redact(c(text), kinds))


def extract_entities(df: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Every match of each named pattern, numbered per text and kind."""
    patterns = patterns or tx.PII_PATTERNS
    found = F.array(
        *[
            F.struct(F.lit(kind).alias("entity"), F.regexp_extract_all(c(text), F.lit(p), F.lit(0)).alias("values"))
            for kind, p in patterns.items()
        ]
    )
    rows = spread(df.select(key, text)).select(key, F.explode(found).alias("e"))
    return rows.select(key, "e.entity", F.posexplode("e.values").alias("match_no", "value"))


def extract_structured(df: DataFrame, column: str, schema: T.StructType | str, name: str = "extracted") -> DataFrame:
    """JSON text to a typed struct; fields that do not parse are null."""
    return df.withColumn(name, F.from_json(column, schema))


def extract_by_pattern(df: DataFrame, column: str, fields: dict[str, tuple[str, int]], name: str = "extracted") -> DataFrame:
    """One struct field per (pattern, group); null where the pattern does not occur."""
    parts = [F.nullif(F.regexp_extract(c(column), p, g), F.lit("")).alias(f) for f, (p, g) in fields.items()]
    return spread(df).withColumn(name, F.struct(*parts))


def parse_pages(df: DataFrame, html: str) -> DataFrame:
    """Title, visible text, link targets and number of text blocks of stored pages."""
    title = F.nullif(F.trim(F.regexp_extract(c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    links = F.regexp_extract_all(c(html), F.lit(r"(?i)<a\s+href=\"([^\"]*)\""), F.lit(1))
    blocks = F.regexp_count(c(html), F.lit(r"(?i)<(p|h[1-6]|li|article|div|table|pre|blockquote)[\s>]"))
    return spread(df).withColumn("title", title).withColumn("page_text", tx.page_text(c(html))).withColumn("links", links).withColumn("block_count", blocks)


def map_with_model(
    df: DataFrame,
    column: str,
    instruction: str,
    model: Callable[[list[str]], Sequence],
    output: str = "ai_response",
    output_type: T.DataType | None = None,
    attempts: int = 3,
) -> DataFrame:
    """Fill a new column from a caller's batch function; null rows stay null.

    The prompt of a row is the instruction, a line break and the value. A
    batch that fails is tried again up to ``attempts`` times; then the task
    fails and Spark retries it.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output, output_type or T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            present = pdf[column].notna()
            prompts = [f"{instruction}\n{value}" for value in pdf.loc[present, column]]
            answers: Sequence = []
            for attempt in range(attempts):
                try:
                    answers = model(prompts) if prompts else []
                    break
                except Exception:
                    if attempt + 1 == attempts:
                        raise
            filled = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            filled.loc[present] = list(answers)
            yield pdf.assign(**{output: filled})

    return df.mapInPandas(run, schema)
