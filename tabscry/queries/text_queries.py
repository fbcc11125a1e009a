"""Text, extraction and similarity queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabscry.functions import text as tx
from tabscry.operators import similarity as sim
from tabscry.operators import textops as to
from tabscry.operators import tone as tn
from tabscry.operators.replies import read_replies
from tabscry.operators.text_join import LOWER, UPPER, text_join
from tabscry.operators.vector_index import semantic_join_ivf
from tabscry.queries.quality_queries import shared_folder
from tabscry.queries.registry import query, rnd, table, union
from tabscry.session import spread

c = F.col

# Words that occur in the given texts, by language and by tone.
LANGUAGE_WORDS = {
    "english": ["the", "of", "and", "to", "that", "with"],
    "french": ["le", "et", "les", "des", "une", "pour"],
    "german": ["der", "die", "und", "den", "mit", "auf"],
    "spanish": ["el", "los", "del", "las", "por", "con"],
}
POSITIVE = ["good", "great", "kind", "clear", "helpful"]
NEGATIVE = ["idiot", "moron", "worthless", "clown", "bad"]
TERMS = ["the", "was", "with", "that"]
TASKS = [
    ("scan_nulls", "", False, False),
    ("summarize_text", "", False, True),
    ("row_level_extract", "Extract the main topic of the text.", True, True),
    ("describe_images", "Say in one sentence what the picture shows.", True, False),
]


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def words_sql(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{tx.WORD_PATTERN}')"


def hits_sql(words: str, lexicon) -> str:
    return f"len(list_filter({words}, lambda w: list_contains({sql_list(lexicon)}, w)))"


def sentences_sql(expr: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({expr}, '{tx.SENTENCE_BREAK}'), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query(
    "count_tokens",
    union([f"SELECT '{n}' AS column_name, count({n}) AS row_count, CAST(sum(greatest(1, length({n}) // 4)) AS BIGINT) AS token_count FROM documents" for n in ("text", "source")]),
)
def count_tokens(spark, d):
    return to.count_tokens(table(spark, d, "documents"), ["text", "source"])


def budget_sql() -> str:
    rows = []
    for name, instruction, per_row, reads in TASKS:
        n = max(1, len(instruction) // 4) if instruction else 0
        rows.append(f"SELECT '{name}' AS task, r AS row_count, CAST({n} AS BIGINT) AS instruction_tokens, {n}{' * r' if per_row else ''}{' + t' if reads else ''} AS tokens FROM k")
    return f"""WITH k AS (SELECT count(text) AS r, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS t FROM documents), b AS ({union(rows)})
        SELECT task, row_count, instruction_tokens, CAST(tokens AS BIGINT) AS tokens, CAST((SELECT sum(tokens) FROM b) AS BIGINT) AS total_tokens FROM b"""


@query("token_budget", budget_sql())
def token_budget(spark, d):
    return to.token_budget(table(spark, d, "documents"), "text", TASKS)


def classify_sql() -> str:
    hits = union([f"SELECT doc_id, '{label}' AS label, {hits_sql('words', lex)} AS n FROM w" for label, lex in LANGUAGE_WORDS.items()])
    return f"""w AS (SELECT doc_id, {words_sql('text')} AS words FROM documents), h AS ({hits}),
        t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS pos FROM h),
        classified AS (SELECT doc_id, CASE WHEN max(total) > 0 THEN max(label) FILTER (pos = 1) END AS primary_label,
          {rnd('CASE WHEN max(total) > 0 THEN max(n) FILTER (pos = 1) / max(total) END')} AS primary_confidence,
          string_agg(label, '|' ORDER BY pos) AS labels FROM t GROUP BY doc_id)"""


@query("classify_keywords", f"WITH {classify_sql()} SELECT * FROM classified")
def classify_keywords(spark, d):
    out = to.classify_keywords(table(spark, d, "documents").select("doc_id", "text"), "text", LANGUAGE_WORDS)
    return out.select("doc_id", "primary_label", "primary_confidence", F.array_join("labels", "|").alias("labels"))


@query("classify_model")
def classify_model(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    train = docs.join(table(spark, d, "labels"), "doc_id")
    return to.classify_model(train, docs, "text", "quality").drop("text")


@query(
    "semantic_filter",
    f"""SELECT doc_id, relevance FROM (SELECT doc_id, {rnd(f"len(list_distinct(list_intersect({words_sql('text')}, {sql_list(TERMS)}))) / {len(TERMS)}")} AS relevance FROM documents)
        WHERE relevance >= 0.75""",
)
def semantic_filter(spark, d):
    return to.semantic_filter(table(spark, d, "documents"), "text", TERMS, 0.75).select("doc_id", "relevance")


@query(
    "group_terms",
    f"""WITH w AS (SELECT lang, doc_id, unnest({words_sql('text')}) AS term FROM documents), g AS (SELECT lang, term, count(*) AS tf FROM w GROUP BY ALL),
        x AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY 1), z AS (SELECT lang, count(*) AS group_rows FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
        s AS (SELECT lang, group_rows, term, {rnd('tf * ln((SELECT count(*) FROM documents) / df)', 4)} AS score FROM g JOIN x USING (term) JOIN z USING (lang))
        SELECT lang, group_rows, CAST(term_no AS INTEGER) AS term_no, term, score FROM
          (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS term_no FROM s) WHERE term_no <= 5""",
)
def group_terms(spark, d):
    return to.group_terms(table(spark, d, "documents"), "lang", "text")


def score_sql(words: str) -> str:
    plus, minus = hits_sql(words, POSITIVE), hits_sql(words, NEGATIVE)
    return f"coalesce({rnd(f'({plus} - {minus}) / nullif({plus} + {minus}, 0)')}, 0.0)"


@query(
    "sentiment",
    f"""SELECT doc_id, sentiment_score, CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative' ELSE 'neutral' END AS primary_sentiment
        FROM (SELECT doc_id, {score_sql('words')} AS sentiment_score FROM (SELECT doc_id, {words_sql('text')} AS words FROM documents))""",
)
def sentiment(spark, d):
    return to.sentiment(table(spark, d, "documents"), "text", POSITIVE, NEGATIVE).select("doc_id", "sentiment_score", "primary_sentiment")


@query(
    "learned_tone",
    f"""WITH w AS (SELECT doc_id, {words_sql('text')} AS words FROM documents),
          u AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
          t AS (SELECT DISTINCT doc_id, CASE WHEN bool_or(list_contains({sql_list(tn.NEGATIONS)}, w)) OVER
            (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {tn.NEGATION_REACH} PRECEDING AND 1 PRECEDING) THEN '!' || w ELSE w END AS term FROM u),
          y AS (SELECT d.doc_id, toxic FROM documents d JOIN labels USING (doc_id) WHERE text IS NOT NULL AND toxic IN (0, 1)),
          n AS (SELECT CAST(count(*) FILTER (toxic = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (toxic = 0) AS DOUBLE) AS n0 FROM y),
          k AS (SELECT term, CAST(count(*) FILTER (toxic = 1) AS DOUBLE) AS ones, CAST(count(*) FILTER (toxic = 0) AS DOUBLE) AS zeros FROM t JOIN y USING (doc_id)
            GROUP BY 1 HAVING count(*) >= {tn.MIN_TEXTS}),
          q AS (SELECT term, ln((ones + 0.5) * (n0 - zeros + 0.5) / ((n1 - ones + 0.5) * (zeros + 0.5))) AS r,
            sqrt(1 / (ones + 0.5) + 1 / (n1 - ones + 0.5) + 1 / (zeros + 0.5) + 1 / (n0 - zeros + 0.5)) AS e FROM k, n),
          x AS (SELECT term, CAST(floor(1000 * CASE WHEN r < 0 THEN -(abs(r) - {tn.SURE}::DOUBLE * e) ELSE abs(r) - {tn.SURE}::DOUBLE * e END) AS BIGINT) AS weight
            FROM q WHERE abs(r) - {tn.SURE}::DOUBLE * e > 0),
          p AS (SELECT CAST(floor(1000 * ln((2 * n1 + 1) / (2 * n0 + 1))) AS BIGINT) AS weight FROM n),
          s AS (SELECT doc_id, sum(weight) AS weight FROM t JOIN x USING (term) GROUP BY 1),
          o AS (SELECT doc_id, CAST(CASE WHEN text IS NOT NULL THEN coalesce(s.weight, 0) + p.weight END AS BIGINT) AS log_odds FROM documents LEFT JOIN s USING (doc_id), p)
        SELECT doc_id, log_odds, {rnd('1 / (1 + exp(-log_odds / 1000))')} AS tone_score, CAST(log_odds > 0 AS INTEGER) AS tone FROM o""",
)
def learned_tone(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    weights = tn.learn_weights(docs.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id"), "text", "toxic")
    return tn.tone(docs, "text", tn.stored_weights(weights, f"{shared_folder(spark)}/tone-{uuid.uuid4().hex}")).drop("text")


@query(
    "sentiment_by_group",
    f"""SELECT role, 'text' AS column_name, count(*) AS texts, {rnd('avg(score)', 4)} AS mean_score
        FROM (SELECT role, {score_sql('words')} AS score FROM (SELECT role, {words_sql('text')} AS words FROM conversations)) GROUP BY 1""",
)
def sentiment_by_group(spark, d):
    return to.sentiment_by_group(table(spark, d, "conversations"), "role", ["text"], POSITIVE, NEGATIVE)


def summary_sql(n: int) -> str:
    return f"""s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS no FROM (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents)),
        k AS (SELECT doc_id, no, unnest({words_sql('sentence')}) AS word FROM s),
        f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, word) AS freq FROM k),
        sc AS (SELECT doc_id, no, {rnd('avg(freq)')} AS score FROM f GROUP BY 1, 2),
        p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, no) AS pos FROM sc),
        summaries AS (SELECT doc_id, string_agg(sentence, '. ' ORDER BY no) AS summary FROM p JOIN s USING (doc_id, no) WHERE pos <= {n} GROUP BY 1)"""


@query("summarize_rows", f"WITH {summary_sql(2)} SELECT doc_id, coalesce(summary, '') AS summary FROM documents LEFT JOIN summaries USING (doc_id)")
def summarize_rows(spark, d):
    return to.summarize_rows(table(spark, d, "documents"), "doc_id", "text")


@query(
    "summarize_groups",
    f"""WITH s AS (SELECT lang, sentence, count(*) AS copies FROM (SELECT lang, unnest({sentences_sql('text')}) AS sentence FROM documents) GROUP BY ALL),
        k AS (SELECT lang, sentence, copies, unnest({words_sql('sentence')}) AS word FROM s),
        f AS (SELECT lang, word, sum(copies) AS freq FROM k GROUP BY ALL),
        sc AS (SELECT lang, sentence, any_value(copies) AS copies, {rnd('avg(freq)', 4)} AS score FROM k JOIN f USING (lang, word) GROUP BY 1, 2)
        SELECT lang, CAST(sentence_no AS INTEGER) AS sentence_no, sentence, copies, score FROM
          (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, sentence) AS sentence_no FROM sc) WHERE sentence_no <= 3""",
)
def summarize_groups(spark, d):
    return to.summarize_groups(table(spark, d, "documents"), "lang", "doc_id", "text")


@query(
    "classify_and_summarize",
    f"""WITH {classify_sql()}, {summary_sql(1)}
        SELECT doc_id, primary_label, primary_confidence, coalesce(summary, '') AS summary FROM classified LEFT JOIN summaries USING (doc_id)""",
)
def classify_and_summarize(spark, d):
    return to.classify_and_summarize(table(spark, d, "documents"), "doc_id", "text", LANGUAGE_WORDS)


@query(
    "cosine_pairs",
    f"""SELECT a.vec_id, {rnd('list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))')} AS similarity
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark, d):
    vectors = table(spark, d, "embeddings")
    following = vectors.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return sim.cosine_pairs(vectors.join(following, "vec_id"), "embedding", "other").select("vec_id", "similarity")



@query(
    "text_jaccard",
    f"""WITH w AS (SELECT doc_id, {words_sql('text')} AS words FROM documents),
        s AS (SELECT doc_id, list_distinct(list_transform(list_zip(words[:-2], words[2:]), lambda p: p[1] || ' ' || p[2])) AS sh FROM w),
        j AS (SELECT a.doc_id, len(list_intersect(a.sh, b.sh)) AS shared, len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)) AS every
              FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)
        SELECT doc_id, coalesce({rnd('shared / nullif(every, 0)')}, 0.0) AS similarity FROM j""",
)
def text_jaccard(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    following = docs.select((c("doc_id") - 1).alias("doc_id"), c("text").alias("other"))
    return to.text_jaccard(docs.join(following, "doc_id"), "text", "other").select("doc_id", "similarity")


@query(
    "semantic_join",
    f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        m AS (SELECT a.vec_id AS l, b.vec_id AS r, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE list_cosine_similarity(a.e, b.e) >= 0.35)
        SELECT vec_id AS left_vec_id, r AS right_vec_id, {rnd('s')} AS similarity FROM v LEFT JOIN m ON l = vec_id""",
)
def semantic_join(spark, d):
    vectors = table(spark, d, "embeddings")
    return sim.semantic_join(vectors, vectors, "vec_id", "vec_id", "embedding", 0.35)


def text_join_sql(n: int, condition: str, similarity: str, kind: str) -> str:
    """Documents joined to benchmark items by shared word n-grams."""
    words = lambda t, key: f"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {t}"""
    sets = lambda t, key: f"SELECT DISTINCT {key}, array_to_string(w[p : p + {n - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS p FROM {t} WHERE len(w) > 0)"
    return f"""WITH dw AS ({words('documents', 'doc_id')}), iw AS ({words('benchmark', 'item_id')}),
        d AS ({sets('dw', 'doc_id')}), i AS ({sets('iw', 'item_id')}),
        dn AS (SELECT doc_id, count(*) AS ln FROM d GROUP BY doc_id), n AS (SELECT item_id, count(*) AS rn FROM i GROUP BY item_id),
        s AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN i USING (g) GROUP BY ALL),
        m AS (SELECT doc_id AS l, item_id AS r, {rnd(similarity)} AS similarity FROM s JOIN dn USING (doc_id) JOIN n USING (item_id) WHERE {condition})
        SELECT doc_id AS left_doc_id, item_id AS right_item_id, similarity FROM documents {kind} JOIN m ON l = doc_id {kind} JOIN benchmark ON item_id = r"""


@query("text_join", text_join_sql(2, "100 * k >= 50 * rn", "k / rn", "LEFT"))
def text_join_contained(spark, d):
    """Every document with the benchmark items of which it holds half of the word pairs."""
    return text_join(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", "text", 50, "containment", 2)


@query("text_join_full", text_join_sql(1, "100 * k >= 25 * (ln + rn - k)", "k / (ln + rn - k)", "FULL"))
def text_join_full(spark, d):
    """Documents and benchmark items of which a quarter of all words is shared, and all rows without such a partner."""
    return text_join(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", "text", 25, how="full")


@query("semantic_join_lsh")
def semantic_join_lsh(spark, d):
    vectors = table(spark, d, "embeddings")
    return sim.semantic_join_lsh(vectors, vectors, "vec_id", "vec_id", "embedding", 0.35)


@query(
    "semantic_join_ivf",
    f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        m AS (SELECT a.vec_id AS l, b.vec_id AS r, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE list_cosine_similarity(a.e, b.e) >= 0.9)
        SELECT vec_id AS left_vec_id, r AS right_vec_id, {rnd('s')} AS similarity FROM v LEFT JOIN m ON l = vec_id""",
)
def semantic_join_by_cells(spark, d):
    """Vectors with a cosine similarity of 0.9, compared within the nearest cells only."""
    vectors = table(spark, d, "embeddings")
    return semantic_join_ivf(vectors, vectors, "vec_id", "vec_id", "embedding", 0.9)


@query("embed_text")
def embed_text(spark, d):
    return to.embed_text(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


def redact_sql(expr: str) -> str:
    for kind, pattern in tx.PII_PATTERNS.items():
        expr = f"regexp_replace({expr}, '{pattern}', '{tx.mask(kind)}', 'g')"
    return expr


@query("redact_pii", f"SELECT doc_id, {redact_sql('text')} AS redacted FROM documents")
def redact_pii(spark, d):
    return to.redact_pii(table(spark, d, "documents"), "text").select("doc_id", "redacted")


@query(
    "extract_entities",
    union(
        [
            f"""SELECT doc_id, '{kind}' AS entity, CAST(generate_subscripts(vs, 1) - 1 AS INTEGER) AS match_no, unnest(vs) AS value
                FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS vs FROM documents) WHERE len(vs) > 0"""
            for kind, p in tx.PII_PATTERNS.items()
        ]
    ),
)
def extract_entities(spark, d):
    return to.extract_entities(table(spark, d, "documents"), "doc_id", "text")


MAIL = {"name": (r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1), "domain": (r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", 2)}


@query(
    "extract_structured",
    f"""SELECT 'events' AS table_name, event_id AS row_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS domain FROM events
        UNION ALL SELECT 'documents', doc_id, NULL, nullif(regexp_extract(text, '{MAIL['name'][0]}', 1), ''), nullif(regexp_extract(text, '{MAIL['domain'][0]}', 2), '') FROM documents""",
)
def extract_structured(spark, d):
    events = to.extract_structured(table(spark, d, "events"), "props", "k bigint").select(
        F.lit("events").alias("table_name"), c("event_id").alias("row_id"), c("extracted.k").alias("k"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("domain"),
    )
    docs = to.extract_by_pattern(table(spark, d, "documents"), "text", MAIL).select(
        F.lit("documents").alias("table_name"), c("doc_id").alias("row_id"), F.lit(None).cast("bigint").alias("k"), "extracted.name", "extracted.domain"
    )
    return events.unionByName(docs)


@query(
    "replies_found",
    """SELECT doc_id, doc_id AS id, lang AS origin_lang, source AS origin_source, source AS second_tag, n_chars AS size, length(text) AS text_chars,
              CAST(NULL AS VARCHAR) AS bad_reply FROM documents""",
)
def replies_found(spark, d):
    fields = [c("doc_id").alias("id"), F.struct("lang", "source").alias("origin"), F.array("lang", "source").alias("tags"), c("n_chars").alias("size"), "text"]
    replies = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(*fields)).alias("answer"))
    r = c("reply")
    return read_replies(replies, "answer").select(
        "doc_id", r.id.alias("id"), r.origin.lang.alias("origin_lang"), r.origin.source.alias("origin_source"), F.get(r.tags, 1).alias("second_tag"),
        r["size"].alias("size"), F.length(r.text).cast("long").alias("text_chars"), "bad_reply",
    )


@query(
    "json_fields",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || ',"labels":["' || event_type || '"]}' AS built,
              event_type AS first_label FROM events""",
)
def json_fields(spark, d):
    events = table(spark, d, "events").withColumn("v", F.parse_json("props"))
    built = F.to_json(F.struct("event_id", F.array("event_type").alias("labels")))
    return events.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"), built.alias("built")).withColumn(
        "first_label", F.variant_get(F.parse_json("built"), "$.labels[0]", "string")
    )


def page_text_sql() -> str:
    out = "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for reference, char in tx.CHARACTER_REFERENCES.items():
        quoted = char.replace("'", "''")
        out = f"replace({out}, '{reference}', '{quoted}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"


LINKS_SQL = """regexp_extract_all(html, '(?i)<a\\s+href="([^"]*)"', 1)"""


@query(
    "parse_pages",
    f"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), '') AS title, {page_text_sql()} AS page_text,
          array_to_string({LINKS_SQL}, '|') AS links, CAST(len({LINKS_SQL}) AS INTEGER) AS link_count,
          CAST(len(regexp_extract_all(html, '(?i)<(p|h[1-6]|li|article|div|table|pre|blockquote)[\\s>]')) AS INTEGER) AS block_count FROM pages""",
)
def parse_pages(spark, d):
    out = to.parse_pages(table(spark, d, "pages"), "html")
    return out.select("page_id", "title", "page_text", F.array_join("links", "|").alias("links"), F.size("links").alias("link_count"), "block_count")


def echo_model(prompts: list[str]) -> list[str]:
    """Stand-in for a model: instruction length and text length of each prompt."""
    return [f"{len(p.split(chr(10), 1)[0])}:{len(p.split(chr(10), 1)[1])}" for p in prompts]


@query(
    "map_with_model",
    "SELECT doc_id, '14:' || length(text) AS ai_response FROM documents",
)
def map_with_model(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return to.map_with_model(docs, "text", "Name the topic", echo_model).drop("text")
