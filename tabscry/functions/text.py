"""Word, pattern and lexicon expressions over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"\p{L}+"
SENTENCE_BREAK = r"[.!?]+\s+|\n+|[.!?]+$"

# Personal data patterns, replaced in this order, and their marks.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "card": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "phone": r"\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}",
}

# Character references decoded in page text.
CHARACTER_REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def words(text: Column) -> Column:
    """Lower-cased runs of letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def sentences(text: Column) -> Column:
    """Non-blank sentences, trimmed, in order."""
    parts = F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def token_count(text: Column) -> Column:
    """A quarter of the characters, at least one; NULL for a missing text."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def hits(word_list: Column, lexicon: Sequence[str]) -> Column:
    """How many of the words are in the lexicon."""
    return F.size(F.filter(word_list, lambda w: w.isin(*lexicon))).cast("long")


def shingles(word_list: Column, k: int = 2) -> Column:
    """Distinct runs of k words; empty when the text has fewer.

    Shifted copies of the word array are zipped, so the cost is linear.
    """
    n = F.greatest(F.size(word_list) - (k - 1), F.lit(0))
    runs = F.slice(word_list, F.lit(1), n)
    for shift in range(1, k):
        runs = F.zip_with(runs, F.slice(word_list, F.lit(1 + shift), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(runs)


def mask(kind: str) -> str:
    return f"[{kind.upper()}]"


def redact(text: Column, kinds: Sequence[str] | None = None) -> Column:
    """Replace personal data by its mark; all kinds unless some are named."""
    for kind, pattern in PII_PATTERNS.items():
        if kinds is None or kind in kinds:
            text = F.regexp_replace(text, pattern, mask(kind))
    return text


def page_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags; blanks folded."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for reference, char in CHARACTER_REFERENCES.items():
        out = F.replace(out, F.lit(reference), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))
