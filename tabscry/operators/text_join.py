"""Join of two tables by the similarity of a text column, exact and without comparing all pairs.

A text is the set of its word n-grams. All n-grams have one order: those the right table does not hold first, then by how many
different right texts hold them, rare ones first. Two sets that overlap enough must share one of the first n-grams of either
side (the prefix); the join on prefix n-grams, with a length and a position bound, gives the candidates, and these are
verified on whole sets. N-grams unknown to the right table can match nothing, so they only use up a left text's prefix: most
left texts have none left and never enter the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscry.functions.numeric import rounded
from tabscry.operators.similarity import HOW, _with_unmatched
from tabscry.session import broadcast_if_small, spread

MEASURES = ("jaccard", "containment")
WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

c = F.col


def grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` words (all words, if fewer), A-Z lower-cased, as 64-bit hashes."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))
    if n == 1:
        return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))

    # Bound once as a lambda's variable; named inside the lambda over the starts, the words would be cut again for each of them.
    return F.array_distinct(F.flatten(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), runs)))


def _sets(df: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(key, set number) of every row, and (set number, n-grams, size) of every different set that is not empty."""
    rows = spread(df.select(c(key).alias("key"), c(text).alias("text")))
    # Asked of the text: a filter on the n-grams would cut the text up a second time.
    rows = rows.filter(c("text").rlike(WORDS)).select("key", F.array_sort(grams(c("text"), n)).alias("items"))
    number = F.concat_ws("-", F.hex(F.xxhash64("items")), F.hex(F.xxhash64(F.lit(1), c("items"))))
    rows = rows.withColumn("set", number)
    return rows.select("key", "set"), rows.groupBy("set").agg(F.any_value("items").alias("items")).withColumn("size", F.size("items"))


def least_overlap(measure: str, percent: int, left: Column, right: Column) -> Column:
    """How many n-grams two sets of these sizes must share."""
    if measure == "containment":
        return F.ceil(percent * right / F.lit(100))
    return F.ceil(percent * (left + right) / F.lit(100 + percent))


def text_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_text: str,
    right_text: str,
    percent: int,
    measure: str = "jaccard",
    n: int = 1,
    how: str = "left",
) -> DataFrame:
    """All pairs of rows whose texts are similar enough, as left_<key>, right_<key>, similarity.

    ``jaccard``: shared n-grams are at least ``percent`` of all n-grams of both; ``containment``: of those of the right text.
    ``how`` is one of inner, left, right, full. Equal texts are compared once and matched rows come back by their sets. Missing
    texts and texts without words match nothing. Keys name one row each. N-grams are compared by 64-bit hashes.
    """
    if how not in HOW:
        raise ValueError(f"how is one of {', '.join(HOW)}, not {how}")
    if measure not in MEASURES:
        raise ValueError(f"measure is one of {', '.join(MEASURES)}, not {measure}")
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    lrows, lsets = _sets(left, left_key, left_text, n)
    rrows, rsets = _sets(right, right_key, right_text, n)
    ritems = rsets.select("set", "size", F.explode("items").alias("item"))
    held = ritems.groupBy("item").agg(F.count(F.lit(1)).alias("held"))

    def ranked(items: DataFrame, prefix: Column) -> DataFrame:
        """Prefix n-grams of each set with their 1-based place in the common order."""
        known = items.join(broadcast_if_small(held), "item").groupBy("set", "size").agg(F.array_sort(F.collect_list(F.struct("held", "item"))).alias("known"))
        known = known.withColumn("unknown", c("size") - F.size("known"))
        short = known.withColumn("prefix", F.slice("known", F.lit(1), F.greatest(prefix - c("unknown"), F.lit(0)).cast("int")))
        return short.select("set", "size", "unknown", F.posexplode("prefix").alias("at", "x")).select("set", "size", c("x.item").alias("item"), (c("unknown") + c("at") + 1).alias("place"))

    own = F.ceil(c("size") * percent / F.lit(100))
    litems = lsets.select("set", "size", F.explode("items").alias("item"))
    # A part of the left text may hold the right one, so containment bounds the left prefix by nothing but its size.
    lprefix = ranked(litems, c("size") if measure == "containment" else c("size") - own + 1)
    rprefix = ranked(ritems, c("size") - own + 1)
    a = lprefix.select(c("set").alias("l"), c("size").alias("ln"), "item", c("place").alias("lp"))
    b = rprefix.select(c("set").alias("r"), c("size").alias("rn"), "item", c("place").alias("rp"))
    need = least_overlap(measure, percent, c("ln"), c("rn"))
    still = 1 + F.least(c("ln") - c("lp"), c("rn") - c("rp"))
    fits = F.least("ln", "rn") >= need
    # The first shared n-gram bounds the overlap best; a pair stays if any of its shared ones allows it.
    pairs = a.join(b, "item").filter(fits).groupBy("l", "r", "ln", "rn").agg(F.max(still).alias("most")).filter(c("most") >= need)
    read = pairs.join(rsets.select(c("set").alias("r"), c("items").alias("ri")), "r").join(lsets.select(c("set").alias("l"), c("items").alias("li")), "l")
    shared = read.select("l", "r", "ln", "rn", F.size(F.array_intersect("li", "ri")).alias("both")).filter(c("both") >= need)
    whole = c("rn") if measure == "containment" else c("ln") + c("rn") - c("both")
    found = shared.select("l", "r", rounded(c("both") / whole).alias("similarity"))
    matched = (
        found.join(lrows.select(c("key").alias(f"left_{left_key}"), c("set").alias("l")), "l")
        .join(rrows.select(c("key").alias(f"right_{right_key}"), c("set").alias("r")), "r")
        .select(f"left_{left_key}", f"right_{right_key}", "similarity")
    )
    return _with_unmatched(left, right, left_key, right_key, matched, how)
