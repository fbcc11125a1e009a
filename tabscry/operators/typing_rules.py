"""Column types, roles and table structure: rules over one row of evidence per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscry.functions import names
from tabscry.functions.numeric import numbers, ratio, rounded
from tabscry.operators.profiling import (
    DATETIME_PATTERN,
    GEO_PATTERN,
    ID_PATTERN,
    cleaned_number,
    type_family,
)
from tabscry.session import spread

# Category names and the eight semantic types they fold to.
SEMANTIC_OF = {
    "datetime": "temporal",
    "identifier": "id",
    "geospatial": "spatial",
    "binary": "binary",
    "ratio_percentage": "numeric",
    "discrete_numeric": "numeric",
    "continuous_numeric": "numeric",
    "ordinal_categorical": "categorical",
    "nominal_categorical": "categorical",
    "text_long": "text",
    "text_short": "text",
}
# The role a semantic type plays in a table.
ROLE_OF = {
    "numeric": "metric",
    "temporal": "time",
    "categorical": "dimension",
    "text": "dimension",
    "spatial": "dimension",
    "binary": "dimension",
    "image": "dimension",
    "id": "id",
}
# Handling advice by category.
ADVICE = {
    "identifier": ["Do not use for mathematical operations", "Consider as index or join key"],
    "nominal_categorical": [
        "Consider one-hot encoding or label encoding",
        "Check for rare categories (< 1% frequency)",
    ],
    "ordinal_categorical": [
        "Consider one-hot encoding or label encoding",
        "Check for rare categories (< 1% frequency)",
    ],
    "datetime": [
        "Extract temporal features (year, month, day, etc.)",
        "Consider time-based sorting and windowing",
    ],
    "continuous_numeric": [
        "Check for outliers using IQR or Z-score",
        "Consider normalization or standardization",
    ],
    "text_long": ["Consider NLP techniques (TF-IDF, embeddings)", "May require text preprocessing"],
}
# Sampling by table structure.
STRUCTURE_SAMPLING = {"time_series": "time_window", "panel": "entity_time_stratified", "iid": "random"}
STRUCTURE_SAMPLE_ROWS = {"time_series": 50, "panel": 120, "iid": 50}

c = F.col


RATIOS = ("datetime_ratio", "id_ratio", "geo_ratio", "numeric_ratio", "image_ratio", "avg_length")


def _marks(value: Column, family: str) -> dict[str, Column]:
    """What one value shows, as conditions on it; numbers come as doubles."""
    if family == "text":
        return {
            "datetime": value.rlike(DATETIME_PATTERN),
            "id": value.rlike(ID_PATTERN),
            "geo": value.rlike(GEO_PATTERN),
            "numeric": cleaned_number(value).isNotNull(),
            "image": value.rlike(names.IMAGE_FILE_PATTERN),
        }
    if family == "numeric":
        return {"numeric": value.isNotNull(), "fraction": value != F.floor(value), "outside": ~value.between(0, 1)}
    return {"datetime": value.isNotNull()} if family == "time" else {}  # a time writes itself as a date


MARKS = ("datetime", "id", "geo", "numeric", "image", "fraction", "outside")


def _cells(df: DataFrame, fields: list[tuple[int, str, str, T.DataType]]) -> DataFrame:
    """Every value as its column's ordinal, a 128-bit digest, the bits of its marks and its length.

    The marks are columns of their own before the rows are taken apart: small expressions keep to generated code.
    """
    numeric = [n for _, n, family, _ in fields if family == "numeric"]
    values = numbers(df.select(*[c(n).alias(f"raw_{i}") for i, n, *_ in fields], *numeric), numeric, keep=[f"raw_{i}" for i, *_ in fields])
    marked, cells = [], []
    for i, name, family, data_type in fields:
        raw = c(f"raw_{i}")
        nested = isinstance(data_type, (T.ArrayType, T.StructType, T.MapType))
        value = F.to_json(raw, {"ignoreNullFields": "false"}) if nested else raw
        bits = F.lit(0)
        for mark, found in _marks(c(name) if family == "numeric" else raw, family).items():
            bits = bits.bitwiseOR(F.when(found, 1 << MARKS.index(mark)).otherwise(0))
        marked += [
            raw.isNotNull().alias(f"known_{i}"),
            F.xxhash64(value).alias(f"h1_{i}"),
            F.xxhash64(F.lit(1), value).alias(f"h2_{i}"),
            bits.alias(f"bits_{i}"),
            (F.coalesce(F.length(raw), F.lit(0)) if family == "text" else F.lit(0)).alias(f"length_{i}"),
        ]
        parts = ("known", "h1", "h2", "bits", "length")
        cells.append(F.struct(F.lit(i).alias("ordinal"), *[c(f"{part}_{i}").alias(part) for part in parts]))
    return values.select(*marked).select(F.inline(F.array(*cells)))


def evidence(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row of full-table evidence per column: counts, patterns, ranges, lengths.

    One scan. What crosses the network is a digest per distinct value, never the
    value; with ``approx`` it is a sketch per column.
    """
    fields = [(i, f.name, type_family(f.dataType), f.dataType) for i, f in enumerate(df.schema.fields)]
    listed = df.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("ordinal"), F.lit(f).alias("family")) for i, n, f, _ in fields]))
    )
    cells = _cells(spread(df), fields)
    if approx:
        values, n = cells, F.lit(1)
        distinct = F.approx_count_distinct(F.when(c("known"), c("h1")))
    else:
        values = cells.groupBy("ordinal", "known", "h1", "h2").agg(
            F.count(F.lit(1)).alias("n"), F.max("bits").alias("bits"), F.max("length").alias("length")
        )
        n, distinct = c("n"), F.count_if("known")
    present = c("known")
    total, known = F.sum(n), F.sum(F.when(present, n))

    def having(mark: str) -> Column:
        return F.sum(F.when(present & (c("bits").bitwiseAND(1 << MARKS.index(mark)) != 0), n).otherwise(0))

    def flag(against: str) -> Column:
        return F.when(having("numeric") > 0, having(against) == 0)

    # Shares are taken inside the aggregate: rules above it read plain columns.
    rows = values.groupBy("ordinal").agg(
        total.alias("total_count"),
        (total - F.coalesce(known, F.lit(0))).alias("null_count"),
        *[ratio(having(r.removesuffix("_ratio")), known).alias(r) for r in RATIOS if r != "avg_length"],
        ratio(F.sum(F.when(present, c("length").cast("long") * n)), known).alias("avg_length"),
        flag("fraction").alias("all_integers"),
        flag("outside").alias("in_0_1"),
        distinct.alias("distinct_count"),
        ratio(total - F.coalesce(known, F.lit(0)), total).alias("null_rate"),
        ratio(distinct, total).alias("cardinality"),
    )
    rows = listed.join(F.broadcast(rows), "ordinal", "left").fillna(0, ["total_count", "null_count", "distinct_count"])
    return rows.fillna(0.0, [*RATIOS, "null_rate", "cardinality"])


def name_hints(rows: DataFrame) -> DataFrame:
    """Add one flag per kind of hint."""
    return rows.select("*", *[names.has_hint(c("column_name"), h).alias(f"hint_{h}") for h in names.HINT_PATTERNS])


def column_types(rows: DataFrame) -> DataFrame:
    """Fine type of each column, first matching rule wins.

    A temporal name is believed unless the values are text without any date.
    """
    temporal_name = c("hint_temporal") & ~((c("family") == "text") & (c("datetime_ratio") == 0))
    unique = (c("cardinality") > 0.95) & (c("distinct_count") == c("total_count"))
    numeric = (
        (c("family") == "numeric")
        | (c("numeric_ratio") >= 0.6)
        | ((c("numeric_ratio") >= 0.4) & (c("hint_count") | c("hint_ratio")))
    )
    whole = F.coalesce(c("all_integers"), F.lit(False))
    number_kind = (
        F.when(c("hint_ratio") | F.coalesce(c("in_0_1"), F.lit(False)), "ratio_percentage")
        .when(whole & c("hint_count"), "discrete_numeric")
        .when(whole & (c("cardinality") < 0.1), "discrete_numeric")
        .otherwise("continuous_numeric")
    )
    few = (c("cardinality") < 0.05) | (c("distinct_count") < 20)
    fine = (
        F.when(temporal_name | (c("datetime_ratio") > 0.8), "datetime")
        .when(c("hint_id") | (c("id_ratio") > 0.8) | unique, "identifier")
        .when(c("hint_geo") | (c("geo_ratio") > 0.8), "geospatial")
        .when(c("distinct_count") == 2, "binary")
        .when(numeric, number_kind)
        .when(few, F.when(c("hint_categorical"), "ordinal_categorical").otherwise("nominal_categorical"))
        .when(c("family") == "text", F.when(c("avg_length") > 100, "text_long").otherwise("text_short"))
        .otherwise("unknown")
    )
    return rows.withColumn("fine_type", fine)


def type_confidence(rows: DataFrame) -> DataFrame:
    """0.5 plus the boosts of the evidence, less 0.2 when mostly null, within 0..1."""
    fine = c("fine_type")

    def boost(cond: Column, amount: float) -> Column:
        return F.when(cond, amount).otherwise(0.0)

    categorical = fine.isin("nominal_categorical", "ordinal_categorical")
    gained = (
        F.when(fine == "datetime", boost(c("datetime_ratio") > 0.9, 0.4) + boost(c("hint_temporal"), 0.1))
        .when(fine == "identifier", boost(c("cardinality") > 0.99, 0.3) + boost(c("hint_id"), 0.2))
        .when(categorical, boost(c("cardinality") < 0.01, 0.3) + boost(c("hint_categorical"), 0.2))
        .when(fine == "binary", boost(c("distinct_count") == 2, 0.4))
        .otherwise(0.0)
    )
    score = F.lit(0.5) + gained - boost(c("null_rate") > 0.5, 0.2)
    return rows.withColumn("confidence", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def type_recommendations(rows: DataFrame) -> DataFrame:
    """Advice per column: what its type calls for, and imputation above 10 % nulls."""
    advice = F.array().cast("array<string>")
    for fine, texts in ADVICE.items():
        advice = F.when(c("fine_type") == fine, F.array(*[F.lit(t) for t in texts])).otherwise(advice)
    high = F.when(
        c("null_rate") > 0.1,
        F.format_string("High null rate (%.1f%%) - consider imputation strategy", c("null_rate") * 100),
    )
    return rows.withColumn("recommendations", F.array_compact(F.concat(advice, F.array(high))))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def semantic_types(rows: DataFrame) -> DataFrame:
    """Fold to the semantic types; image names or file endings come first."""
    image = F.lower("column_name").rlike(names.IMAGE_PATTERN) | (c("image_ratio") > 0.5)
    by_family = _lookup(c("family"), {"time": "temporal", "numeric": "numeric", "text": "text"})
    folded = F.coalesce(_lookup(c("fine_type"), SEMANTIC_OF), by_family, F.lit("unknown"))
    return rows.withColumn("semantic_type", F.when(image, "image").otherwise(folded)).withColumn(
        "confidence", F.when(image, F.greatest("confidence", F.lit(0.7))).otherwise(c("confidence"))
    )


def column_roles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("role", _lookup(c("semantic_type"), ROLE_OF))


def understand(df: DataFrame, approx: bool = False) -> DataFrame:
    """Evidence, hints, types, confidence, semantics and roles of every column."""
    typed = type_confidence(column_types(name_hints(evidence(df, approx))))
    return column_roles(type_recommendations(semantic_types(typed)))


def table_structure(rows: DataFrame) -> DataFrame:
    """iid, time series or panel, with the time and entity column and the sample to draw.

    A column unique per row names the row, not an entity.
    """
    name = F.lower("column_name")
    is_time = name.endswith("_at") | name.rlike(names.HINT_PATTERNS["temporal"]) | (c("family") == "time")
    is_entity = name.rlike(names.ENTITY_PATTERN) & ~is_time & (c("distinct_count") < c("total_count"))
    found = rows.agg(
        F.max("total_count").alias("row_count"),
        F.min_by("column_name", F.when(is_time, c("ordinal"))).alias("time_column"),
        F.min_by("column_name", F.when(is_entity, c("ordinal"))).alias("entity_column"),
    )
    kind = (
        F.when(c("time_column").isNotNull() & c("entity_column").isNotNull(), "panel")
        .when(c("time_column").isNotNull(), "time_series")
        .otherwise("iid")
    )
    rows_wanted = F.lit(0)
    for k, n in STRUCTURE_SAMPLE_ROWS.items():
        rows_wanted = F.when(c("structure_type") == k, n).otherwise(rows_wanted)
    return (
        found.withColumn("structure_type", kind)
        .withColumn("sample_size", rows_wanted)
        .withColumn("sampling_strategy", _lookup(c("structure_type"), STRUCTURE_SAMPLING))
    )


def sorted_structure(breaks: DataFrame, has_time: bool, has_entity: bool) -> DataFrame:
    """Structure with the evidence whether rows arrive in time order."""
    kind = "cross_sectional" if not has_time else ("panel" if has_entity else "time_series")
    return breaks.select(
        "n_rows", "breaks", (c("breaks") == 0).alias("sorted_by_time"), F.lit(kind).alias("structure_type")
    )


def type_summary(rows: DataFrame) -> DataFrame:
    """Column lists per fact: types, high-null, id, categorical, numeric, cardinality ends."""
    facts = F.array_compact(
        F.array(
            F.concat(F.lit("type:"), c("fine_type")),
            F.when(c("null_rate") > 0.3, F.lit("high_null")),
            F.when(c("fine_type").contains("identifier"), F.lit("identifier")),
            F.when(c("fine_type").contains("categorical"), F.lit("categorical")),
            F.when(c("fine_type").contains("numeric"), F.lit("numeric")),
            F.when(c("cardinality") > 0.9, F.lit("high_cardinality")),
            F.when((c("cardinality") > 0) & (c("cardinality") < 0.05), F.lit("low_cardinality")),
        )
    )
    # One entry per column of the table at most.
    listed = F.array_join(F.array_sort(F.collect_list("column_name")), "|")
    return (
        rows.select("column_name", F.explode(facts).alias("fact"))
        .groupBy("fact")
        .agg(F.count(F.lit(1)).alias("n_columns"), listed.alias("columns"))
    )


def _rank(rows: DataFrame, *order: Column) -> DataFrame:
    # One row per column of the table.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def numeric_ranking(rows: DataFrame) -> DataFrame:
    """Numeric columns, the most complete and surest first."""
    numeric = rows.filter(c("semantic_type") == "numeric")
    ranked = _rank(numeric, c("null_rate").asc(), c("confidence").desc(), F.lower("column_name"))
    return ranked.select("column_name", rounded(c("null_rate")).alias("null_rate"), "confidence", "rank")


def categorical_candidates(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Text or categorical columns with few values (top five), and the temporal ones."""
    textual = c("semantic_type").isin("categorical", "text") | (c("family") == "text")
    few = (c("distinct_count") <= 50) | (c("cardinality") <= 0.2)
    best = _rank(rows.filter(textual & few), c("cardinality").asc(), c("ordinal").asc()).filter(c("rank") <= limit)
    temporal = (c("semantic_type") == "temporal") | (c("family") == "time") | F.lower("column_name").rlike(names.TIME_AXIS_PATTERN)
    times = _rank(rows.filter(temporal), c("ordinal").asc())
    cols = ("column_name", "distinct_count")
    return best.select(F.lit("categorical").alias("kind"), *cols, "rank").unionByName(
        times.select(F.lit("temporal").alias("kind"), *cols, "rank")
    )


def dims_and_metrics(rows: DataFrame) -> DataFrame:
    """Chart dimensions (few-valued text, time) and metrics (numbers)."""
    kind = (
        F.when((c("family") == "text") & (c("cardinality") < 0.1), "categorical")
        .when(c("family") == "time", "temporal")
        .when(c("family") == "numeric", "numeric")
    )
    return (
        rows.withColumn("kind", kind)
        .filter(c("kind").isNotNull())
        .select("column_name", F.when(c("kind") == "numeric", "metric").otherwise("dimension").alias("use"), "kind")
    )
