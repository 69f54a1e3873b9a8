"""Typed schemas, and the boundary from all-string metadata to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longtext.functions.lexicons import CODE_NAMES, METADATA_FIELDS, PUBLISHED, SPEAKERS
from longtext.functions.text import to_bool

DATES, BOOLS = ("date", "retrieval_date"), ("has_q_and_a", "is_canonical")
INTS = ("year", "word_count", "char_count", "sentence_count", "paragraph_count", "speaker_label_count", "question_count")
DOUBLES = (
    "quality_score", "mean_sentence_length", "median_sentence_length", "type_token_ratio", "flesch_reading_ease",
    "flesch_kincaid_grade", "question_answer_ratio", "event_duration_seconds",
)

METADATA_STRINGS = ", ".join(f"`{c}` string" for c in METADATA_FIELDS)


def typed(df: DataFrame) -> DataFrame:
    """Metadata of strings as typed columns: blanks are null, and what does not parse is null."""
    out = []
    for c in df.columns:
        v = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        if c in DATES:
            v = F.try_to_date(v, "yyyy-MM-dd")
        elif c in BOOLS:
            v = to_bool(v)
        elif c in INTS:
            v = v.try_cast("int")
        elif c in DOUBLES:
            v = v.try_cast("double")
        out.append(v.alias(c))
    return df.select(*out)


def untyped(df: DataFrame) -> DataFrame:
    """Canonical columns in their order, as strings with blanks for nulls; extra columns are left out, missing ones are blank."""
    out = []
    for c in METADATA_FIELDS:
        v = F.col(c) if c in df.columns else F.lit("")
        if c in df.columns and dict(df.dtypes)[c] == "boolean":
            v = F.when(v, "1").otherwise(F.when(~v, "0"))
        out.append(F.coalesce(v.cast("string"), F.lit("")).alias(c))
    return df.select(*out)


def speakers(spark) -> DataFrame:
    return spark.createDataFrame(list(SPEAKERS), "key string, name string, names array<string>, collect_from string, collect_to string").withColumns(
        {c: F.to_date(c) for c in ("collect_from", "collect_to")}
    )


def code_names(spark) -> DataFrame:
    return spark.createDataFrame(list(CODE_NAMES.items()), "code string, name string")


def published(spark) -> DataFrame:
    return spark.createDataFrame(list(PUBLISHED), "speaker string, feature string, r double, p double, n int")
