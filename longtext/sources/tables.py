"""Table and file scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longtext.functions.text import date_in_name, speaker_of, stable_id, strip, without_comment_lines
from longtext.schema import METADATA_STRINGS, typed


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metadata CSV as typed columns; nothing is inferred. Fields may hold newlines and quotes."""
    read = spark.read.schema(METADATA_STRINGS).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    return typed(read.csv(path))


def features_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV: three leading text columns, the rest doubles."""
    raw = spark.read.option("header", True).csv(path)
    lead = ("id", "spacy_model", "extractor_version")
    return raw.select(*[F.col(f"`{c}`") if c in lead else F.nullif(F.col(f"`{c}`"), F.lit("")).try_cast("double").alias(c) for c in raw.columns])


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, name, text): whole files, comment lines out; the glob prunes the listing."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")
    return rows.withColumn("date", F.try_to_date(F.nullif(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")).select(
        "path", "name", "date", without_comment_lines(F.col("value")).alias("text")
    )


SIDECAR = "title string, date string, president string, source_url string, event_type string, machine_generated boolean, location string"


def drop_folder(spark: SparkSession, path: str, source: str, least: int = 100) -> DataFrame:
    """Files of a drop folder with their JSON sidecars: one row per file with enough content.

    Sidecar fields come first; otherwise the title is the file's name, the date is read from it, and the
    speaker from it or from the start of the text. Scores: 0.5 for machine transcripts, else 0.7.
    """
    from longtext.sources.html import page_text

    read = lambda glob: spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value"))
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    files = read("*.{txt,html,htm}").withColumn("stem", stem(F.col("name")))
    content = F.when(F.lower("name").rlike(r"\.html?$"), page_text("value")).otherwise(F.col("value"))
    files = files.withColumn("text", strip(content)).filter(F.length("text") >= least)
    cars = read("*.json").select(stem(F.col("name")).alias("stem"), F.from_json("value", SIDECAR).alias("meta"))
    rows = files.join(cars, "stem", "left")
    some = lambda c: F.nullif(F.col(f"meta.{c}"), F.lit(""))
    rows = rows.withColumns(
        {
            "title": F.coalesce(some("title"), F.translate("stem", "_-", "  ")),
            "date": F.coalesce(F.try_to_date(some("date"), "yyyy-MM-dd"), date_in_name(F.col("stem"))),
            "speaker": F.coalesce(some("president"), speaker_of(F.col("stem")), speaker_of(F.substring("text", 1, 800)), F.lit("unknown")),
            "source": F.lit(source),
            "source_url": some("source_url"),
            "machine": F.coalesce(F.col("meta.machine_generated"), F.lit(source == "youtube")),
        }
    )
    return rows.select(
        stable_id(F.col("source"), F.coalesce("source_url", "name"), F.col("date")).alias("id"),
        "speaker", "date", F.year("date").alias("year"), "title", "source", "source_url",
        some("event_type").alias("event_type"), some("location").alias("location"),
        F.when(F.col("machine"), 0.5).otherwise(0.7).alias("quality_score"),
        F.when(F.col("machine"), "machine-generated captions").alias("notes"), "text",
    )
