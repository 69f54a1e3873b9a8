"""Sinks: append without repeats, keyed upsert, canonical tables, constraint checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longtext.schema import untyped


def new_rows(batch: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the batch whose key is neither in existing nor earlier in the batch.

    Both sides are dealt by key over spark.sql.shuffle.partitions tasks, a number that Spark then keeps: keys compress well, so
    partitions merged by their shuffled bytes would hold very many of them in one task's tables.
    """
    tasks = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return batch.repartition(tasks, key).join(existing.select(key).repartition(tasks, key), key, "left_anti").dropDuplicates([key])


def append(batch: DataFrame, path: str, key: str = "id") -> int:
    """Append new rows to a parquet table, creating it if absent; the number appended."""
    spark = batch.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    rows = batch.dropDuplicates([key])
    if there:
        old = spark.read.parquet(path)
        rows = new_rows(batch.select(*[c for c in batch.columns if c in old.columns]), old, key)
    rows = rows.persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(path)
        return n
    finally:
        rows.unpersist()


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row per key by order, the new side winning ties."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col("_side").desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_side")


def latest(df: DataFrame, key: str | list[str], *order) -> DataFrame:
    """Latest row per key (one column or several) by struct maximum: combined per task before the shuffle, so a hot key is no large group."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(o) for o in order], *[F.col(c) for c in cols if c not in order])).alias("x"))
    return best.select(*keys, *[F.col(f"x.{c}").alias(c) for c in cols])


def save_metadata(df: DataFrame, path: str) -> int:
    """Canonical columns as CSV and parquet in a new folder under path, which becomes the current one when both are whole; its version."""
    from longtext.sources import versions

    rows, run = untyped(df), f"runs/{uuid.uuid4().hex}"
    rows.write.option("header", True).option("emptyValue", "").option("escape", '"').csv(f"{path}/{run}/csv")
    rows.write.parquet(f"{path}/{run}/parquet")
    spark = df.sparkSession
    found = versions.versions(spark, path)
    return versions.publish(spark, path, found[-1] if found else 0, {"run": run})


def metadata_folder(spark: SparkSession, path: str) -> str:
    """Where the current metadata lie: a folder with csv and parquet."""
    from longtext.sources import versions

    told = versions.record(spark, path)
    if told is None:
        raise FileNotFoundError(f"{path} has no metadata")
    return f"{path}/{told['run']}"


def save_features(df: DataFrame, path: str) -> None:
    """Feature table: leading text columns, then the rest by name."""
    lead = [c for c in ("id", "spacy_model", "extractor_version") if c in df.columns]
    df.select(*lead, *sorted(c for c in df.columns if c not in lead)).write.mode("overwrite").parquet(path)


def serving_tables(spark: SparkSession, database: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Create the database if absent, overwrite its tables, and return their row counts."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
    return {name: spark.table(f"`{database}`.`{name}`").count() for name in tables}


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: str, key: str) -> DataFrame:
    return child.join(parent.select(F.col(key).alias(on)).distinct(), on, "left_anti")


def cascade_delete(child: DataFrame, removed: DataFrame, on: str) -> DataFrame:
    return child.join(removed.select(on).distinct(), on, "left_anti")
