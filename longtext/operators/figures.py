"""Data of the figures: points and trend ends of each group, with confidence bands, from grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longtext.functions.udfs import pearson_p
from longtext.operators.ranges import broadcast_if_small

#: Half the width of a band in standard errors.
BAND = 1.96


def trend_lines(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, first, last, slope, intercept, r, p, mean_x, sxx, error) of each group's line; one pass, combined per task. Rows with a null in x or y are left out."""
    rows = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    sums = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.coalesce(F.var_pop("x") * F.count("*"), F.lit(0.0)).alias("sxx"), F.coalesce(F.var_pop("y") * F.count("*"), F.lit(0.0)).alias("syy"),
        (F.covar_pop("x", "y") * F.count("*")).alias("sxy"),
    )
    slope = F.when((F.col("n") >= 2) & (F.col("sxx") > 0), F.col("sxy") / F.col("sxx"))
    lines = sums.withColumn("slope", slope).withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))
    r = F.when((F.col("n") >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    left = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    lines = lines.withColumn("r", r).withColumn("p", F.when(F.col("r").isNotNull(), pearson_p("r", F.col("n").cast("double"))))
    return lines.withColumn("error", F.when(F.col("n") >= 3, F.sqrt(left / (F.col("n") - 2)))).select(key, "n", "first", "last", "slope", "intercept", "r", "p", "mean_x", "sxx", "error")


def _at(x: Column) -> dict[str, Column]:
    value = F.col("intercept") + F.col("slope") * x
    half = BAND * F.col("error") * F.sqrt(1 / F.col("n") + (x - F.col("mean_x")) * (x - F.col("mean_x")) / F.col("sxx"))
    return {"y": value, "low": value - half, "high": value + half}


def trend_ends(lines: DataFrame, key: str) -> DataFrame:
    """Two rows of each line (key, x, y, low, high): its first and its last x, with the band of the mean there. Groups without a line give none."""
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("x"), *[v.alias(k) for k, v in _at(F.col(c)).items()]) for c in ("first", "last")]))
    return lines.filter("slope is not null").select(key, ends.alias("_e")).select(key, "_e.*")


def cohort_points(df: DataFrame, lines: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x, y, progress, line, low, high): every point, how far along its group it is, and the group's line and band there."""
    rows = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    met = rows.join(broadcast_if_small(lines.withColumnRenamed(key, "_key")), F.col(key).eqNullSafe(F.col("_key")))
    at = _at(F.col("x"))
    progress = F.col("x") / F.when(F.col("last") == 0, 1.0).otherwise(F.col("last"))
    return met.select(key, "x", "y", progress.alias("progress"), at["y"].alias("line"), at["low"].alias("low"), at["high"].alias("high"))


def overlay_ends(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, start, end, r, p, n): each group's line over its own progress, from 0 to 1."""
    most = df.groupBy(F.col(key).alias("_key")).agg(F.max(x).alias("_most"))
    scaled = df.join(broadcast_if_small(most), F.col(key).eqNullSafe(F.col("_key"))).withColumn("_x", F.col(x) / F.when(F.col("_most") == 0, 1.0).otherwise(F.col("_most")))
    lines = trend_lines(scaled, key, "_x", y).filter("slope is not null")
    return lines.select(key, F.col("intercept").alias("start"), (F.col("intercept") + F.col("slope")).alias("end"), "r", "p", "n")
