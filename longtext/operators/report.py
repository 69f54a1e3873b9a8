"""Reports: value counts, pivots, averages, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) with blanks and nulls as (blank)."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("(blank)"))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(blank)")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def matrix(df: DataFrame, rows: str, columns: str, values: list | None = None) -> DataFrame:
    """Counts of rows by columns, 0 where none. Give the values to save the scan that finds them."""
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def numeric_mean(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).try_cast("double")).alias(c) for c in columns])


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """(canonical, clusters, multi) in one row."""
    per = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if("is_canonical").alias("c"))
    return per.agg(F.sum("c").alias("canonical"), F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("multi"))


def markdown_table(rows: list[tuple], headers: tuple[str, ...]) -> str:
    lines = ["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers)]
    return "\n".join(lines + ["| " + " | ".join(map(str, r)) + " |" for r in rows]) + "\n"


def corpus_report(df: DataFrame, counted: list[str], averaged: list[str], words: str = "word_count") -> str:
    """Markdown of small aggregates: totals, counts by column, means."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.col(words).try_cast("double")), F.lit(0.0))).first()
    out = [f"# Collection report\n\n**Total transcripts:** {n}\n\n**Total words:** {int(total):,}\n"]
    for c in counted:
        found = [tuple(r) for r in value_counts(df, c).orderBy(F.desc("n"), "value").collect()]
        out.append(f"## Counts by {c}\n\n{markdown_table(found, (c, 'count'))}")
    means = numeric_mean(df, *averaged).first().asDict() if averaged else {}
    out.append("## Averages\n\n" + "".join(f"- mean {k}: {v if v is None else round(v, 4)}\n" for k, v in means.items()))
    return "\n".join(out)
