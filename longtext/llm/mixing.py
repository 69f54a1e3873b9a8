"""Mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, carried, returned, small_enough, stage_table, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2
#: Hex digits of the key that name a range of it: 4096 ranges for each source.
RANGE_DIGITS = 3
#: The order of a source's rows.
ORDER = ("key", "id", "size", "_row")


def word_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per source (source, source_size, target).

    Weights go to sources in code-point order, null last, repeating. A target stops at `most` times
    its source's size and the excess is reshared by weight: the fixed point is min(cap, weight * level),
    and the level follows from the sources in order of cap / weight. The table has one row per source,
    so its unpartitioned windows are small whatever the corpus holds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    rows = per.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("level", level).withColumn("level", F.max(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))).over(everything))
    return rows.select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))).alias("target")
    )


def keyed(docs: DataFrame, wide: bool, seed: str) -> DataFrame:
    """Stored rows of docs: _row, id, source, size, key and part, with the caller's columns in _in if wide.

    The key is random by md5 of seed and doc_id; rows without an id take their row number instead, so that they spread as well.
    """
    rows = docs if wide else docs.select("doc_id", "source", "text")
    rows = carried(rows, id=F.col("doc_id"), source=F.col("source"), size=word_size(F.col("text"))).withColumn("_row", F.monotonically_increasing_id())
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.col("_row")))
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), name))).withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    return stage_table(rows if wide else rows.drop("_in"), "mix-rows")


def placed(rows: DataFrame, weights, share: float, most: float) -> DataFrame:
    """Rows of keyed() with source_size, target, whole (epochs that take all of the source) and left: the words that the last epoch still lacks where the row begins."""
    sizes = rows.select("_row", "id", "source", "size", "key", "part")
    targets = stage_table(source_targets(sizes, weights, share, most), "mix-targets")
    targets = F.broadcast(targets) if small_enough(targets, 100_000) else targets
    ranges = sizes.groupBy("source", "part").agg(F.sum("size").alias("in_part"))
    ranges = ranges.withColumn("before_part", F.sum("in_part").over(Window.partitionBy("source").orderBy("part")) - F.col("in_part"))
    inside = Window.partitionBy("source", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    r, s, t = sizes.withColumn("upto", F.sum("size").over(inside)).alias("r"), ranges.alias("s"), targets.alias("t")
    both = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.part") == F.col("s.part")))
    both = both.join(t, F.col("r.source").eqNullSafe(F.col("t.source")))
    budget = F.floor(F.col("t.target"))
    whole = F.when(F.col("t.source_size") > 0, F.floor(budget / F.col("t.source_size"))).otherwise(0)
    left = budget - whole * F.col("t.source_size") - (F.col("s.before_part") + F.col("r.upto") - F.col("r.size"))
    return both.select("r.*", "t.source_size", "t.target", whole.alias("whole"), left.alias("left"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = "mix-1") -> DataFrame:
    """Words that a mix takes of each document: (doc_id, source, size, source_size, target, taken).

    Every document gets a random key. Equal ranges of that uniform key are the range partition: sums per
    (source, range), their running sum within a source (at most 4096 rows each), and a running sum inside
    each range give every document the words before it in its source's order. Whole epochs take all of a
    source; the last epoch is cut at the exact budget, so the document on the cut gives only the words still
    missing. No task holds more than one range of one source.

    Nulls: text counts as 0 words, a null source is a source of its own, rows with a null doc_id have keys of
    their own. Repeated doc_ids share a key and fall back to size and row for their order, so each row counts
    once. Empty input: no rows. Other columns are not read.
    """
    rows = placed(keyed(docs, False, seed), weights, share, most)
    taken = F.col("whole") * F.col("size") + F.least("size", F.greatest(F.lit(0), "left"))
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = "mix-1") -> DataFrame:
    """The mix as documents: each row once per epoch that reaches it, columns unchanged.

    The last row that each source's last epoch reaches is its cut, one row per source; every document compares
    its own place with it, so texts are not shuffled. A document on the cut is kept whole here (training
    rows are not torn), so a source passes its budget by less than one document, whatever ids are null or
    repeated. Rows without words are left out; an empty table gives none; columns of any name are carried.
    """
    rows = keyed(docs, True, seed)
    cuts = placed(rows, weights, share, most).groupBy("source").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("left") > 0, F.struct(*ORDER))).alias("cut"))
    cuts = stage_table(cuts, "mix-cuts").select(F.col("source").alias("of"), "whole", "cut")
    both = rows.join(F.broadcast(cuts) if small_enough(cuts, 100_000) else cuts, F.col("source").eqNullSafe(F.col("of")))
    times = F.col("whole") + F.coalesce((F.struct(*ORDER) <= F.col("cut")).cast("int"), F.lit(0))
    kept = both.filter(F.col("size") > 0).withColumn("_times", times.cast("int")).filter("_times > 0")
    return kept.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*returned(docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by weights 5, 2, 1 and 150 % of all words. Edge cases: see mix()."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(w) OVER ()
                 - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
      FROM w),
t AS (SELECT source, source_size, cap, w, max(CASE WHEN cap / w >= lev THEN lev END) OVER () AS level FROM l),
u AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, w * level) END AS target FROM t),
c AS (SELECT d.*, u.source_size, u.target,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
e AS (SELECT *, floor(target)::BIGINT AS budget,
             CASE WHEN source_size > 0 THEN (floor(target)::BIGINT // source_size) ELSE 0 END AS whole FROM c)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, budget - whole * source_size - before)))::BIGINT AS taken, source
FROM e
"""
