"""Importance resampling towards a target distribution: features hashed to buckets as texts are read, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, stage_table, table
from .manifest import CRC, CRC_TABLE

BUCKETS, RUN = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, "2024"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word before its letters are made lower case: digits, ASCII letters and anything beyond ASCII.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def features(text: Column, run: int = RUN) -> Column:
    """Runs of 1 to `run` consecutive words, joined by a space, in the letters of the text."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_WORD), F.lit(0))
    if run == 1:
        return words

    def all_runs(w: Column) -> Column:
        of = lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.concat(w, *[F.when(F.size(w) >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(2, run + 1)])

    return F.transform(F.array(words), all_runs)[0]


def words_of(n_features: Column, run: int = RUN) -> Column:
    """Words of a text with so many features."""
    if run == 1:
        return n_features
    short = F.floor((F.sqrt(8 * n_features + 1) - 1) / 2)
    return F.when(n_features >= run * (run + 1) // 2, F.floor((n_features + run * (run - 1) // 2) / run)).otherwise(short)


def lowered(word: Column) -> Column:
    """A-Z made lower case, nothing else; lower() does just that to ASCII, and faster."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def bucket_ids(text: Column, run: int = RUN, buckets: int = BUCKETS) -> Column:
    """The bucket of every feature of a text, in order, repeats included."""
    return F.transform(features(text, run), lambda f: (F.crc32(lowered(f).cast("binary")) % buckets).cast("int"))


def bucket_counts(rows: DataFrame, ids: str) -> dict[int, int]:
    """How many features of all rows lie in each bucket; counts are combined per task, and as many rows as there are buckets come to the driver."""
    counted = rows.select(F.explode(ids).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    return {x.b: x.n for x in counted.collect()}


def gains_of(corpus: dict[int, int], target: dict[int, int], spark: SparkSession, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket: how much likelier the target's features fall into it, in thousandths of a natural logarithm."""
    rows = spark.range(0, buckets, 1, 1).select(
        "id", *[F.get(constant([float(x.get(b, 0)) for b in range(buckets)], "double"), F.col("id").cast("int")).alias(n) for n, x in (("s", corpus), ("t", target))]
    )
    all_s, all_t = float(sum(corpus.values())), float(sum(target.values()))
    ratio = ((F.col("t") + 1) * (F.lit(all_s) + buckets)) / ((F.col("s") + 1) * (F.lit(all_t) + buckets))
    return [x.gain for x in rows.select("id", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).orderBy("id").collect()]


def constant(values: list, kind: str) -> Column:
    """An array of numbers as a constant of the query."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def weighted(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(_row, key, n_features, weight) of every row of docs: the floored mean of its features' gains.

    Texts are read once: the buckets of their features, a few bits each, are stored row by row. They are counted, combined per task,
    and the gains of all buckets, a bounded number, go to all tasks as a constant. No feature and no document is shuffled.
    """
    # the row numbers first, in the order of the table
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), bucket_ids(F.col(text), run, buckets).alias("_ids"))
    rows = stage_table(rows, "importance-buckets")
    aims = target.select(bucket_ids(F.col(text), run, buckets).alias("_ids"))
    gains = constant(gains_of(bucket_counts(rows, "_ids"), bucket_counts(aims, "_ids"), docs.sparkSession, buckets), "long")
    summed = rows.select("_row", "_key", F.size("_ids").cast("long").alias("n_features"), F.aggregate("_ids", F.lit(0).cast("long"), lambda s, b: s + F.get(gains, b)).alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0))
    return summed.select("_row", F.col("_key").alias(key), "n_features", mean.cast("long").alias("weight"))


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise of a key in thousandths, floored: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, key: str, eligible: Column, percent: int) -> DataFrame:
    """Add rank: 1, 2, 3... of the `percent` of the eligible rows with the highest scores, ties to the smaller key; null for the others.

    Scores are whole numbers, so their histogram is small and tells the lowest score drawn; only rows from it up are sorted, by ranges
    of (score, key), with the ranges' sizes added up. Rows below pass by without a shuffle.
    """
    counts = stage_table(scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n")), "importance-scores")
    n = counts.agg(F.sum("n")).first()[0] or 0
    wanted = n * percent // 100
    # the histogram has one row for each score, some ten thousand whatever the corpus
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score"))))
    cut = upto.filter(F.col("upto") - F.col("n") < wanted).agg(F.min("score")).first()[0] if wanted else None
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    may = eligible & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("_row")]
    sorted_rows = scored.filter(may).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    sorted_rows = stage_table(sorted_rows.withColumn("_p", F.shiftright("_m", 33)), "importance-sorted")
    sizes = sorted_rows.groupBy("_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    sizes = stage_table(sizes.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before")), "importance-ranges")
    rank = F.col("_m") - F.col("_first") + F.col("_before") + 1
    ranked = join_small(sorted_rows, sizes, "_p", "inner").withColumn("rank", F.when(rank <= wanted, rank))
    return scored.filter(~may).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, frequent: int | None = None) -> DataFrame:
    """One row per row of docs: key, n_features, weight, score, rank (null where not drawn).

    Null and empty texts have no features, weight 0, and are never drawn, nor are texts of fewer than `least` words. Long texts count whole.
    Rows with a null key share the noise of the empty one and lose ties; repeated keys share their noise, are rows of their own, and break ties
    by their place in the table. An empty target gives gains by the corpus alone; an empty table has no rows. Other columns are not read, whatever their names.
    `frequent` is taken for older callers and has no effect: frequent features are not treated apart any more.
    """
    rows = stage_table(weighted(docs, target, key, text, run, buckets), "importance-weights")
    scored = rows.withColumn("score", F.col("weight") + noise(F.col(key), seed))
    eligible = words_of(F.col("n_features"), run) >= least
    return drawn(scored, key, eligible, percent).select(key, "n_features", "weight", "score", "rank")


def resampled_documents(docs: DataFrame, target: DataFrame, **kw) -> DataFrame:
    """The rows of docs that are drawn, as they are. Rows that share a key are drawn together; rows with a null key are left out."""
    key = kw.get("key", "doc_id")
    chosen = resample(docs, target, **kw).filter("rank is not null").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(chosen, docs[key] == chosen["_drawn"], "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the words of `benchmark`. Edge cases: see resample()."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP13_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT r, unnest(w) AS f FROM d), g AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
v AS (SELECT f, {CRC.format(x="f")} % {BUCKETS} AS bucket FROM (SELECT f FROM f UNION SELECT f FROM g), crc),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM f JOIN v USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*)::DOUBLE AS t FROM g JOIN v USING (f) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS ss, (SELECT count(*) FROM g)::DOUBLE AS tt),
z AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + {BUCKETS}) / ((s + 1) * (tt + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN v USING (f) JOIN z USING (bucket) GROUP BY r),
x AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, {PERCENT} * count(*) OVER () // 100 AS most FROM y WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM y LEFT JOIN e USING (r)
"""
