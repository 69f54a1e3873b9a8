"""Quality rules: repetition counts of each document and line frequency across documents, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, carried, join_small, returned, stage_table, table

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: A line is boilerplate of a host when it is in more than so many different texts of it, whatever the size of the host.
LINE_DOCUMENTS = 20
#: A document is depleted when boilerplate makes up more than this share of its words, or leaves fewer than LEAST_WORDS.
MOST_BOILERPLATE = 0.5
#: Boilerplate lines are looked up in one list per host up to so many lines of a host and in all; beyond, documents are joined to their own, frequent lines dealt over SALTS.
LISTED, LISTED_ALL, SALTS = 1_000, 100_000, 16


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    """Hash of a line in lower case, white space runs as one space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in windows found twice or more in the array.

    Windows are compared by 64-bit hashes within one document. Most arrays have no repeated hash and
    stop there; in the others, sorting brings equal hashes together and the covered stretches add up.
    """
    hashes = F.when(
        F.size(words) >= window, F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    )

    def covered(h: Column) -> Column:
        in_order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            return F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))

        starts = F.array_sort(F.transform(F.flatten(F.transform(F.array(in_order), again)), lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n")),
            lambda s, x: F.struct(x.alias("at"), (s["n"] + F.least(F.lit(window), x - s["at"])).alias("n")),
            lambda s: s["n"],
        )

    counted = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)))[0]
    return F.coalesce(counted, F.lit(0)).cast("long")


def clean_documents(docs: DataFrame, text: str = "text", **kw) -> DataFrame:
    """docs without the rejected ones, their text without the boilerplate lines of their host; other columns unchanged.

    The condition names _row, which no filter passes: below it, kept would be copied into the lambdas that it
    is made of and its word lists made anew for every element. Edge cases: see judged().
    """
    kept = judged(docs, text=text, **kw).filter("kept and _row >= 0")
    return kept.select(*returned(docs.columns, **{text: F.when(F.col("n_removed_lines") > 0, F.col("_rest")).otherwise(F.col("_in")[text])}))


def judged(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    documents: int = LINE_DOCUMENTS,
    boilerplate: float = MOST_BOILERPLATE,
    listed: int = LISTED,
) -> DataFrame:
    """Rows of docs as _in with _row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, boilerplate_words, n_removed_lines, _rest, kept.

    Each line's normalised hash counts once per text; per host, lines found in more than `documents` different
    texts are boilerplate. Equal texts of a host count once, so that copies, of which a later stage keeps one,
    are not taken for boilerplate. _rest is the text without its boilerplate lines; all counts are of the
    original text. A document is kept if it passes the base rules and is not depleted by the removal. Counts
    are combined per task before they are shuffled by (host, hash), so a hot host or line makes no large
    group. Where a host has more than `listed` boilerplate lines, each text is joined to those it holds.

    Null and empty texts have zero counts and fail. A null host is a host of its own. Rows are kept apart
    whatever their ids: repeated rows each get a verdict. An empty table gives an empty result. Very long
    texts are one row's work, near linear in their length. Columns of any name are carried in _in.
    """
    rows = carried(docs, _host=F.col(f"`{host}`"), _text=F.coalesce(F.col(f"`{text}`"), F.lit("")))

    keys = {"_k": F.struct("_host"), "_key": F.md5("_text")}
    hashes = F.array_distinct(F.transform(lines_with_words(F.col("_text")), line_hash))
    lines = rows.select(keys["_k"].alias("_k"), keys["_key"].alias("_key"), hashes.alias("h"))
    counted = lines.dropDuplicates(["_k", "_key"]).select("_k", F.explode("h").alias("h")).groupBy("_k", "h").agg(F.count("*").alias("n"))
    common = stage_table(counted.filter(F.col("n") > documents).select("_k", "h"), "quality-lines")

    longest, total = common.groupBy("_k").count().agg(F.max("count"), F.sum("count")).first()
    if (longest or 0) <= listed and (total or 0) <= LISTED_ALL:
        rows = join_small(rows.withColumn("_k", keys["_k"]), common.groupBy("_k").agg(F.collect_list("h").alias("_common")), "_k", "left")
    else:
        held = lines.select("_k", "_key", F.explode("h").alias("h")).withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
        dealt = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        held = held.join(dealt, ["_k", "h", "_salt"]).groupBy("_k", "_key").agg(F.collect_set("h").alias("_common"))
        rows = join_small(rows.withColumns(keys), stage_table(held, "quality-held"), ["_k", "_key"], "left", 50_000)
    rows = rows.withColumns({"_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), "_lines": lines_with_words(F.col("_text"))})
    gone = F.when(F.col("_common").isNotNull(), F.filter("_lines", lambda x: F.array_contains("_common", line_hash(x))))
    rows = rows.withColumn("_gone", F.coalesce(gone, F.array().cast("array<string>")))
    rest = F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("_gone", x)), "\n")
    out = rows.select(
        "_in",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.aggregate("_gone", F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(WORD))).cast("long").alias("boilerplate_words"),
        F.size("_gone").cast("long").alias("n_removed_lines"),
        F.when(F.size("_gone") > 0, rest).otherwise(F.col("_text")).alias("_rest"),
        F.monotonically_increasing_id().alias("_row"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    depleted = (F.col("boilerplate_words") > F.lit(boilerplate) * F.col("n_words")) | (F.col("n_words") - F.col("boilerplate_words") < LEAST_WORDS)
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document, with what the removal of boilerplate lines takes and the md5 of the text it leaves. Edge cases: see judged()."""
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_words", "n_removed_lines")
    return found.select(F.col("_in.doc_id").alias("doc_id"), *counts, F.md5("_rest").alias("rest_md5"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ln FROM d),
g AS (SELECT r, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g,
             unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
p AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 8) AS gap FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
q AS (SELECT r, sum(least(8, gap))::BIGINT AS n_repeat_words FROM p GROUP BY r),
l AS (SELECT r, source, unnest(ln) AS l FROM w),
m AS (SELECT r, source, l, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
             len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS wc FROM l),
s AS (SELECT m.source, h, count(DISTINCT md5(d.t)) AS n FROM m JOIN d USING (r) GROUP BY ALL),
c AS (SELECT source, h FROM s WHERE n > 20),
b AS (SELECT m.r, sum(wc)::BIGINT AS boilerplate_words, count(*) AS n_removed_lines, list(DISTINCT l) AS gone FROM m JOIN c ON m.h = c.h AND m.source IS NOT DISTINCT FROM c.source GROUP BY m.r),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(boilerplate_words, 0)::BIGINT AS boilerplate_words, coalesce(n_removed_lines, 0) AS n_removed_lines,
             md5(CASE WHEN gone IS NULL THEN t ELSE array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT list_contains(gone, x)), chr(10)) END) AS rest_md5
      FROM w LEFT JOIN q USING (r) LEFT JOIN b USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND boilerplate_words <= 0.5 * n_words AND n_words - boilerplate_words >= 20 AS kept,
       boilerplate_words, n_removed_lines, rest_md5
FROM o
"""
