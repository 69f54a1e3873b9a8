"""Words of documents met with tables of words: stems, syllables, valences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longtext.functions import lexicons as L
from longtext.functions import text as X
from longtext.functions import udfs as U

#: A table of at most so many words is broadcast whole. Of a larger one, the words that make up at least one in FREQUENT of all rows are
#: (there are at most FREQUENT of them), and the others, each rare, meet by a shuffle.
SMALL, FREQUENT = 200_000, 100_000


def met(rows: DataFrame, table: DataFrame, word: str = "word", small: int = SMALL, frequent: int = FREQUENT) -> DataFrame:
    """rows left-joined with a table of one row per word; a word that a third of the rows share is never shuffled to one task."""
    if table.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(table), word, "left")
    counts = rows.groupBy(word).agg(F.count("*").alias("_n"))
    total = rows.count()
    often = counts.filter(F.col("_n") * frequent >= total).select(word)
    marked = rows.join(F.broadcast(often.withColumn("_often", F.lit(True))), word, "left")
    hot = table.join(F.broadcast(often), word, "left_semi")
    common = marked.filter("_often").drop("_often").join(F.broadcast(hot), word, "left")
    rare = marked.filter("_often is null").drop("_often").join(table, word, "left")
    return common.unionByName(rare)


def unique_stems(rows: DataFrame, stem: Callable[[Column], Column] = U.lancaster_stem, key: str = "id", words: str = "w") -> DataFrame:
    """(key, unique_words): different stems of the words in an array; each distinct word is stemmed once."""
    said = rows.select(key, F.explode(F.array_distinct(words)).alias("word"))
    stems = said.select("word").distinct().withColumn("stem", stem(F.col("word")))
    return met(said, stems).groupBy(key).agg(F.count_distinct("stem").alias("unique_words"))


def dictionary_readability(docs: DataFrame, dictionary: DataFrame, key: str = "id", text: str = "text", small: int = SMALL) -> DataFrame:
    """(key, words, sentences, syllables, known, ease, grade) with the syllables of a pronouncing dictionary (word, syllables).

    Words are looked up in lower case; those that the dictionary lacks count their vowel groups, as all do without one. Its first entry in order counts
    where it has several for a word. A document's words are counted before they are looked up. Texts of fewer than 20 words have no scores.
    """
    table = dictionary.select(F.lower("word").alias("word"), "syllables").groupBy("word").agg(F.min("syllables").alias("syllables"))
    rows = docs.select(key, X.lower_words(F.col(text)).alias("w"), F.size(X.sentences(F.col(text))).alias("sentences"))
    said = rows.select(key, "sentences", F.explode_outer("w").alias("word")).groupBy(key, "sentences", "word").agg(F.count("word").alias("n"))
    told = met(said, table, small=small)
    one = F.coalesce("syllables", F.greatest(F.lit(1), F.regexp_count("word", F.lit("[aeiouy]+"))), F.lit(0))
    sums = told.groupBy(key, "sentences").agg(F.sum("n").alias("words"), F.sum(F.col("n") * one).alias("syllables"), F.sum(F.when(F.col("syllables").isNotNull(), F.col("n")).otherwise(0)).alias("known"))
    n, s, y = F.col("words"), F.col("sentences"), F.col("syllables")
    return sums.select(key, "words", "sentences", "syllables", "known", X.reading_ease(n, s, y).alias("ease"), X.grade_level(n, s, y).alias("grade"))


def indicators(docs: DataFrame, tag: Callable[[DataFrame], DataFrame], most: int = L.STUDY_WORDS, stem: Callable[[Column], Column] = U.lancaster_stem, key: str = "id", text: str = "text") -> DataFrame:
    """(key, unique_words, ns_fill, idea) over the first `most` lower-case words of every text that has as many.

    tag turns (id, text) into token rows (id, pos, is_alpha), for example annotate() with a tagger: it sees those words alone, joined by spaces.
    """
    rows = docs.select(F.col(key).cast("string").alias("id"), X.lower_words(F.col(text)).alias("w")).filter(F.size("w") >= most).withColumn("w", F.slice("w", 1, most))
    counts = rows.select("id", X.study_features(F.col("w"), most)["ns_plus_fillers"].alias("ns_fill"))
    alpha = F.count_if("is_alpha")
    tokens = tag(rows.select("id", F.array_join("w", " ").alias("text")))
    ideas = tokens.groupBy("id").agg(F.when(alpha > 0, F.count_if(F.col("is_alpha") & F.col("pos").isin(*L.PROPOSITION_POS)) / alpha).otherwise(0.0).alias("idea"))
    both = counts.join(unique_stems(rows, stem), "id").join(ideas, "id", "left").withColumn("idea", F.coalesce("idea", F.lit(0.0)))
    return both.select(F.col("id").cast(docs.schema[key].dataType).alias(key), "unique_words", "ns_fill", "idea")


def valences(lexicon: DataFrame, most: int = 100_000) -> dict[str, float]:
    """A sentiment lexicon table (token, valence) as the dictionary that the scorer takes; it is a word list, so a table beyond `most` rows is refused."""
    rows = lexicon.select("token", F.col("valence").cast("double").alias("valence")).dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon of more than {most} rows")
    return {r.token: r.valence for r in rows}
