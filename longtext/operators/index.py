"""A maintained full-text index: stemmed posting lists in segments, bucketed by term; appends add a segment, merges join them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longtext.functions.udfs import english_stem, english_stem_udf
from longtext.operators.ranges import broadcast_if_small
from longtext.operators.search import plain_lexemes, query_lexemes
from longtext.sources.versions import publish, record

#: Documents whose ids share one list of a term: the list of a term that every document has is cut into parts of about so many.
PART = 4096
#: Parts of a folder whose lists one task writes.
PARTS_A_TASK = 16


def parts_of(docs: DataFrame, part: int = PART) -> int:
    return max(1, -(-docs.count() // part))


def posting_lists(docs: DataFrame, stems, part: int = PART) -> DataFrame:
    """(lexeme, part, ids) of docs (id, text): sorted distinct ids, dealt to parts by a hash of the id.

    Lists are made by word first, so each distinct word is stemmed once for a part and not for every document that holds it; the lists
    of words with the same stem are then one. No list is longer than its part, however common the term.
    """
    parts = parts_of(docs, part)
    words = docs.select("id", F.explode(plain_lexemes(F.col("text"))).alias("word"))
    lists = words.groupBy("word", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list("id").alias("ids"))
    known = lists.select("word").distinct().withColumn("lexeme", stems(F.col("word")))
    joined = lists.join(broadcast_if_small(known), "word")
    return joined.groupBy("lexeme", "part").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


@dataclass
class TextIndex:
    """Posting lists of documents (id, text) under `path`.

    A segment is the lists of one batch, in folders by a hash of the term, and the ids of its documents. The newest version names the segments
    in order; an id in a later segment replaces what earlier ones say of it. A search reads the folders of its terms alone. A batch that
    dies before its version is published is not seen. Null and blank texts are documents without terms; rows with a null id are left out; of equal
    ids in a batch all texts count.

    stems: an expression from word to lexeme (English Snowball by default) and the same for the words of a query.
    """

    spark: SparkSession
    path: str
    buckets: int = 32
    stems: object = english_stem_udf
    stem_word: object = english_stem
    part: int = PART

    def _told(self) -> dict:
        return record(self.spark, self.path) or {"version": 0, "segments": []}

    def _bucket(self, lexeme: Column) -> Column:
        return F.pmod(F.crc32(lexeme.cast("binary")), F.lit(self.buckets)).cast("int")

    def _write(self, lists: DataFrame, ids: DataFrame, parts: int) -> str:
        run = f"segments/{uuid.uuid4().hex}"
        rows = lists.withColumn("b", self._bucket(F.col("lexeme")))
        # lists of a folder are dealt by their part as well, so that more documents are more tasks and files, not larger ones
        rows.repartition(self.buckets * (-(-parts // PARTS_A_TASK)), "b", F.floor(F.col("part") / PARTS_A_TASK)).sortWithinPartitions("b", "lexeme", "part").write.partitionBy("b").parquet(f"{self.path}/{run}/lists")
        ids.write.parquet(f"{self.path}/{run}/ids")
        return run

    def append(self, docs: DataFrame) -> int:
        """Add documents, or replace those with known ids; the new version."""
        told = self._told()
        rows = docs.select("id", "text").filter("id is not null")
        run = self._write(posting_lists(rows, self.stems, self.part), rows.select("id").distinct(), parts_of(rows, self.part))
        return publish(self.spark, self.path, told["version"], {"segments": [*told["segments"], run]})

    def _ids(self, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{r}/ids" for r in runs])

    def _postings(self, runs: list[str], wanted: list[str] | None) -> DataFrame:
        """(lexeme, id) of the documents that no later segment replaces; with wanted, of these terms, read from their folders."""
        out = None
        for at, run in enumerate(runs):
            lists = self.spark.read.parquet(f"{self.path}/{run}/lists")
            if wanted is not None:
                # the terms' folders by partition pruning, then the rows
                lists = lists.filter(F.col("b").isin(*self._buckets(wanted)) & F.col("lexeme").isin(*wanted))
            rows = lists.select("lexeme", F.explode("ids").alias("id"))
            if runs[at + 1 :]:
                rows = rows.join(self._ids(runs[at + 1 :]), "id", "left_anti").select("lexeme", "id")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _buckets(self, wanted: list[str]) -> list[int]:
        import zlib

        return sorted({zlib.crc32(w.encode()) % self.buckets for w in wanted})

    def search(self, query: str) -> DataFrame:
        """Ids of the documents that hold every term of the query; a query of stop words finds none."""
        told = self._told()
        if not told["segments"]:
            raise FileNotFoundError(f"{self.path} has no index")
        wanted = list(dict.fromkeys(self.stem_word(w) for w in query_lexemes(query, stem=False)))
        if not wanted:
            return self._ids(told["segments"]).limit(0)
        hits = self._postings(told["segments"], wanted)
        return hits.groupBy("id").agg(F.count_distinct("lexeme").alias("_n")).filter(F.col("_n") == len(wanted)).select("id")

    def merge(self, last: int | None = None) -> int:
        """Join the last segments (all by default) into one, without what was replaced; the new version, or the present one where there is nothing to join."""
        told = self._told()
        runs = told["segments"][-last:] if last else told["segments"]
        if len(runs) < 2:
            return told["version"]
        ids = self._ids(runs).distinct()
        parts = max(1, -(-ids.count() // self.part))
        rows = self._postings(runs, None).groupBy("lexeme", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
        run = self._write(rows.agg(F.array_sort(F.collect_set("id")).alias("ids")), ids, parts)
        return publish(self.spark, self.path, told["version"], {"segments": [*told["segments"][: -len(runs)], run]})
