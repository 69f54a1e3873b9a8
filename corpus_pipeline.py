"""A corpus pipeline of five operators: documents in, packed token sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longtext.llm.common import stage_table, table
from longtext.llm.jaccard_join import one_of_each
from longtext.llm.mixing import mixed_documents
from longtext.llm.packing import pack_documents
from longtext.llm.pii import sanitise
from longtext.llm.quality_rules import clean_documents

#: Documents are near duplicates when so many percent of their runs of so many words are shared.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their host's boilerplate lines. Nulls, ties, empty tables: see clean_documents()."""
    return clean_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Null and repeated ids, empty texts: see one_of_each()."""
    return one_of_each(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data and revealing terms taken out of the text. Edge cases: see sanitise()."""
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null and repeated ids, empty sources: see mixed_documents()."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences. Edge cases: see pack_documents()."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: Token ids come from a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
