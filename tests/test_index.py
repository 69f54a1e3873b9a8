"""The maintained text index and the database scan against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from longtext.functions.lexicons import STOP_WORDS
from longtext.functions.udfs import english_stem
from longtext.operators import index as I
from longtext.sources import jdbc

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def found(docs, query):
    stems = lambda t: {english_stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in STOP_WORDS}
    wanted = stems(query)
    return sorted(i for i, t in docs.items() if wanted and wanted <= stems(t))


def test_index_after_appends_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    words = ["running", "runs", "run", "dogs", "dog", "cats", "the", "nations", "national", "x1", "Great", "greatly"]
    text = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 6)))])
    made = I.TextIndex(spark, str(tmp_path / "i"), 4, part=16)
    with pytest.raises(FileNotFoundError):
        made.search("dog")
    docs, queries = {}, ["dogs run", "cat", "the", "", "nation running dog", "great", "absent"]
    for batch in range(4):
        new = {rng.randint(0, 150): text() for _ in range(60)}
        docs |= new
        assert made.append(spark.createDataFrame([*new.items(), (None, "dogs run")], "id long, text string")) == batch + 1
        if batch == 2:
            made.merge(2)
            made = I.TextIndex(spark, str(tmp_path / "i"), 4, part=16)
            spark.read.parquet(f"{made.path}/{made._told()['segments'][-1]}/lists")
            assert len(made._told()["segments"]) == 2
            made.path, kept = str(tmp_path / "j"), made.path  # a rebuild beside it
            made.append(spark.createDataFrame(list(docs.items()), "id long, text string"))
            for q in queries:
                assert sorted(r.id for r in made.search(q).collect()) == found(docs, q), q
            made.path = kept
            break
    for q in queries:
        assert sorted(r.id for r in made.search(q).collect()) == found(docs, q), q
    made.merge()
    assert len(made._told()["segments"]) == 1
    for q in queries:
        assert sorted(r.id for r in made.search(q).collect()) == found(docs, q), q


def test_lists_of_common_terms_are_split_and_searches_read_their_buckets(spark, tmp_path):
    made = I.TextIndex(spark, str(tmp_path / "i"), 8, part=50)
    made.append(spark.range(1000).select("id", F.concat(F.lit("common word"), "id").alias("text")))
    lists = spark.read.parquet(f"{made.path}/{made._told()['segments'][0]}/lists").filter("lexeme = 'common'")
    sizes = [r.n for r in lists.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) < 100
    plan = made.search("common")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*b#\d+", plan)


def test_failed_append_is_not_seen(spark, tmp_path):
    made = I.TextIndex(spark, str(tmp_path / "i"), 2)
    made.append(spark.createDataFrame([(1, "dog")], "id long, text string"))
    with pytest.raises(Exception, match="(?i)broken"):
        made.append(spark.createDataFrame([(2, "dog")], "id long, text string").withColumn("text", F.raise_error(F.lit("broken"))))
    assert [r.id for r in made.search("dogs").collect()] == [1]


def test_database_in_partitions(spark):
    url = "jdbc:derby:memory:longtext;create=true"
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("K"), (F.col("id") * 2).alias("V"), F.concat(F.lit("t"), "id").alias("T"))
    jdbc.save_jdbc(rows, url, "FACTS", "overwrite", driver=DERBY)
    t = jdbc.jdbc_table(spark, url, "FACTS", "K", partitions=5, rows_each=10, driver=DERBY)
    assert t.rdd.getNumPartitions() == 5 and sorted(r.V for r in t.collect()) == [2 * i for i in range(1000)]
    asked = t.filter("V >= 1990").select("V")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(V,1990)" in plan and "ReadSchema: struct<V:bigint>" in plan
    assert sorted(r.V for r in asked.collect()) == [1990, 1992, 1994, 1996, 1998]
    assert jdbc.jdbc_table(spark, url, "FACTS", "K", partitions=5, driver=DERBY).rdd.getNumPartitions() == 1
    assert jdbc.key_bounds(spark, url, "FACTS", "K", DERBY) == (1, 999, 1000)
    assert jdbc.jdbc_table(spark, url, "(SELECT COUNT(*) AS N FROM FACTS WHERE K IS NULL) Q", driver=DERBY).first().N == 100
    jdbc.save_jdbc(rows.limit(3), url, "FACTS", driver=DERBY)
    assert jdbc.jdbc_table(spark, url, "FACTS", driver=DERBY).count() == 1003


def test_search_without_an_index_shuffles_the_words_of_the_query_alone(spark):
    from longtext.operators import search

    rows = [(i, " ".join(f"word{j}ing" for j in range(i % 7, 12)) + " the") for i in range(40)] + [(40, None), (41, "words0ing wordS"), (42, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    for query in ("word3ed", "word1ing WORD5ings", "the", "absent", "words"):
        found = search.stemmed_search(docs, query)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in search.search(search.inverted_index(docs), query).collect()), query
    plan = search.stemmed_search(docs, "word3ed")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_stop_words_are_not_compared_with_every_word(spark):
    from longtext.operators import search

    df = spark.createDataFrame([("The cat and THE dog, cat: 7 dogs 7",), ("the",), ("",), (None,)], "text string")
    made = df.select(search.plain_lexemes(F.col("text")).alias("w"))
    assert [r.w for r in made.collect()] == [["cat", "dog", "7", "dogs"], [], [], []]
    assert "array_except" in made._jdf.queryExecution().toString() and " IN (" not in made._jdf.queryExecution().toString()
