"""Queries that SQL cannot express, against plain Python over whole tables."""

import itertools
import re

import numpy as np
import pandas as pd
import pytest

from longtext.functions import udfs as U
from longtext.functions.lexicons import STOP_WORDS
from longtext.operators import stats
from longtext.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text


def test_stemmed_types(spark, documents):
    got = {r.id: r.unique_words for r in Q.stemmed_types(spark, SF).collect()}
    for i, t in documents.items():
        words = re.findall(r"[A-Za-z']+", t.lower())[:1400]
        assert got.get(i, 0) == len({U.lancaster(w) for w in words}), i


def test_stemmed_search(spark, documents):
    stems = {i: {U.english_stem(w) for w in re.findall("[a-z0-9]+", t.lower()) if w not in STOP_WORDS} for i, t in documents.items()}
    wanted = {U.english_stem(w) for w in ("tionings", "ereding")}
    assert {r.id for r in Q.fts_stemmed(spark, SF).collect()} == {i for i, s in stems.items() if wanted <= s}


def test_factor_scores(spark):
    d = pd.read_parquet(f"{SF}/lineitem.parquet")
    x = d[Q.FEATURES].to_numpy(float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    load, noise = stats.factor_loadings(np.corrcoef(x.T), 2)
    model = load @ load.T + np.diag(noise)
    assert np.allclose(np.diag(model), 1, atol=1e-3)
    scores = z @ np.linalg.solve(model, load)
    want = pd.DataFrame(scores, columns=["f1", "f2"]).groupby(d.l_returnflag).mean()
    for r in Q.factor_scores(spark, SF).collect():
        assert np.allclose([r.f1, r.f2], want.loc[r.l_returnflag], atol=1e-4)


def test_near_duplicates_find_nine_tenths_of_like_pairs(spark, documents):
    cluster = {r.id: r.cluster_id for r in Q.dedupe_near(spark, SF).collect()}
    heads = {}
    for r in Q.dedupe_near(spark, SF).filter("is_canonical").collect():
        assert heads.setdefault(r.cluster_id, r.id) == r.id
    assert set(heads) == set(cluster.values())
    sets = {}
    for i, t in documents.items():
        w = re.findall(r"\w+", t.lower())
        if len(t) >= 200 and len(w) >= 5:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    like = [(i, j) for i, j in itertools.combinations(sets, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and U.indel(documents[i][:5000], documents[j][:5000]) >= 85]
    assert len(like) > 5 and sum(cluster[i] == cluster[j] for i, j in like) >= 0.9 * len(like)
    for i, j in itertools.combinations(sets, 2):
        if cluster[i] == cluster[j]:
            assert sets[i] & sets[j], "texts of a cluster share shingles"


def test_sentiment_of_every_text(spark, documents):
    lexicon = {"trash": -2.0, "pathetic": -2.4, "idiot": -2.3, "worthless": -1.9, "disgusting": -2.4, "stupid": -2.4, "loser": -2.4}
    rows = {r.id: r for r in Q.sentiment(spark, SF).collect()}
    assert set(rows) == set(documents.index)
    for i, t in documents.items():
        heard = any(w.strip(".,!?;:\"'()").lower() in lexicon for w in t[:20000].split())
        assert (rows[i].compound < 0) == heard or not heard and rows[i].compound == 0, i
        assert abs(rows[i].pos + rows[i].neg + rows[i].neu - (1 if t[:20000].split() else 0)) < 1e-9


def test_word_tables(spark):
    from pyspark.sql import functions as F

    from longtext.operators import words

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"w{i}") for i in range(300)], "id long, word string")
    table = spark.createDataFrame([("hot", 1), ("w0", 2), ("w3", 3), ("other", 4)], "word string, v int")
    want = sorted((i, {"hot": 1, "w0": 2, "w3": 3}.get("hot" if i % 3 else f"w{i}")) for i in range(300))
    for small, frequent in ((10, 10), (0, 10), (0, 1)):
        assert sorted((r.id, r.v) for r in words.met(rows, table, small=small, frequent=frequent).collect()) == want
    docs = spark.createDataFrame([("a", "The cat sat. " * 8), ("b", None), ("c", "few words")], "id string, text string")
    known = spark.createDataFrame([("CAT", 5), ("cat", 4), ("sat", 2)], "word string, syllables int")
    found = {r.id: r for r in words.dictionary_readability(docs, known).collect()}
    assert (found["a"].words, found["a"].sentences, found["a"].syllables, found["a"].known) == (24, 8, 8 * 7, 16)
    assert found["b"].ease is None and found["c"].ease is None and found["b"].words == 0
    assert abs(found["a"].ease - (206.835 - 1.015 * 3 - 84.6 * 56 / 24)) < 1e-9
    assert words.valences(spark.createDataFrame([("good", 1.9), (None, 1.0)], "token string, valence double")) == {"good": 1.9}
    with pytest.raises(ValueError, match="2"):
        words.valences(spark.range(5).select(F.col("id").cast("string").alias("token"), F.lit(1.0).alias("valence")), 2)


def test_functions_in_sql(spark):
    tag = lambda text: [{"sent": 0, "i": i, "text": w, "lemma": w, "pos": "NOUN", "dep": "dep", "head": i, "is_alpha": w.isalpha()} for i, w in enumerate(text.split())]
    U.register(spark, {"good": 1.9}, tag)
    spark.createDataFrame([(1, "so good"), (2, None)], "id int, text string").createOrReplaceTempView("said")
    rows = spark.sql("SELECT s.id, t.i, t.text, t.pos FROM said AS s, LATERAL annotate(s.text) AS t ORDER BY t.i").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "so", "NOUN"), (1, 1, "good", "NOUN")]
    assert spark.sql("SELECT vader(text).compound AS c FROM said WHERE id = 1").first().c > 0.4


def test_indicators(spark):
    from longtext.operators import annotate, words

    docs = spark.createDataFrame([("a", "Things go WELL, things well so going " * 3), ("b", "short"), ("c", None)], "id string, text string")
    tag = lambda d: annotate.annotate(d, lambda s: [{"sent": 0, "i": i, "text": w, "pos": "VERB" if w.startswith("go") else "NOUN", "is_alpha": True} for i, w in enumerate(s.split())])
    rows = words.indicators(docs, tag, most=10).collect()
    assert [(r.id, r.unique_words, r.ns_fill, round(r.idea, 6)) for r in rows] == [("a", len({U.lancaster(w) for w in "things go well so going".split()}), 3 + 3 + 1, 0.3)]
