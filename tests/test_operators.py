"""Operators on small fixtures: components, clusters, statistics, tokens, stores, sources, streams."""

import json
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from longtext.operators import annotate, dedupe, report, search, stats
from longtext.operators.components import connected_components
from longtext.plans.queries import save
from longtext.schema import typed, untyped
from longtext.sources import html, store, tables


@pytest.mark.parametrize("most", [0, 250_000])
def test_components(spark, most):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3), (101, 100)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", save, most=most).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", save).count() == 0


def test_clusters(spark):
    rows = [("x", "u9", "t1", 0.5, 5), ("a", "u1", "t2", 0.7, 9), ("b", "u1", "same", 0.9, 10), ("c", "", "Same ", 0.9, 12)]
    df = spark.createDataFrame(rows, "id string, source_url string, text string, quality_score double, word_count int")
    found = {r.id: (r.cluster_id, r.is_canonical) for r in dedupe.clusters(df, dedupe.url_edges(df).union(dedupe.hash_edges(df)), save).collect()}
    assert found["a"][0] == found["b"][0] == found["c"][0] != found["x"][0]
    assert [k for k, v in sorted(found.items()) if v[1]] == ["c", "x"]


def test_near_texts_link_through_any_member(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "band_keys", lambda parts: F.array(F.lit(1)))
    rows = [("a", "a" * 300), ("b", "b" * 24 + "a" * 276), ("c", "b" * 24 + "a" * 252 + "c" * 24)]
    edges = dedupe.text_edges(spark.createDataFrame(rows, "id string, text string"), save).select("a", "b").collect()
    assert {tuple(e) for e in edges} == {("a", "b"), ("b", "c")}


def test_near_texts(spark):
    words = [f"w{i * 7919 % 997}" for i in range(150)]
    near = [*words[:70], "other", *words[71:]]
    rows = [("a", " ".join(words)), ("b", " ".join(near)), ("c", " ".join(reversed(words))), ("d", "short")]
    edges = dedupe.text_edges(spark.createDataFrame(rows, "id string, text string"), save).select("a", "b").collect()
    assert [tuple(r) for r in edges] == [("a", "b")]


def test_trend(spark):
    rows = [("k", i, float(y)) for i, y in enumerate((1, 3, 2, 5, 4))] + [("s", 0, 1.0), ("s", 1, 2.0)]
    found = {r.key: r for r in stats.trend(spark.createDataFrame(rows, "key string, x int, y double"), "key", "x", "y").collect()}
    k = found["k"]
    assert (k.n, round(k.r, 6), round(k.p, 3), round(k.slope, 6), round(k.intercept, 6), k.verdict) == (5, 0.8, 0.104, 0.8, 1.4, "null")
    assert found["s"].r is None and found["s"].verdict == "null"


def test_trim_boundary(spark):
    rows = [("k", v) for v in (0.0, 0.0, 0.0, 0.0, 10.0)]
    assert stats.trimmed(spark.createDataFrame(rows, "k string, v double"), "k", "v").count() == 5


def test_verdict(spark):
    df = spark.createDataFrame([(-0.4, 0.006), (0.4, 0.01), (0.9, 0.05), (0.9, math.nan)], "r double, p double")
    assert [r[0] for r in df.select(stats.verdict(F.col("r"), F.col("p"))).collect()] == ["sig-neg", "sig-pos", "null", "null"]


def test_rolling(spark):
    rows = [("k", i, 1.0 * i) for i in range(10)]
    found = stats.rolling_mean(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v", save=save).orderBy("i").collect()
    assert found[8].rolling is None and found[9].rolling == 4.5


def test_factors(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=(400, 2))
    x = np.column_stack([f[:, 0] + 0.1 * rng.normal(size=400) for _ in range(3)] + [f[:, 1] + 0.1 * rng.normal(size=400) for _ in range(3)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(6)))
    scores, load = stats.factor_scores(df, df.columns, 2)
    groups = [tuple(sorted(c for c, _ in top[:3])) for top in stats.top_loadings(load, df.columns)]
    assert sorted(groups) == [("c0", "c1", "c2"), ("c3", "c4", "c5")]
    got = np.array([(r.f1, r.f2) for r in scores.select("f1", "f2").collect()])
    assert max(abs(np.corrcoef(got[:, 0], f[:, i])[0, 1]) for i in (0, 1)) > 0.95
    assert stats.explained_variance(df, df.columns)[:2].sum() > 0.9


def test_token_features(spark):
    t = [("d", 0, 0, "I", "I", "PRON", "nsubj", 1, "1", "Sing", True), ("d", 0, 1, "saw", "see", "VERB", "ROOT", 1, None, None, True),
         ("d", 0, 2, "her", "she", "PRON", "dobj", 1, "3", "Sing", True), ("d", 0, 3, ".", ".", "PUNCT", "punct", 1, None, None, False)]
    r = annotate.features(spark.createDataFrame(t, annotate.TOKEN_SCHEMA)).first()
    assert (r.mean_dependency_distance, r.mean_tree_depth, r.clauses_per_sentence, r.subordination_ratio) == (1.0, 1.0, 1.0, 0.0)
    assert (round(r.pronoun_ratio, 4), round(r.idea_density, 4), r.i_to_we_ratio) == (0.6667, 0.3333, 1.0)


def test_annotator_hook(spark):
    tokens = annotate.annotate(spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string"), lambda s: [{"sent": 0, "i": i, "text": w, "head": i, "is_alpha": True} for i, w in enumerate(s.split())])
    assert tokens.count() == 2


def test_search(spark):
    docs = spark.createDataFrame([(1, "The running dogs"), (2, "a dog runs"), (3, "cats"), (4, None)], "id long, text string")
    assert sorted(r.id for r in search.search(search.inverted_index(docs), "dogs run").collect()) == [1, 2]
    assert search.search(search.inverted_index(docs), "the").count() == 0
    assert [r.id for r in docs.filter(search.matches(F.col("text"), "the dogs")).collect()] == [1]


def test_report(spark):
    df = spark.createDataFrame([("a", "x", "3"), ("", "x", "n"), (None, "y", "5")], "k string, s string, word_count string")
    assert {r.value: r.n for r in report.value_counts(df, "k").collect()} == {"a": 1, "(blank)": 2}
    assert {(r.facet, r.value): r.n for r in report.facets(df, ["k", "s"]).collect()}[("s", "x")] == 2
    assert [r.asDict() for r in report.matrix(df, "s", "k", ["a"]).orderBy("s").collect()] == [{"s": "x", "a": 1}, {"s": "y", "a": 0}]
    assert "**Total words:** 8" in report.corpus_report(df, ["s"], ["word_count"])


def test_append_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert store.append(rows("a"), path) == 1
    assert store.append(rows("a", "b", "b"), path) == 1
    assert store.append(rows("a", "b"), path) == 0
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b"]
    old, new = spark.createDataFrame([("a", 1, "x")], "id string, v int, s string"), spark.createDataFrame([("a", 1, "y"), ("b", 0, "z")], "id string, v int, s string")
    assert {r.id: r.s for r in store.upsert(old, new, "id", "v").collect()} == {"a": "y", "b": "z"}


def test_schema_round_trip(spark):
    df = untyped(spark.createDataFrame([("i", "2020-01-02", True, 0.5, "extra")], "id string, date string, is_canonical boolean, quality_score double, more string"))
    assert df.columns[0] == "id" and "more" not in df.columns and len(df.columns) == 32
    r = typed(df).first()
    assert (str(r.date), r.is_canonical, r.quality_score, r.title) == ("2020-01-02", True, 0.5, None)


def test_archive_page(spark):
    page = "<html><h1 class='page-title'>Remarks by Obama</h1><time datetime='2012-05-01'>x</time><article><p>One &amp; two<p>Three <b>four</b></article>"
    r = html.documents(spark.createDataFrame([("u", page), ("v", None)], "url string, html string"), "archive_3", least=5).collect()
    assert len(r) == 1 and (r[0].title, str(r[0].date), r[0].speaker, r[0].text) == ("Remarks by Obama", "2012-05-01", "obama", "One & two\n\nThree four")


def test_links(spark):
    rows = [("/documents/remarks-1",), ("/documents/app-categories/x",), ("/people/x",), ("/documents/a-event-timeline",), ("/documents/",)]
    df = spark.createDataFrame(rows, "h string").select(html.is_document(F.col("h")))
    assert [r[0] for r in df.collect()] == [True, False, False, False, False]


def test_people(spark):
    page = '<select><option value="1">George W. Bush</option><option value="2">George Bush</option><option value="3">Donald J. Trump (1st Term)</option><option value="4">Donald J. Trump (2nd Term)</option></select>'
    df = spark.createDataFrame([(page,)], "html string")
    options = df.select(F.explode(html.people(F.col("html"))).alias("x")).select("x.id", "x.name")
    raw = spark.createDataFrame([("1", "George W. Bush"), ("2", "George Bush"), ("3", "Donald J. Trump (1st Term)"), ("4", "Donald J. Trump (2nd Term)")], "id string, name string")
    want = {"bush43": ["1"], "bush41": ["2"], "trump": ["3", "4"]}
    assert {r.speaker: r.ids for r in html.people_ids(raw).collect()} == want
    assert {r.speaker: r.ids for r in html.people_ids(options).collect()} == want
    url = html.results_url("http://x/r", F.lit("200"), F.lit(0), F.to_date(F.lit("1981-01-20")), F.to_date(F.lit("1989-01-20")), 30, (8, 9))
    assert spark.range(1).select(url).first()[0] == "http://x/r?items_per_page=50&person2=200&from%5Bdate%5D=01-20-1981&to%5Bdate%5D=01-20-1989&category2%5B%5D=8&category2%5B%5D=9&page=0"


def test_model_labels(spark):
    from longtext.functions.classify import classify_by_model

    replies = {"a": '{"event_type": "rally", "prepared_or_impromptu": "x", "has_q_and_a": true, "campaign_or_official": "Campaign"}', "b": "no", "c": None}
    df = spark.createDataFrame([(k, "t") for k in (*replies, "d")], "title string, text string")
    found = {r.title: (r.event_type, r.prepared_or_impromptu, r.has_q_and_a, r.campaign_or_official) for r in classify_by_model(df, lambda t, _: replies[t]).collect()}
    assert found["a"] == ("rally", "unknown", True, "campaign")
    assert found["b"] == found["c"] == found["d"] == ("other", "unknown", False, None)


def test_drop_folder(spark, tmp_path):
    body = "word " * 40
    (tmp_path / "rally_20200818_Reagan.txt").write_text(body)
    (tmp_path / "b.html").write_text(f"<html><head><title>t</title></head><body><p>{body}</p></body></html>")
    (tmp_path / "b.json").write_text(json.dumps({"title": "T", "date": "2019-01-02", "president": "obama", "machine_generated": True}))
    (tmp_path / "thin.txt").write_text("x")
    found = {r.title: r for r in tables.drop_folder(spark, str(tmp_path), "rev").collect()}
    assert set(found) == {"rally 20200818 Reagan", "T"}
    a, b = found["rally 20200818 Reagan"], found["T"]
    assert (str(a.date), a.speaker, a.quality_score) == ("2020-08-18", "reagan", 0.7)
    assert (str(b.date), b.speaker, b.quality_score) == ("2019-01-02", "obama", 0.5)


def test_stream_is_incremental(spark, tmp_path):
    from longtext.streaming.ingest import ingest

    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string").write.mode("append").parquet(folder)
    put("a", "b")
    assert ingest(spark, folder, "id string", out, state) == 2
    put("b", "c")
    assert ingest(spark, folder, "id string", out, state) == 1
    assert ingest(spark, folder, "id string", out, state) == 0


def test_pipeline_is_idempotent(spark):
    from longtext.plans import pipeline

    body = "The quick brown fox jumps over the lazy dog. " * 8
    rows = [(f"d{i}", "reagan", "1985-01-01", "Remarks", f"http://{i}", 0.9, body if i < 2 else body + f"Other end {uuid.UUID(int=i)}.") for i in range(4)]
    docs = spark.createDataFrame(rows, "id string, speaker string, date string, title string, source_url string, quality_score double, text string").withColumn("date", F.to_date("date"))
    first, again = (sorted(map(str, pipeline.run(docs).collect())) for _ in range(2))
    assert first == again and len(first) == 4
    assert pipeline.lexical_features(docs).count() == 4


@pytest.mark.parametrize("name", ["orders"])
def test_filters_reach_the_scan(spark, name):
    df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").filter("o_orderkey = 7").select("o_totalprice")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "o_comment" not in plan
