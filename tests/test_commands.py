"""Every command of the line, end to end on a small corpus."""

import json

import pytest

from longtext.plans import pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    said = lambda i: "\n\n".join(["Q. What of it?", "THE PRESIDENT. " + " ".join(["Well", "we", "do", "things", f"word{i}", "and", "go", *[f"x{chr(97 + (i * k) % 26)}" for k in range(40)]]) + ".", "Q. And then?", "THE PRESIDENT. So it goes."])
    rows = [(f"r{i:02}", "reagan" if i < 12 else "obama", "s1" if i % 2 else "s2", f"19{81 + i % 8}-0{1 + i % 9}-11", "The President's News Conference", f"http://x/{i}", 0.5, said(i)) for i in range(20)]
    rows += [("t1", "obama", "s1", "2010-01-01", "Remarks on Trade in Ohio", "http://y/1", 0.9, "Plain text of remarks. " * 20), ("t2", "obama", "s2", "2010-01-01", "Remarks on Trade at Ohio", "http://y/2", 0.7, "Other words entirely, said elsewhere. " * 9)]
    path = str(tmp_path_factory.mktemp("corpus") / "docs")
    df = spark.createDataFrame(rows, "id string, speaker string, source string, date string, title string, source_url string, quality_score double, text string")
    df.selectExpr("id", "speaker", "source", "cast(date as date) AS date", "year(cast(date as date)) AS year", "title", "source_url", "quality_score", "text").write.parquet(path)
    return path


def call(*words):
    assert pipeline.main(list(map(str, words))) == 0


def test_stages(spark, corpus, tmp_path):
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    for name in ("normalize", "dedupe", "classify", "metrics"):
        call(name, "--input", corpus, "--output", tmp_path)
    assert read("normalized").filter("ws_word_count > 0").count() == 22
    clusters = {r.id: r.cluster_id for r in read("clusters").collect()}
    assert len(clusters) == 22 and clusters["t1"] == clusters["t2"]
    assert {r.event_type for r in read("classified").filter("id like 'r%'").collect()} == {"press_conference"} or read("classified").filter("has_q_and_a").count() == 20
    assert read("metrics").filter("word_count > 40 and question_count is not null").count() == 22
    call("dedupe", "--input", corpus, "--output", tmp_path, "--no-fuzzy")
    assert read("clusters").select("cluster_id").distinct().count() == 22
    call("classify", "--input", f"{tmp_path}/classified", "--output", tmp_path / "again", "--only-missing", "--sources", "s1")
    assert spark.read.parquet(f"{tmp_path}/again/classified").count() == 11
    call("metrics", "--input", f"{tmp_path}/metrics", "--output", tmp_path / "again", "--only-missing")
    assert spark.read.parquet(f"{tmp_path}/again/metrics").count() == 0


def test_features_load_and_factors(spark, corpus, tmp_path, capsys):
    call("features", "--input", corpus, "--output", tmp_path, "--speakers", "obama")
    assert spark.read.parquet(f"{tmp_path}/features").count() == 10
    call("features", "--input", corpus, "--output", tmp_path, "--only-missing")
    features = spark.read.parquet(f"{tmp_path}/features")
    assert features.count() == features.select("id").distinct().count() == 22
    for _ in range(2):
        call("load", "--input", corpus, "--features-input", f"{tmp_path}/features", "--output", tmp_path / "db")
        assert "{'presidents': 7, 'speeches': 22, 'linguistic_features': 22}" in capsys.readouterr().out
    row = pipeline.serving.tables(spark, str(tmp_path / "db"))["linguistic_features"].read().filter("speech_id = 't1'").first()
    assert json.loads(row.features)["n_words"] == row.n_words == 80
    call("factors", "--input", f"{tmp_path}/features", "--output", tmp_path, "--factors", 1, "--columns", "type_token_ratio", "mattr_50", "hapax_ratio")
    assert "factor 1:" in capsys.readouterr().out and "f1" in spark.read.parquet(f"{tmp_path}/scores").columns


def test_study_and_figures(spark, corpus, tmp_path, capsys):
    call("replicate", "--input", corpus, "--max-words", 30)
    out = capsys.readouterr().out
    assert all(f in out for f in pipeline.STUDY_SERIES)
    found = {(r.speaker, r.feature): r for r in pipeline.replicate(spark.read.parquet(corpus), 30).collect()}
    assert found["reagan", "unique_words"].published_r == -0.446 and found["reagan", "unique_words"].n + found["reagan", "unique_words"].dropped == 12
    call("figures", "--input", corpus, "--output", tmp_path, "--max-words", 30)
    points, ends, overlay = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("points", "ends", "overlay"))
    assert {(r.speaker, r.feature) for r in overlay.collect()} == {(s, f) for s in ("reagan", "obama") for f in pipeline.STUDY_SERIES}
    n = found["reagan", "unique_words"].n
    mine = points.filter("speaker = 'reagan' and feature = 'unique_words'").collect()
    assert len(mine) == n and max(p.progress for p in mine) == 1.0
    two = sorted(ends.filter("speaker = 'reagan' and feature = 'unique_words'").collect(), key=lambda r: r.x)
    assert len(two) == 2 and abs((two[1].y - two[0].y) / (two[1].x - two[0].x) - found["reagan", "unique_words"].slope) < 1e-9


def test_run_and_report(spark, corpus, tmp_path, capsys):
    call("run", "--input", corpus, "--output", tmp_path, "--features", "--limit", 5)
    call("run", "--input", corpus, "--output", tmp_path, "--features", "--only-missing", "--no-fuzzy")
    assert spark.read.parquet(f"{tmp_path}/transcripts").count() == spark.read.parquet(f"{tmp_path}/features").count() == 22
    call("report", "--input", f"{tmp_path}/transcripts")
    assert "**Total transcripts:** 22" in capsys.readouterr().out
