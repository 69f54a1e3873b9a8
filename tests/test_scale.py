"""Operators whose groups may be of any size, against plain Python: places and windows, smoothing, titles, serving tables in versions."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longtext.functions.udfs import token_set
from longtext.operators import ranges, smooth, stats, titles
from longtext.plans.queries import save
from longtext.sources import serving, store, versions
from longtext.sources.versions import VersionedTable

SF = "/root/testdata/sf0.001"


def test_places_and_rolling_means_of_one_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["cold", None]), rng.randint(0, 300), i, rng.choice([None, rng.random(), rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v double").repartition(7)
    placed = ranges.placed(df, "k", ["t", "i"], save)
    want = pd.DataFrame(rows, columns=["k", "t", "i", "v"]).sort_values(["t", "i"])
    want["k"] = want["k"].astype(object).where(want["k"].notna(), None)
    groups = {k: g for k, g in want.groupby("k", dropna=False)}
    groups = {None if k is None or k != k else k: g for k, g in groups.items()}
    got = {r.i: (r.idx, r["_n"]) for r in placed.collect()}
    for g in groups.values():
        assert [got[i] for i in g.i] == [(p, len(g)) for p in range(len(g))]
    for block in (1, 7, 64, 100_000):
        rolled = {r.i: r.rolling for r in ranges.rolling_mean(placed, "k", "v", 50, 10, block).collect()}
        for g in groups.values():
            expected = g.v.rolling(50, min_periods=10).mean()
            assert np.allclose([np.nan if rolled[i] is None else rolled[i] for i in g.i], expected, equal_nan=True)
    largest = ranges.blocks(placed, 49, 0, 64).groupBy("k", "_block").count().agg(F.max("count")).first()[0]
    assert largest == 64 + 49


def test_medians_by_aggregate_and_by_ranges(spark):
    rows = [("a", float(i % 17)) for i in range(101)] + [("b", 3.0), ("b", 4.0), (None, 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {"a": float(np.median([i % 17 for i in range(101)])), "b": 3.5, None: 1.0}
    for most in (1000, 10):
        assert {r.k: r["median"] for r in ranges.medians(df, "k", "v", save, most).collect()} == want


def plain_lowess(x, y, near, robust):
    """Every window from all distances, point by point."""
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    x, y = [x[i] for i in order], [y[i] for i in order]
    n, trust = len(x), [1.0] * len(x)
    near = max(1, min(n, max(2, near)))
    for turn in range(robust + 1):
        fit = []
        for i in range(n):
            start = min(range(max(0, i - near + 1), min(i, n - near) + 1), key=lambda s: (max(x[i] - x[s], x[s + near - 1] - x[i]), s))
            h = max(x[i] - x[start], x[start + near - 1] - x[i], 1e-12)
            w = [max(0.0, 1 - (abs(x[j] - x[i]) / h) ** 3) ** 3 * trust[j] for j in range(start, start + near)]
            if sum(w) <= 0:
                w = [1.0] * near
            line = np.average([x[j] for j in range(start, start + near)], weights=w), np.average([y[j] for j in range(start, start + near)], weights=w)
            spread = sum(v * (x[j] - line[0]) ** 2 for v, j in zip(w, range(start, start + near), strict=True))
            slope = sum(v * (x[j] - line[0]) * (y[j] - line[1]) for v, j in zip(w, range(start, start + near), strict=True)) / spread if spread > 1e-12 else 0.0
            fit.append(line[1] + slope * (x[i] - line[0]))
        off = [abs(a - b) for a, b in zip(y, fit, strict=True)]
        scale = float(np.median(off))
        if scale > 1e-12:
            trust = [max(0.0, 1 - (o / (6 * scale)) ** 2) ** 2 for o in off]
    return list(zip(x, y, fit, strict=True))


@pytest.mark.parametrize(("share", "near", "most"), [(0.7, None, 1_000_000), (0.3, 12, 20)])
def test_smoothing_over_blocks(spark, monkeypatch, share, near, most):
    monkeypatch.setattr(smooth, "LEAST_BLOCK", 16)
    rng = random.Random(4)
    series = {"line": [(float(i), 2.0 * i + 1) for i in range(30)], "noise": [(rng.random() * 10, rng.gauss(0, 1)) for _ in range(150)], "one": [(1.0, 5.0)], "two": [(1.0, 5.0), (2.0, 6.0)]}
    series["spike"] = [(float(i), float(i) + (80 if i == 20 else 0)) for i in range(60)]
    rows = [(k, x, y) for k, points in series.items() for x, y in points] + [("noise", None, 1.0), ("noise", 1.0, None)]
    got = smooth.smoothed(spark.createDataFrame(rows, "k string, a double, b double"), "k", "a", "b", save, share, near, most=most).collect()
    for k, points in series.items():
        n = near or int(share * len(points) + 1e-10)
        want = plain_lowess([x for x, _ in points], [y for _, y in points], n, 3)
        found = sorted((r.x, r.y, r.smooth) for r in got if r.k == k)
        assert np.allclose(found, want, atol=1e-7), k
    spike = {r.x: r.smooth for r in got if r.k == "spike"}
    assert near or abs(spike[20.0] - 20) < 2


def test_wide_moments(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) + 1000
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, *[0.0] * 19)], ", ".join(f"c{i} double" for i in range(20))).repartition(5)
    n, means, cov = stats.moments(df, df.columns)
    assert n == 300 and np.allclose(means, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    shares = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    assert np.allclose(stats.explained_variance(df, df.columns), shares / shares.sum())


def test_variance_of_all_dimensions(spark):
    from longtext.plans import queries

    x = np.array(pd.read_parquet(f"{SF}/embeddings.parquet").embedding.tolist(), float)
    values = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    got = [r.share for r in queries.pca_variance(spark, SF).orderBy("component").collect()]
    assert len(got) == x.shape[1] and np.allclose(got, values / values.sum())


def title_list(seed, n):
    rng = random.Random(seed)
    words = ["Remarks", "at", "a", "the", "of", "Campaign", "Rally", "in", "Ohio", "Meeting", "With", "Prime", "Minister", "é", "Press", "Interview", "x", "Statement", "on", "Signing"]
    out = [None, "", "  ", "a", "a", "b a", "a  b", "Ohio", "Ohia"]
    while len(out) < n:
        if rng.random() < 0.5 and len(out) > 12:
            t = list(rng.choice(out[7:]))
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "s", "q", " "])
            out.append("".join(t))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randint(1, 8))))
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 90.0), (2, 80.0), (3, 97.0)])
def test_titles_lose_no_pair(spark, seed, least):
    made = title_list(seed, 150)
    rows = [(i, "s" if i % 3 else None, "2000-01-01" if i % 4 else "2000-01-02", t) for i, t in enumerate(made)] + [(900, "s", None, "a"), (901, "s", None, "a")]
    df = spark.createDataFrame(rows, "id long, speaker string, date string, title string")
    edges = {(r.a, r.b) for r in titles.title_edges(df, save, least=least).collect()}
    want, links = set(), {i: i for i, *_ in rows}
    for (i, s, d, t), (j, s2, d2, u) in itertools.combinations(rows, 2):
        if d is not None and (s, d) == (s2, d2) and token_set(t, u) >= least:
            want.add((i, j))

    def root(parent, i):
        while parent[i] != i:
            i = parent[i]
        return i

    def closed(pairs):
        parent = dict(links)
        for a, b in pairs:
            a, b = root(parent, a), root(parent, b)
            parent[max(a, b)] = min(a, b)
        return {i: root(parent, i) for i in parent}

    assert edges <= want and closed(edges) == closed(want)
    first = {}
    for i, s, d, t in rows:
        if t and t.split() and d is not None:
            first.setdefault((s, d, tuple(sorted(set(t.split())))), i)
    heads = set(first.values())
    assert {(a, b) for a, b in want if a in heads and b in heads} <= edges


def test_titles_are_compared_rarely(spark):
    df = spark.createDataFrame([(i, "s", "2000-01-01", f"Remarks at a Rally in {w}") for i, w in enumerate(f"{a}{b}{c}ville" for a in "BCDFGHKLMN" for b in "aeiou" for c in "bdfgklmnrt")], "id long, speaker string, date string, title string")
    sets = save(titles.title_sets(df, "id", ("speaker", "date"), "title").groupBy("_g", "tokens").agg(F.min("i").alias("i")).withColumn("n", F.length(F.array_join("tokens", " "))), "t")
    pairs, compared = titles.like_titles(sets, save, 95.0)
    assert compared.count() < 0.2 * 500 * 499 / 2
    with pytest.raises(ValueError, match="75"):
        titles.like_titles(sets, save, 60.0)


def test_titles_of_other_letters_part_as_they_meet(spark):
    """Titles with common pieces of words but other letters are no candidates by pieces: such pairs are not shuffled or stored."""
    rows = [("g", i, f"rema{a * 6} ks{b * 6} inn{c * 6}".split()) for i, (a, b, c) in enumerate((a, b, c) for a in "bcdfg" for b in "hjklm" for c in "pqtvw")]
    sets = spark.createDataFrame(rows, "_g string, i long, tokens array<string>").withColumn("n", F.length(F.array_join("tokens", " ")))
    told = sets.withColumns(dict(zip(titles.MARKS, titles.tally(F.array_join("tokens", " ")), strict=True)))
    assert titles.shared_pieces(told, 90.0).count() == 0


def test_query_of_titles_yields_pairs(spark):
    from longtext.plans import queries

    d = pd.read_parquet(f"{SF}/documents.parquet")
    heads, want = {}, set()
    for i, lang, t in sorted(zip(d.doc_id, d.lang, d.text.str[:48], strict=True)):
        if t.split():
            heads.setdefault((lang, tuple(sorted(set(t.split())))), []).append((i, t))
    for group in heads.values():
        want |= {(group[0][0], i) for i, _ in group[1:]}
    for (g, v), (h, w) in itertools.combinations(heads.items(), 2):
        if g[0] == h[0] and token_set(v[0][1], w[0][1]) >= 90:
            want.add(tuple(sorted((v[0][0], w[0][0]))))
    got = {(r.a, r.b) for r in queries.dedupe_titles(spark, SF).collect()}
    assert got == want and len(got) > 5


def table_rows(table, version=None):
    return {r.id: r.asDict() for r in table.read(version).collect()}


def test_upserts_by_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ("id",), 8)
    make = lambda rows, schema="id string, v int, s string": spark.createDataFrame(rows, schema)
    assert not table.exists()
    assert table.upsert(make([(str(i), i, "a") for i in range(40)] + [(None, 1, "x"), ("", 2, "x")])) == 1
    state = {str(i): {"id": str(i), "v": i, "s": "a"} for i in range(40)}
    assert table_rows(table) == state
    before = versions.record(spark, table.path)["parts"]
    assert table.upsert(make([("7", 1, "b"), ("7", 9, "c"), ("99", 5, None)]), order=("v",)) == 2
    after = versions.record(spark, table.path)["parts"]
    assert {b for b in after if after[b] != before.get(b)} <= {str(r[0]) for r in make([("7", 0, ""), ("99", 0, "")]).select(table._bucket(8)).collect()}
    assert sum(after[b] == before.get(b) for b in after) >= 6
    state |= {"7": {"id": "7", "v": 9, "s": "c"}, "99": {"id": "99", "v": 5, "s": None}}
    assert table_rows(table) == state
    assert table.upsert(make([("7", 100, "z"), ("100", 3, "n")]), columns=("s",)) == 3
    state |= {"7": {"id": "7", "v": 9, "s": "z"}, "100": {"id": "100", "v": 3, "s": "n"}}
    assert table_rows(table) == state and table_rows(table, 2)["7"]["s"] == "c"
    table.upsert(make([("1", 2.5)], "id string, w double"))
    assert table_rows(table)["1"] == {"id": "1", "v": 1, "s": "a", "w": 2.5} and table_rows(table)["2"]["w"] is None
    table.delete(make([("1",), ("nobody",)], "id string"))
    assert set(table_rows(table)) == set(state) - {"1"}
    table.upsert(make([]))
    assert len(table_rows(table)) == len(state) - 1
    gone = table.clean(keep=1)
    assert gone and len(table_rows(table)) == len(state) - 1 and versions.versions(spark, table.path) == [6]


def test_a_merge_that_dies_or_comes_second_changes_nothing(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), ("id",), 4)
    make = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "id string, v int")
    table.upsert(make("a", "b"))
    with pytest.raises(Exception, match="(?i)fail"):
        table.upsert(make("a", "c").withColumn("v", F.raise_error(F.lit("fail")).cast("int")))
    assert set(table_rows(table)) == {"a", "b"}
    with monkeypatch.context() as m:
        m.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            table.upsert(make("a", "c"))
    assert set(table_rows(table)) == {"a", "b"} and table.clean() != []
    with pytest.raises(versions.Conflict):
        versions.publish(spark, table.path, 0, {"parts": {}})
    assert set(table_rows(table)) == {"a", "b"}
    table.upsert(make("c"))
    assert set(table_rows(table)) == {"a", "b", "c"}


def test_serving_load_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("a", "reagan", "1985-01-01", "T", "body"), ("b", "nobody", None, "", ""), (" ", "obama", None, "x", "y")], "id string, speaker string, date string, title string, text string").withColumn("date", F.to_date("date"))
    feats = spark.createDataFrame([("a", 3, 0.5), ("gone", 1, 0.1)], "id string, n_words int, mtld double")
    first = serving.load(spark, str(tmp_path), docs, feats, 2)
    assert first == {"presidents": 7, "speeches": 2, "linguistic_features": 1} == serving.load(spark, str(tmp_path), docs, feats, 2)
    found = serving.tables(spark, str(tmp_path), 2)
    rows = {r.id: r for r in found["speeches"].read().collect()}
    assert (rows["a"].president_id, rows["a"].full_text, rows["b"].president_id, rows["b"].title) == (1, "body", None, None)
    r = found["linguistic_features"].read().first()
    assert (r.speech_id, r.n_words, r.features) == ("a", 3, '{"id":"a","n_words":3,"mtld":0.5}')
    serving.remove(spark, str(tmp_path), docs.filter("id = 'a'").select("id"), 2)
    assert found["linguistic_features"].read().count() == 0 and found["speeches"].read().count() == 1


def test_metadata_in_versions(spark, tmp_path):
    df = lambda t: spark.createDataFrame([("i", t)], "id string, title string")
    with pytest.raises(FileNotFoundError):
        store.metadata_folder(spark, str(tmp_path))
    for n, t in enumerate(('a "q", b', "new")):
        assert store.save_metadata(df(t), str(tmp_path)) == n + 1
        where = store.metadata_folder(spark, str(tmp_path))
        assert spark.read.parquet(f"{where}/parquet").first().title == t
        assert spark.read.option("header", True).option("escape", '"').csv(f"{where}/csv").first().title == t


def test_tree_depths(spark):
    from longtext.operators import annotate

    rng = random.Random(5)
    sentences = [[(0, 0)], [(i, i - 1 if i else 0) for i in range(150)], [(i, 0) for i in range(9)], [(3, 4), (4, 3)], [(5, None), (6, 5), (9, 6)]]
    sentences += [[(i, rng.randrange(n)) for i in range(n)] for n in (2, 5, 9, 40)]
    rows = [(k, [{"i": i, "head": h} for i, h in rng.sample(s, len(s))]) for k, s in enumerate(sentences)]
    df = spark.createDataFrame(rows, "k int, t array<struct<i:int,head:int>>")
    got = {r.k: r.d for r in df.select("k", annotate.tree_depth(F.col("t"), 100).alias("d")).collect()}
    for k, s in enumerate(sentences):
        heads, most = dict(s), 0
        for i in heads:
            at, d = i, 0
            while d < min(100, len(s)) and heads[at] is not None and heads[at] in heads and heads[at] != at:
                at, d = heads[at], d + 1
            most = max(most, d)
        assert got[k] == most, k


def test_stored_components_equal_a_full_run_after_every_batch(spark, tmp_path):
    from longtext.operators.clusters import StoredComponents

    rng = random.Random(6)
    stored, parent = StoredComponents(spark, str(tmp_path / "c"), save, 16), {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    batches = [[(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(n)] for n in (120, 60, 3)] + [[(401, 401), (None, 2)], [(0, 1), (1, 2), (2, 3)]]
    for batch in batches:
        told = stored.add(spark.createDataFrame(batch, "a long, b long"))
        before = {i: root(i) for i in parent}
        for a, b in batch:
            if a is not None and b is not None:
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        now = {i: root(i) for i in parent}
        assert {r.node: r.component for r in stored.labels().collect()} == now
        assert {(r.node, r.component) for r in stored._members.read().collect()} == set(now.items())
        assert told["changed"] == sum(before.get(i) != c for i, c in now.items())
        if len(batch) < 4:
            assert told["labels_read"] <= 6
    again = stored.add(spark.createDataFrame(batches[0], "a long, b long"))
    assert again["changed"] == 0 and again["members_read"] == 0
