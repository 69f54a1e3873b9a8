"""Merkle manifest, benchmark decontamination and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from longtext.llm import decontamination, importance, manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(nodes, fanout):
    """(root, path of each leaf as siblings left and right) by levels."""
    paths, spot, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(spot):
            run = level[i // fanout * fanout : i // fanout * fanout + fanout]
            paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        spot = [i // fanout for i in spot]
    return (level[0] if level else None), paths


def whole_tree(rows, fanout):
    """{(doc_id, leaf): [(subroot, root, path)]}."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf(r)))
    langs = sorted(groups, key=lambda x: b"" if x is None else b"=" + x.encode())
    made = {g: (sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for g in langs}
    subs = {g: tree([h for _, h in made[g]], fanout) for g in langs}
    root, up = tree([subs[g][0] for g in langs], fanout)
    found = {}
    for g, over in zip(langs, up, strict=True):
        for who, path in zip(made[g], subs[g][1], strict=True):
            found.setdefault(who, []).append((subs[g][0], root, tuple(path + over)))
    return found


def fold(path, h):
    for left, right in path:
        h = sha(left + h + right)
    return h


def manifest_rows(seed, n, langs):
    rng = random.Random(seed)
    rows = [{"doc_id": rng.choice([None, i, i, i, i, i % 7]), "text": rng.choice([None, "", "Aé " * rng.randint(0, 5), f"Text {i}", "same"]), "lang": rng.choice(langs), "source": rng.choice([None, "s", "Ü"]), "n_chars": rng.choice([None, 3, -1])} for i in range(n)]
    rows += [dict(r) for r in rows[: n // 5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "langs", "fanout"), [(1, 300, [None, "en", "de", "ﬁ", "😀"], 8), (2, 1, ["en"], 8), (3, 64, ["en"], 8), (4, 90, [None, *"abcdefghijkl"], 3), (5, 12, [None, "", "x"], 2)])
def test_manifest(spark, seed, n, langs, fanout):
    rows = manifest_rows(seed, n, langs)
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS).repartition(5)
    got = {}
    for r in manifest.document_proofs(docs, now={"text": F.translate("text", "ABT", "abt")}, fanout=fanout).collect():
        got.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, tuple((x.l, x.r) for x in r.path)))
        assert fold([(x.l, x.r) for x in r.path], r.leaf) == r.root
    key = lambda d: {k: sorted(v) for k, v in d.items()}
    assert key(got) == key(whole_tree(rows, fanout))


def test_manifest_query_tells_tampering(spark, tmp_path):
    rows = manifest_rows(7, 200, ["en", None])
    spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    seen = 0
    for r in manifest.op11_merkle_manifest(spark, str(tmp_path)).collect():
        same = [x for x in rows if x["doc_id"] == r.doc_id and leaf(x) == r.leaf]
        chosen = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        changed = chosen and same[0]["text"] is not None and same[0]["text"].translate(ASCII) != same[0]["text"]
        assert r.verified == (r.folded_root == r.root) == (not changed)
        seen += changed
    assert seen > 10


def test_mountains_of_any_stretches():
    rng = random.Random(0)
    for n, fanout in [(1, 8), (8, 8), (9, 8), (64, 8), (517, 8), (40, 3)]:
        leaves = [sha(str(i)) for i in range(n)]
        runs, left = {}, {}

        def emit(level, at, is_run, h):
            (runs if is_run else left)[level, at] = h

        cuts = sorted({0, n, *rng.sample(range(n), min(n, 6))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = manifest.Mountains(fanout, emit)
            for i in range(a, b):
                m.push(i, leaves[i])
            m.flush()
        nodes = {(0, i): h for i, h in enumerate(leaves)}
        for (level, at), kids in sorted(runs.items()):
            assert kids == "".join(nodes[level, at * fanout + i] for i in range(fanout))
            nodes[level + 1, at] = sha(kids)
        assert all(nodes[k] == h for k, h in left.items())
        covered = sum(fanout ** level for level, _ in left)
        assert covered == n


def test_manifest_of_nothing_and_other_columns(spark):
    assert manifest.document_proofs(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "t" * 300_000, "en", "s", 1, "x", 2)], DOCS + ", g string, idx long")
    r = manifest.document_proofs(df).collect()[0]
    assert r.leaf == r.subroot == r.root == leaf({"doc_id": 1, "text": "t" * 300_000, "lang": "en", "source": "s", "n_chars": 1}) and r.path == []


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
words = lambda t: WORDS.findall((t or "").translate(ASCII))


def hits(text, bench, size):
    """(covered word numbers, item ids) by comparing every window with every place."""
    w, cover, who = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        k = min(size, len(b))
        for j in range(len(b) - k + 1) if b else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == b[j : j + k]:
                    cover.update(range(i, i + k))
                    who.add(item)
    return cover, who - {None}


def leaky_texts(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "É", "9", "x", "É9"]
    bench = [(i if i % 9 else None, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 4, 6, 15])))) for i in range(1, 25)] + [(1, "zz yy"), (30, None), (31, " .,! "), (32, "İ ſ"), (33, "K a")]
    texts = [None, "", " ", "Zz--YY", "i̇ ſ", "K A", "k A"]
    for _ in range(60):
        t = rng.choices([*vocabulary, "q"], k=rng.randint(0, 40))
        if rng.random() < 0.5:
            t[rng.randint(0, len(t)) :] = [rng.choice(bench)[1] or ""]
        texts.append(rng.choice([" ", ", ", "\n"]).join(t).upper() if rng.random() < 0.3 else " ".join(t))
    return texts, bench


@pytest.mark.parametrize(("seed", "size", "most"), [(1, 4, 400_000), (2, 10, 400_000), (3, 3, 7)])
def test_decontamination(spark, seed, size, most):
    texts, bench = leaky_texts(seed)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, items long")
    items = spark.createDataFrame(bench, "item_id long, text string")
    for r in decontamination.contaminations(docs, items, size, most=most).collect():
        cover, who = hits(texts[r["_in"].doc_id], bench, size)
        assert {i for x in r.spans for i in range(x.s, x.e)} == cover and sorted(r["items"]) == sorted(map(str, who))
        assert r.n_words == len(words(texts[r["_in"].doc_id])) and all(a.e < b.s for a, b in zip(r.spans, r.spans[1:], strict=False))
    left = {r.doc_id: r for r in decontamination.decontaminate(docs, items, size=size, most_share=1.0, most=most).collect()}
    for i, t in enumerate(texts):
        cover, _ = hits(t, bench, size)
        assert words(left[i].text) == [w for k, w in enumerate(words(t)) if k not in cover] and (left[i].spans, left[i]["items"]) == ("clash", 1)
        assert cover or left[i].text == t
    kept = {r.doc_id for r in decontamination.decontaminate(docs, items, "documents", size, most=most).collect()}
    assert kept == {i for i, t in enumerate(texts) if not hits(t, bench, size)[0]}


def test_decontamination_of_long_texts_and_of_nothing(spark, monkeypatch):
    known = decontamination.WindowSet(["a b c"], ["1"])
    text = ("q é " * 50 + "a b. C ") * 40
    monkeypatch.setattr(decontamination, "PIECE", 64)
    ids = known.ids(text.encode())
    assert len(ids) == len(words(text)) and [p.tolist() for _, p, _ in known.hits(ids)] == [[100 + 103 * i for i in range(40)]]
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontamination.contaminations(none, items).count() == 0
    assert [(r.n_words, r.spans) for r in decontamination.contaminations(one, items).collect()] == [(2, [])]


def test_decontamination_removes_spans_and_documents_of_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    before = decontamination.op12_decontamination(spark, sf).filter("contaminated").count()
    cleaned = decontamination.decontaminate(docs, items)
    assert before > 0 and cleaned.columns == docs.columns
    spans = decontamination.contaminations(cleaned, items).filter(F.size("spans") > 0).count()
    assert spans == 0


def brute_resample(rows, target, run, buckets, least, percent, seed):
    feats = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, run + 1) for i in range(len(w) - k + 1)]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for f in feats(x):
            s[place(f)] += 1
    for x in target:
        for f in feats(x):
            t[place(f)] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    out = []
    for key, x in rows:
        f = feats(x)
        weight = sum(gain[place(y)] for y in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if key is None else key}")[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    ranked = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = ranked[: percent * len(ranked) // 100]
    ranks = {id(r): i + 1 for i, r in enumerate(drawn)}
    return sorted((str(r[0]), r[1], r[2], r[3], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize(("seed", "run", "frequent", "percent"), [(1, 1, 2_000_000, 10), (2, 2, 50, 30), (3, 3, 1, 100), (4, 1, 1000, 0)])
def test_importance_resampling(spark, seed, run, frequent, percent):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "cat", "ÉTÉ", "été", "dog9", "1", "x" * 200, *(f"w{i}" for i in range(60))]
    rows = [(i, rng.choice([None, "", "--"]) if i % 15 == 0 else rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(150)]
    target = [" ".join(rng.choices(vocabulary[:8], k=20)) for _ in range(5)] + [None]
    docs = spark.createDataFrame([(k, t, "a", 1, 2) for k, t in rows], "doc_id long, text string, f string, n long, gain long").repartition(6)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs, aim, run=run, buckets=97, least=20, percent=percent, frequent=frequent)
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == brute_resample(rows, target, run, 97, 20, percent, "2024")


def test_importance_reads_texts_once(spark):
    docs = spark.createDataFrame([(i, f"a b c{i} " * 10) for i in range(20)], "doc_id long, text string")
    plan = importance.weighted(docs, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "regexp_extract_all" not in plan


def test_importance_resampling_edges(spark):
    schema = "doc_id long, text string"
    aim = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert importance.resample(spark.createDataFrame([], schema), aim).count() == 0
    same = [(5, "a b c " * 10)] * 40 + [(None, "a b c " * 10)] * 10 + [(6, "a")]
    rows = importance.resample(spark.createDataFrame(same, schema), aim).collect()
    assert len(rows) == 51 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4, 5]
    assert importance.resample(spark.createDataFrame(same, schema), aim.filter("item_id > 5")).count() == 51
    drawn = importance.resampled_documents(spark.createDataFrame([(i, f"a b c{i} " * 10) for i in range(100)], schema), aim)
    assert drawn.count() == 10 and drawn.columns == ["doc_id", "text"]
