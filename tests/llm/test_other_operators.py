"""Tokens, packing, joins, embeddings, pages, classifier and pipeline against plain Python."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longtext.llm import embedding_dedup, html_extraction, html_training, jaccard_join, packing, quality_classifier, tokens
from longtext.operators.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = ["", None, " \n\t ", "Don't STOP", "<|endoftext|> and x<|startoftext|>y <|STARTOFTEXT|>", "é é   　x y", "a̸ ̸", "İstanbul ſ", "x" * 9000, "日本語 テスト 😀👍", "1234.5 it's we'll", "\x00 \x1c \x85 a\x0bb"]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def sample_texts():
    found = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    return [*ODD, *found]


def test_token_counts(spark, encoded):
    texts = sample_texts()
    got = {r.doc_id: r for r in tokens.count_tokens(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(encoded(t))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), t


def test_long_texts_are_split_safely(encoded):
    import pyarrow as pa

    text = " ".join(f"word{i} é́" for i in range(3000))
    assert "".join(tokens.safe_parts(text, 100)) == text and len(tokens.safe_parts(text, 100)) > 100
    assert tokens.safe_parts("x" * 1000, 100) == ["x" * 1000]
    parts = list(tokens.balanced(pa.array([text, None, "a b"]), 1000))
    assert sum(len(p) for _, p in parts) > 20 and {i for rows, _ in parts for i in rows} == {0, 1, 2}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_every_vocabulary_counts_as_its_library(name, monkeypatch):
    import pyarrow as pa

    path, texts = tokens.vocabulary_path(name), [*ODD, "a  b\n\nc   d", "  lead and trail  ", *pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:60]]
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        want = [x for x in SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    else:
        from tokenizers import Tokenizer

        want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tokens.by_words(path) == (name == "word_bpe_49k.json")
    for most in (tokens.BATCH_BYTES, 200):
        monkeypatch.setattr(tokens, "BATCH_BYTES", most)
        assert tokens.lengths(pa.array(texts), path).tolist() == [len(x) for x in want]
    assert [x.tolist() for x in tokens.token_ids([t or "" for t in texts], path)] == want


def test_empty_tables_have_no_tokens_pages_or_sequences(spark):
    none = documents(spark, ["x"]).limit(0)
    assert tokens.count_tokens(none).count() == packing.pack_documents(none).count() == 0
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def check_packed(rows, want, capacity):
    """rows: packed pieces; want: {doc_id: ids}."""
    for doc, ids in want.items():
        mine = rows[rows.doc_id == doc].sort_values("piece")
        ids = np.array(ids, dtype="<u4")
        expected = [(p, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for p, at in enumerate(range(0, len(ids), capacity))]
        assert list(mine[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == expected
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= capacity and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]


def test_packing(spark, encoded):
    texts = [*sample_texts(), "long text " * 6000]
    rows = packing.pack_documents(documents(spark, texts)).toPandas()
    check_packed(rows, {i: [*encoded(t), 1] for i, t in enumerate(texts)}, 4096)
    total = int(rows.length.sum())
    assert rows.sequence_id.nunique() <= -(-total // 4096) + 1


@pytest.mark.parametrize("kind", ["small", "large", "mixed"])
def test_packing_exchange(spark, kind):
    r = random.Random(5)
    span = {"small": (1, 60), "large": (51, 99), "mixed": (1, 100)}[kind]
    made = [(i, 0, 0, r.randint(*span), 0) for i in range(3000)]
    df = spark.createDataFrame(made, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df, capacity=100, group_rows=600).toPandas()
    assert sorted(rows.doc_id) == list(range(3000))
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 100 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    bound = packing.lower_bound(rows.length.to_numpy(), 100)
    assert (rows.group_bound <= rows.group_bins).all()
    assert rows.sequence_id.nunique() <= (bound if kind == "large" else bound * 1.03 + 2)


def test_lower_bound_is_sound():
    r = np.random.default_rng(0)
    assert packing.lower_bound(np.array([51] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
    for _ in range(50):
        x = r.integers(1, 101, r.integers(1, 60))
        assert packing.lower_bound(x, 100) <= len(packing.best_fit_decreasing(x, 100)[2])


def brute_components(texts, k=4, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(seed, groups=6, copies=25):
    r = random.Random(seed)
    common = [[f"c{i}x{j}" for j in range(14)] for i in range(5)]
    texts = []
    for g in range(groups):
        base = [f"g{g}w{i * 31 % 57}" for i in range(r.randint(20, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = f"m{r.randrange(10**6)}"
            if r.random() < 0.2:
                w += r.choice(common)
            texts.append(" ".join(w).upper() if r.random() < 0.2 else "  ".join(w))
    texts += [" ".join(sum(r.sample(common, r.randint(1, 4)), [])) for _ in range(60)]
    texts += [None, "", "   ", "one", "One", "two words", "a b c", "a b c", "a b c d", "É x", "é x", *texts[:10]]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "long", "k", "percent"), [(1, 2, 4, 85), (2, 4, 4, 85), (3, 32, 4, 85), (4, 8, 5, 80), (5, 3, 5, 80)])
def test_jaccard_components(spark, seed, long, k, percent):
    texts = near_copies(seed)
    sizes, want = brute_components(texts, k, percent)
    got = {r.doc_id: r for r in jaccard_join.join_components(documents(spark, texts), k=k, percent=percent, long=long).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want


def test_no_document_is_ruled_out_where_not_all_long_lists_are_named(spark):
    """k bounds what two documents can share on long lists (see signature_lists); with lists left unnamed it must not be too low."""
    base = [f"w{i}" for i in range(160)]
    docs = documents(spark, [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(24)])
    none = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    hot = jaccard_join.met_lists(docs, 7, 4, 85, 4, none, False).filter("w is null").collect()
    assert hot and {k for r in hot for k in r.ks} == {157}


def test_merge_skip():
    r = random.Random(7)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randint(1, 20))) for _ in range(r.randint(1, 9))]
        weights = [r.randint(1, 5) for _ in lists]
        least = r.randint(1, 14)
        total = {i: sum(w for x, w in zip(lists, weights, strict=True) if i in x) for i in range(40)}
        assert jaccard_join.merge_skip(lists, weights, least) == [(i, n) for i, n in total.items() if n >= least]


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_a_signature(percent):
    r = np.random.default_rng(3)
    for _ in range(400):
        base = r.integers(0, 2**64, r.integers(6, 200), dtype=np.uint64)
        x = np.unique(base)
        y = np.unique(np.concatenate([x[r.random(len(x)) > r.random() * 0.2], r.integers(0, 2**64, r.integers(0, 1 + len(x) // 10), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and both < len(np.union1d(x, y)) and 100 * both >= percent * len(np.union1d(x, y)):
            assert set(jaccard_join.signatures(x, percent).tolist()) & set(jaccard_join.signatures(y, percent).tolist())


def counted_stages(monkeypatch):
    """Rows of each stage table that the join writes from now on."""
    seen, store = {}, jaccard_join.stage_table

    def counted(df, name):
        out = store(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stage_table", counted)
    return seen


def compared(seen):
    return sum(n for name, n in seen.items() if name == "jaccard-best" or name.startswith("jaccard-rest-"))


def test_common_passages_are_not_compared_in_pairs(spark, monkeypatch):
    """Documents made of 5 of 40 passages: few pairs are looked at, and sets are compared for those that link."""
    r, seen = random.Random(5), counted_stages(monkeypatch)
    passages = [" ".join(f"w{r.randrange(10**6)}" for _ in range(100)) for _ in range(40)]
    texts = [" ".join(r.sample(passages, 5)) for _ in range(800)]
    copy = texts[0].split()
    copy[3] = "other"
    texts.append(" ".join(copy))
    got = jaccard_join.join_components(documents(spark, texts)).collect()
    assert {x.doc_id: x.component_id for x in got if x.doc_id in (0, 800)} == {0: 0, 800: 0}
    assert compared(seen) < 0.01 * 800 * 800 and seen["jaccard-near"] < 20


def test_groups_near_the_threshold_are_not_compared_in_pairs(spark, monkeypatch):
    """Documents that each lack 4 of 60 blocks: similarities lie about the threshold, and signatures bring nearly all pairs together."""
    r, seen = random.Random(8), counted_stages(monkeypatch)
    blocks = [" ".join(f"b{i}w{j}" for j in range(12)) for i in range(60)]
    texts = [" ".join(blocks[i] for i in sorted(r.sample(range(60), 56))) for _ in range(100)]
    sizes, want = brute_components(texts)
    got = {x.doc_id: x for x in jaccard_join.join_components(documents(spark, texts)).collect()}
    assert [got[i].component_id for i in range(100)] == want
    assert compared(seen) < 10 * 100


@pytest.mark.parametrize("mode", ["stars", "next"])
def test_a_document_makes_few_pairs_however_many_signatures_it_has(spark, mode):
    r = np.random.default_rng(6)
    base = np.sort(r.integers(0, 2**63, 400, dtype=np.uint64))
    sets = [np.sort(np.delete(base, r.integers(0, 400, 8))) for _ in range(60)]
    rows = [(i, len(x), len(x), x.tobytes(), i) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "c long, n int, k int, s binary, l long")
    pairs = jaccard_join.signature_lists(df, 7, 85, mode, 1).filter("o > 0").count()
    different = len({t for x in sets for t in jaccard_join.signatures(x, 85).tolist()})
    assert 59 <= pairs <= 60 * jaccard_join.PARTNER_LISTS + (different if mode == "next" else 0)


def test_the_last_step_names_a_pair_once(spark, monkeypatch):
    """Documents that differ in 5 of 60 blocks each: pairs share many lists, and come out once for each range of signatures that holds one."""
    made, lists = [], jaccard_join.signature_lists

    def counted(sets, bits, percent, mode, turn=0):
        out = jaccard_join.stage_table(lists(sets, bits, percent, mode, turn), "made")
        if mode == "all":
            made.append((out.count(), out.select("a", "b").distinct().count()))
        return out

    monkeypatch.setattr(jaccard_join, "signature_lists", counted)
    blocks = [" ".join(f"b{i}w{j}" for j in range(12)) for i in range(60)]
    r = random.Random(8)
    texts = []
    for n in range(60):
        lost = set(r.sample(range(60), 5))
        texts.append(" ".join(f"d{n}x{i} " * 12 if i in lost else b for i, b in enumerate(blocks)))
    sizes, want = brute_components(texts)
    got = {x.doc_id: x for x in jaccard_join.join_components(documents(spark, texts)).collect()}
    assert [got[i].component_id for i in range(60)] == want
    assert made and made[0][1] > 500 and made[0][0] <= 2 * made[0][1]


def test_one_of_each(spark):
    texts = ["a b c d e f g h"] * 3 + ["x y z w v", None, ""]
    docs = documents(spark, texts).union(documents(spark, ["a b c d e f g h"]))
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]


def test_one_of_each_of_null_and_repeated_ids(spark):
    """Two texts under one id, near copies without any id: each text stays or goes by itself; columns keep their values."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, "p"), (None, long + " end", "q"), (9, "one two three four five", "r"), (9, "quite another text is here", "s"), (None, "lonely words of no other", "t"), (None, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = jaccard_join.one_of_each(docs)
    got = sorted(r.component for r in kept.collect())
    assert kept.columns == docs.columns and got in (list("prstu"), list("qrstu"))
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_jaccard_empty(spark):
    assert jaccard_join.join_components(documents(spark, ["x"]).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e", 1, "x"), (5, "a b c d e", 2, "y"), (5, None, 3, "z")], "doc_id long, text string, f long, component_id string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.join_components(odd).collect()) == [(-1, 5), (5, 5), (5, 5)]


def vectors(seed=0, dim=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    rows = [list(map(float, c + r.normal(scale=s, size=dim))) for c in centres for s in (0.05, 0.2, 0.2, 0.3, 0.4, 0.5)]
    rows += rows[:5] + [[x * 3 for x in rows[0]]] + [list(map(float, v)) for v in r.normal(size=(60, dim))]
    return rows + [None, [0.0] * dim, [float("nan")] * dim, [float("inf"), *[0.0] * (dim - 1)], [None] * dim, [], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0]]


@pytest.mark.parametrize("block", [8, 1024])
def test_embeddings(spark, block):
    rows = vectors()
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    unit = [np.array(v) / np.linalg.norm(v) if ok else None for v, ok in zip(rows, fine, strict=True)]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= 0.9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    assert [got[i].n_links for i in range(len(rows))] == links
    assert [got[i].component_id for i in range(len(rows))] == [find(i) for i in range(len(rows))]
    assert all(got[i].kept == (find(i) == i) for i in range(len(rows)))


def test_vectors_are_sent_once_for_each_group_of_blocks(spark):
    """Blocks that all meet each other: 32 of them, of which 8 travel together, are 5 copies of each vector or fewer, not 32."""
    r = np.random.default_rng(2)
    rows = [(i, list(map(float, v))) for i, v in enumerate(r.normal(size=(256, 12)))]
    df = spark.createDataFrame(rows, "c long, e array<double>").withColumns({"dim": F.lit(12), "m": F.lit(1).cast("long")})
    placed = embedding_dedup.sequence(df, spark.sparkContext.broadcast({}), 0.4, 8)
    blocks = sorted(x.blk for x in placed.select("blk").distinct().collect())
    pairs = spark.createDataFrame([(12, x, y, i, j) for i, x in enumerate(blocks) for j, y in enumerate(blocks) if i <= j], "dim int, i long, j long, ki long, kj long")
    links = embedding_dedup.linked(placed, pairs, 0.5, group=8)
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    want = ((x @ x.T >= 0.5) & ~np.eye(256, dtype=bool)).sum(axis=1)
    got = {t.c: t.k for t in links.groupBy("c").agg(F.sum("k").alias("k")).collect()}
    assert [got.get(i, 0) for i in range(256)] == want.tolist()
    cells = {(i // 8, j // 8) for i in range(len(blocks)) for j in range(i, len(blocks))}
    joined = links._jdf.queryExecution().optimizedPlan().toString()
    assert len(cells) <= 15 and "FlatMapCoGroupsInPandas" in joined


def test_embeddings_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(none).count() == 0


def test_boxes_prune_distant_blocks(spark):
    rows = [(1, b, [float(b * 10)], [float(b * 10 + 1)]) for b in range(40)]
    found = spark.createDataFrame(rows, "dim int, blk long, lo array<double>, hi array<double>")
    pairs = sorted(tuple(r) for r in embedding_dedup.block_pairs(found, 9.5).select("i", "j").collect())
    assert pairs == sorted([(b, b) for b in range(40)] + [(b, b + 1) for b in range(39)])


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>"
    "<div class=\"ad\">Buy this now.</div><article><h1>The  title &amp; more</h1><p>First <b>bold</b>\n line of the text.<p>Second &eacute;t&#233; line, with more words in it.<br>Same block."
    "</article><script>var x='<p>no</p>';</script><div class='comments'><h3>Comments</h3><p>Great post, thanks!</p></div><footer>&copy; site</footer></body></html>"
)


def test_page_blocks():
    texts = [t for _, t, _ in html_extraction.blocks_of(PAGE)]
    assert texts == ["Home", "News", "Buy this now.", "The title & more", "First bold line of the text.", "Second été line, with more words in it. Same block.", "Comments", "Great post, thanks!", "© site"]
    for odd in ("", "<", "<p", "a < b", "<!-- x", "<script>", "<script>x</script", "</p></p>", "<p>" * 3000, "x" * 100_000, "<a href='x>y", "&#xD800; &amp;lt;", "<![CDATA[x]]>y"):
        html_extraction.blocks_of(odd)


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (3, None, ""), (1, "u", PAGE), (4, "w", "<nav><a href='/'>Home</a></nav>")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    want = "The title & more\nFirst bold line of the text.\nSecond été line, with more words in it. Same block."
    assert [(r.page_id, r.text) for r in got[:4]] == [(1, want), (1, want), (2, ""), (3, "")] and got[0].n_chars == len(want)


def test_extraction_on_tables():
    pages = pd.read_parquet(f"{SF}/pages.parquet").html.tolist()
    want = ["\n".join(t for path, t, _ in html_extraction.blocks_of(p) if "article" in path) for p in pages]
    right = sum(a == b for a, b in zip(html_extraction.main_texts(pages), want, strict=True))
    assert right >= 0.98 * len(pages)


def test_labeller_accuracy_on_unseen_pages():
    blocks, pages = html_training.accuracy(html_extraction.model(), 150)
    assert blocks > 0.99 and pages > 0.9


def test_labeller_gradients():
    pages = [html_training.example(7), html_training.example(8)]
    x, t = [html_extraction.page_matrix(b).astype(float) for b, _ in pages], [t for _, t in pages]
    w = html_extraction.start_weights(1)
    g, _ = html_training.gradients(x, t, w)
    for name in w:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        keep, eps = w[name][at], 1e-6
        w[name][at] = keep + eps
        up = html_training.gradients(x, t, w)[1]
        w[name][at] = keep - eps
        down = html_training.gradients(x, t, w)[1]
        w[name][at] = keep
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-5


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality_classifier.classify(docs, labels.filter(~held)).toPandas().merge(labels.filter(held).toPandas(), on="doc_id")
    assert ((got.p_quality > 0.5) == (got.quality == 1)).mean() > 0.95


def test_classifier_posteriors(spark):
    rows = [("big", "a", 0.9)] * 200 + [("big", "b", 0.9)] * 200 + [("bad", "a", 0.1)] * 100 + [("new", "a", 0.1)] + [(None, None, 0.5)]
    out = quality_classifier.posteriors(spark.createDataFrame(rows, "host string, path string, p_doc double")).distinct().toPandas().set_index("host")
    assert out.loc["bad"].p_host < 0.3 and 0.8 < out.loc["big"].p_host.iloc[0] < 0.95
    assert out.loc["new"].p_host > out.loc["bad"].p_host + 0.2
    assert ((out.p_good > 0) & (out.p_good < 1)).all()


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (None, 0, 0), (2, None, 1)]])
def test_classifier_edges(spark, labels):
    docs = documents(spark, ["some words", None, "", "x " * 1000])
    found = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.count() == 4 and quality_classifier.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_hashes_match_words():
    parts = ["Ab cd\tab", "", "  x ", "É é"]
    words, offsets = jaccard_join.word_hashes(parts)
    assert offsets.tolist() == [0, 3, 3, 4, 6]
    assert words[0] == words[2] and len(set(words.tolist())) == 5


def test_pipeline(spark, encoded):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    last = now.toPandas()
    rows = corpus_pipeline.run(spark, SF).toPandas()
    want = {}
    for d, t in zip(last.doc_id, last.text, strict=True):
        want.setdefault(d, []).append([*encoded(t), 1])
    assert sorted(set(rows.doc_id)) == sorted(want)
    assert rows.length.sum() == sum(len(ids) for group in want.values() for ids in group)
    check_packed(rows[[len(want[d]) == 1 for d in rows.doc_id]].assign(offset=0, sequence_id=range(sum(len(want[d]) == 1 for d in rows.doc_id))), {d: g[0] for d, g in want.items() if len(g) == 1}, 4096)
    assert not last.text.str.contains(r"[A-Za-z0-9]@[A-Za-z0-9]+\.").any()


def test_edges_of_components(spark):
    from longtext.llm.common import stage_table

    df = spark.createDataFrame([(3, 2), (2, 9)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df, "a", "b", stage_table).collect()} == {2: 2, 3: 2, 9: 2}
