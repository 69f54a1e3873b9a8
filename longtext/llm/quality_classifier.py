"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stage_table, table
from .jaccard_join import U, word_hashes
from .tokens import balanced

#: Most labelled documents that the classifier is fitted on: those with the least hash of their id.
SAMPLE = 12_000
BITS = 18
EPOCHS, RATE, SHRINK, BATCH = 120, 0.05, 1e-5, 512
#: A word bucket counts for a label when its share of either class differs by this many standard errors.
SIGMAS = 6.0
KEEP = 0.5

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PLAIN = np.where(_LETTERS, np.arange(256), 32).astype(np.uint8)
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_BARS, _CRIES, _MARKS = [124], [33], [ord(c) for c in "#*$%&<>"]


def dense_features(text: bytes, words: int, distinct: int) -> list[float]:
    many = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256)
    letters, w = max(1, many[_LETTERS].sum()), max(1, words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / max(1, len(lines))
    rates = [min(1.0, many[x].sum() / w) for x in (_BARS, _CRIES, _MARKS)]
    return [
        1.0,
        np.log1p(words) / 8,
        *rates,
        *[float(x > 0.2) for x in rates],
        many[_UPPER].sum() / letters,
        float(many[_UPPER].sum() / letters > 0.5),
        again,
        float(again > 0.3),
        distinct / w,
        float(w < 20),
        min(1.0, many[_DIGIT].sum() / w),
        min(2.0, letters / w / 8),
    ]


DENSE = len(dense_features(b"", 0, 0))


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, list[float]]]:
    """(distinct word buckets, dense features) of every whole text, in order; null counts as empty."""
    at, hashes, raw = -1, [], []

    def made() -> tuple[np.ndarray, list[float]]:
        h, text = np.concatenate(hashes), b" ".join(raw)
        buckets = np.unique(h >> U(64 - bits)).astype(np.int64)
        return buckets, dense_features(text, len(h), len(buckets))

    for rows, parts in balanced(texts, 1 << 19):
        plain = [p.encode("utf-8", "surrogatepass") for p in parts]
        spaced = [_PLAIN[np.frombuffer(p, np.uint8)].tobytes().decode("utf-8", "surrogatepass") for p in plain]
        words, offsets = word_hashes(spaced)
        for j, row in enumerate(rows.tolist()):
            if row != at and at >= 0:
                yield made()
                hashes, raw = [], []
            at = row
            hashes.append(words[offsets[j] : offsets[j + 1]])
            raw.append(plain[j])
    if at >= 0:
        yield made()


def fit_logistic(buckets: list[np.ndarray], dense: np.ndarray, label: np.ndarray, bits: int = BITS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights of (word buckets, dense features): logistic regression by Adam on the buckets that tell the classes apart by SIGMAS standard errors."""
    w, v = np.zeros(2**bits), np.zeros(dense.shape[1])
    if len(label) == 0 or label.min() == label.max():
        v[0] = 4.0 if len(label) and label.min() == 1 else (-4.0 if len(label) else 0.0)
        return w, v
    many = [np.zeros(2**bits), np.zeros(2**bits)]
    for b, y in zip(buckets, label.tolist(), strict=True):
        many[y][b] += 1
    sizes = [(label == y).sum() for y in (0, 1)]
    share = (many[0] + many[1] + 1) / (len(label) + 2)
    error = np.sqrt(share * (1 - share) * (1 / sizes[0] + 1 / sizes[1]))
    used = (np.abs(many[1] / sizes[1] - many[0] / sizes[0]) > SIGMAS * error) & (many[0] + many[1] >= 5)
    buckets = [b[used[b]] for b in buckets]
    rng, n = np.random.default_rng(seed), len(label)
    weight = np.where(label == 1, 0.5 * n / label.sum(), 0.5 * n / (n - label.sum()))
    mw, sw, mv, sv, step = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            rows = order[s : s + BATCH]
            sizes = np.array([len(buckets[i]) for i in rows])
            flat = np.concatenate([buckets[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            score = dense[rows] @ v + np.bincount(owner, w[flat], len(rows))
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label[rows]) * weight[rows] / len(rows)
            step += 1
            touched, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, error[owner], len(touched)) + SHRINK * w[touched]
            mw[touched] = 0.9 * mw[touched] + 0.1 * g
            sw[touched] = 0.99 * sw[touched] + 0.01 * g * g
            w[touched] -= RATE * mw[touched] / (np.sqrt(sw[touched]) + 1e-8)
            g = dense[rows].T @ error
            mv, sv = 0.9 * mv + 0.1 * g, 0.99 * sv + 0.01 * g * g
            v -= RATE * mv / (np.sqrt(sv) + 1e-8)
    return w, v


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Models for quality and toxic from at most `sample` labelled documents (bounded, so they may be sent to all tasks and to the driver)."""
    chosen = labels.dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "quality", "toxic")), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(features(batch.column(1)))
            columns = [pa.array([b.astype("<i4").tobytes() for b, _ in made], pa.binary()), pa.array([d for _, d in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2), batch.column(3)], names=["k", "b", "d", "quality", "toxic"])

    rows = rows.select("doc_id", "text", F.col("quality").cast("int"), F.col("toxic").cast("int"))
    found = rows.mapInArrow(run, f"k {docs.schema['doc_id'].dataType.simpleString()}, b binary, d array<double>, quality int, toxic int").toPandas()
    found = found.sort_values("k")
    buckets = [np.frombuffer(b, "<i4").astype(np.int64) for b in found["b"]]
    dense = np.array(found["d"].tolist(), dtype=float).reshape(len(found), DENSE)
    return {name: fit_logistic(buckets, dense, found[name].to_numpy()) for name in ("quality", "toxic")}


def logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (1 - held))


def strength(mean: str) -> Column:
    """Prior strength by moments: m(1-m) / variance between groups - 1, within 1..10000."""
    centre, spread = F.avg(mean), F.coalesce(F.var_pop(mean), F.lit(0.0))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.when(spread > 0, centre * (1 - centre) / spread - 1).otherwise(F.lit(1e4))))


def posteriors(scored: DataFrame) -> DataFrame:
    """Add p_host, p_path, p_good to rows with host, path, p_doc.

    A host's posterior is its documents' mean shrunk to the global mean, a path's the mean shrunk to its
    host's; the strengths come from the spread between groups, so sparse sites stay near their parents. A
    document's log-odds move by those of its path against the global prior. Sums per (host, path) are
    combined per task, so a hot host makes no large group; hosts are rows of the path sums.
    """
    paths = stage_table(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s")), "bayes-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")).withColumn("hm", F.col("hs") / F.col("hn"))
    world = paths.agg((F.sum("s") / F.sum("n")).alias("m"))
    between = hosts.agg(strength("hm").alias("kh"))
    within = paths.withColumn("pm", F.col("s") / F.col("n")).agg(strength("pm").alias("kp"))
    known = world.crossJoin(between).crossJoin(within)
    hosts = hosts.crossJoin(F.broadcast(known)).withColumn("p_host", (F.col("hs") + F.col("kh") * F.col("m")) / (F.col("hn") + F.col("kh")))
    h, p = hosts.alias("h"), paths.alias("p")
    levels = p.join(h, F.col("p.host").eqNullSafe(F.col("h.host"))).select(
        "p.host", "p.path", "p_host", ((F.col("s") + F.col("kp") * F.col("p_host")) / (F.col("n") + F.col("kp"))).alias("p_path"), "m"
    )
    x, y = scored.alias("x"), levels.alias("y")
    both = x.join(y, F.col("x.host").eqNullSafe(F.col("y.host")) & F.col("x.path").eqNullSafe(F.col("y.path")))
    moved = logit(F.col("p_doc")) + logit(F.col("p_path")) - logit(F.col("m"))
    return both.select("x.*", "p_host", "p_path", (1 / (1 + F.exp(-moved))).alias("p_good"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, host, path, p_quality, p_toxic, p_doc, p_host, p_path, p_good, kept.

    p_doc, the document's evidence, is the chance of good quality and no toxicity by two logistic models
    over all its distinct words and a few counts. Null and empty texts are scored as empty; null hosts
    and paths are groups of their own; without labels every document's evidence is neutral. Repeated rows
    are scored alike. kept: p_good of at least `keep`.
    """
    spark = docs.sparkSession
    ship(spark)
    models = spark.sparkContext.broadcast({k: (w.astype(np.float32), v) for k, (w, v) in fit(docs, labels, sample).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = {k: [] for k in models.value}
            for b, d in features(batch.column(3)):
                for k, (w, v) in models.value.items():
                    scores[k].append(1 / (1 + np.exp(-np.clip(w[b].sum(dtype=np.float64) + float(np.dot(d, v)), -30, 30))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(scores["quality"], pa.float64()), pa.array(scores["toxic"], pa.float64())],
                names=["k", "host", "path", "p_quality", "p_toxic"],
            )

    rows = docs.select("doc_id", F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"k {kind}, host string, path string, p_quality double, p_toxic double")
    scored = stage_table(scored.withColumnRenamed("k", "doc_id").withColumn("p_doc", F.col("p_quality") * (1 - F.col("p_toxic"))), "bayes-scored")
    return posteriors(scored).withColumn("kept", F.col("p_good") >= keep)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
