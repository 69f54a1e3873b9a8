"""Duplicate clusters: edges by url, text hash, title and text similarity, closed transitively; nothing is deleted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longtext.functions.text import hash_of_normalized, shingles
from longtext.functions.udfs import indel_ratio
from longtext.sources.html import bounded_batches

from .components import connected_components, dealt
from .ranges import placed

BANDS, ROWS = 16, 8
LEAST_CHARS = 200


def star_edges(df: DataFrame, key: str, group: Column, reason: str) -> DataFrame:
    """Edges from each row to the least id of its group; blank groups have none."""
    rows = df.select(F.col(key).alias("b"), group.alias("_g")).filter("_g is not null and _g != ''")
    least = rows.groupBy("_g").agg(F.min("b").alias("a"))
    return rows.join(dealt(least), "_g").filter("a < b").select("a", "b", F.lit(reason).alias("reason"))


def url_edges(df: DataFrame, key: str = "id", url: str = "source_url") -> DataFrame:
    return star_edges(df, key, F.trim(url), "url")


def hash_edges(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return star_edges(df, key, F.when(F.length(text) > 0, hash_of_normalized(F.col(text))), "hash")


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= _P2
    x ^= x >> np.uint64(29)
    x *= _P3
    x ^= x >> np.uint64(32)
    return x


def _hash_longs(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = _turned(_turned(x * _P2, 31) * _P1 ^ (seed + _P5 + np.uint64(8)), 27) * _P1 + _P4
    return _mixed(h)


def _hash_int(x: int, seed: np.ndarray) -> np.ndarray:
    return _mixed(_turned((seed + _P5 + np.uint64(4)) ^ np.uint64(x * int(_P1) % 2**64), 23) * _P2 + _P3)


def seeded_bands(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each run of longs that begins at one of `starts`, a hash per band: xxhash64(band, minima), as Spark computes it, where the minima are
    the least xxhash64(x, seed) of `rows` seeds each."""
    x = _hash_longs(hashes.view(np.uint64), np.full(1, 42, np.uint64)) + _P5 + np.uint64(4)
    h, t = np.empty_like(x), np.empty_like(x)
    by = [np.uint64(n) for n in (23, 41, 33, 29, 32)]
    out = np.empty((len(starts), bands), np.int64)
    for band in range(bands):
        key = _hash_int(band, np.full(len(starts), 42, np.uint64))
        for seed in range(band * rows, (band + 1) * rows):
            # _hash_int(seed, x) in two buffers that stay in the core's cache
            np.bitwise_xor(x, np.uint64(seed * int(_P1) % 2**64), out=h)
            np.left_shift(h, by[0], out=t)
            np.right_shift(h, by[1], out=h)
            h |= t
            h *= _P2
            h += _P3
            for shift, times in ((by[2], _P2), (by[3], _P3)):
                np.right_shift(h, shift, out=t)
                h ^= t
                h *= times
            np.right_shift(h, by[4], out=t)
            h ^= t
            least = np.minimum.reduceat(h.view(np.int64), starts)
            key = _hash_longs(least.view(np.uint64), key)
        out[:, band] = key.view(np.int64)
    return out


def bands_function(bands: int, rows: int, most: int = 1 << 13):
    """Arrow function array of longs -> array of band hashes; null of an empty array. Works through about `most` longs at a time, which stays in a core's cache."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def made(sets: pd.Series) -> pd.Series:
        out, held, n = [None] * len(sets), [], 0

        def flush() -> None:
            starts = np.cumsum([0, *(len(x) for _, x in held[:-1])])
            for (i, _), row in zip(held, seeded_bands(np.concatenate([x for _, x in held]), starts, bands, rows), strict=True):
                out[i] = row

        for i, x in enumerate(sets):
            if x is None or not len(x):
                continue
            held.append((i, np.asarray(x, np.int64)))
            n += len(x)
            if n >= most:
                flush()
                held, n = [], 0
        if held:
            flush()
        return pd.Series(out, dtype=object)

    return made


def band_keys(hashes: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """Array of one hash per band: minima of seeded hashes over a set of longs, `rows` at a time. Empty sets have the same bands.

    The longs should be a stored column: Spark does not take nested lambdas as an argument of an Arrow function.
    """
    return F.coalesce(bands_function(bands, rows)(hashes), F.array(*[F.xxhash64(F.lit(b)) for b in range(bands)]))


def text_edges(df: DataFrame, save, key: str = "id", text: str = "text", least: float = 85.0) -> DataFrame:
    """Near-duplicate texts: minhash bands give candidates, the edit ratio of the whole texts decides.

    Equal texts are one candidate. In each band bucket the members meet the bucket's least member first.
    Where that leaves a bucket in several components, their least members meet each other. Members of
    components that are then still apart meet in all the pairs not yet compared whose lengths allow the
    ratio, so that every candidate is confirmed, refused or within one component already. Lengths, which
    travel along, rule pairs out before their texts are fetched.
    """
    bounded_batches(df.sparkSession)
    rows = df.filter(F.length(text) >= LEAST_CHARS).select(F.col(key).alias("i"), F.col(text).alias("t"))
    rows = rows.groupBy(F.md5("t").alias("h")).agg(F.min("i").alias("i"), F.first("t").alias("t"))
    heads = save(rows.select("i", "t", F.length("t").alias("n"), F.transform(shingles(F.col("t")), lambda x: F.xxhash64(x)).alias("s")), "heads")
    keyed = heads.select("i", "n", band_keys(F.col("s")).alias("ks"))
    banded = save(keyed.select("i", "n", F.posexplode("ks").alias("band", "k")), "bands")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = heads.select(F.col("i").alias("a"), F.col("t").alias("x")), heads.select(F.col("i").alias("b"), F.col("t").alias("y"))
        return pairs.join(x, "a").join(y, "b").filter(indel_ratio("x", "y") >= least).select("a", "b")

    def pairs_of(rows: DataFrame) -> DataFrame:
        long_enough = 200 * F.least("nx", "ny") >= least * (F.col("nx") + F.col("ny"))
        return rows.filter("ix < iy").filter(long_enough).select(F.col("ix").alias("a"), F.col("iy").alias("b")).distinct()

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("band", "k", *[F.col(n).alias(n + s) for n in rows.columns if n not in ("band", "k")])

    first = banded.groupBy("band", "k").agg(F.min(F.struct("i", "n")).alias("l")).select("band", "k", "l.*")
    met = save(pairs_of(side(first, "x").join(side(banded, "y"), ["band", "k"])), "near-met")
    links = save(confirmed(met), "near-0")

    def labelled(links: DataFrame) -> DataFrame:
        labels = connected_components(links, "a", "b", save)
        return banded.join(labels.withColumnRenamed("node", "i"), "i", "left").withColumn("c", F.coalesce("component", "i"))

    named = labelled(links)
    parts = save(named.groupBy("band", "k", "c").agg(F.min(F.struct("i", "n")).alias("l")).select("band", "k", "l.*"), "near-parts")
    pairs = save(pairs_of(side(parts, "x").join(side(parts, "y"), ["band", "k"])), "near-pairs")
    links = save(links.union(confirmed(pairs)).distinct(), "near-1")

    named = save(labelled(links), "near-named")
    apart = named.groupBy("band", "k").agg(F.min("c").alias("c"), F.max("c").alias("last")).filter("c != last").select("band", "k")
    held = named.join(apart, ["band", "k"]).select("band", "k", "i", "n", "c")
    rest = pairs_of(side(held, "x").join(side(held, "y"), ["band", "k"]).filter("cx != cy")).join(met.union(pairs), ["a", "b"], "left_anti")
    return links.union(confirmed(rest)).distinct().withColumn("reason", F.lit("text"))


def clusters(df: DataFrame, edges: DataFrame, save, key: str = "id", quality: str = "quality_score", words: str = "word_count") -> DataFrame:
    """(key, cluster_id, is_canonical): clusters numbered by their least id; canonical is the best quality, then the longest, then the least id.

    The canonical row of a cluster is a maximum, combined per task before the shuffle, so a cluster of any size is no large group.
    """
    found = connected_components(edges, "a", "b", save)
    rows = df.select(key, quality, words).join(found.select(F.col("node").alias(key), "component"), key, "left").withColumn("component", F.coalesce("component", key))
    rows = save(rows, "cluster-rows")
    rank = F.struct(F.coalesce(F.col(quality), F.lit(0.0)).alias("q"), F.coalesce(F.col(words), F.lit(0)).alias("w"))
    top = rows.groupBy("component").agg(F.max(rank).alias("_top"))
    best = rows.withColumn("_top", rank).join(top, ["component", "_top"]).groupBy("component").agg(F.min(key).alias("_best"))
    ranks = numbered(best, "component", save)
    return rows.join(ranks, "component").select(key, F.concat(F.lit("clust_"), F.lpad(F.col("number").cast("string"), 6, "0")).alias("cluster_id"), (F.col(key) == F.col("_best")).alias("is_canonical"))


def numbered(keys: DataFrame, column: str, save) -> DataFrame:
    """Rows with distinct keys and `number`, the key's 0-based rank, by ranges: see placed()."""
    one = keys.withColumn("_all", F.lit(0))
    return placed(one, "_all", [column], save, "ranks").withColumnRenamed("idx", "number").drop("_all", "_n")
