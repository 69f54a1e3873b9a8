"""Benchmark decontamination: windows of test words as a broadcast hash set, looked up at every place of every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, ship, stage_table, table, tidy

WINDOW = 10
#: A word: digits, lower-case letters and anything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows with their items in one broadcast set, and bytes of their words; a larger benchmark is as many sets, scanned in turn.
PART_WINDOWS, PART_BYTES = 400_000, 64 << 20
#: Bytes of a text whose words are told apart at once.
PIECE = 4 << 20
#: Bits that name the entries of the bitmap before the search.
BITMAP = 22
#: Every byte as it is for the words: letters in lower case, what is no part of a word as a space.
_TABLE = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_windows(benchmark: DataFrame, size: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (w, item): windows of `size` consecutive words joined by spaces, the whole of a shorter item; none of an item without words."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(ITEM_WORD), F.lit(0))
    rows = benchmark.select(F.col(key).cast("string").alias("item"), words.alias("x"))
    last = F.greatest(F.lit(0), F.size("x") - size)
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("x", i + 1, size), " "))
    return rows.filter(F.size("x") > 0).select("item", F.explode(runs).alias("w")).distinct()


class WindowSet:
    """Windows of words as numbers: per length a matrix, its sorted hashes, and the items of each row."""

    def __init__(self, windows: list[str], items: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        rows: dict[tuple[int, ...], set] = {}
        for w, item in zip(windows, items, strict=True):
            ids = tuple(number(x, len(self.vocabulary) + 1) for x in w.encode().split(b" "))
            rows.setdefault(ids, set()).add(item)
        by_length: dict[int, list] = {}
        for ids in rows:
            by_length.setdefault(len(ids), []).append(ids)
        self.lengths = [self.indexed(k, found, rows) for k, found in sorted(by_length.items())]

    @staticmethod
    def indexed(k: int, found: list[tuple[int, ...]], rows: dict) -> tuple:
        matrix = np.array(found, np.uint64)
        seed = 0
        while True:  # until no two windows share a hash; nearly always at once
            factors = np.random.default_rng(seed).integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
            hashes = (matrix * factors).sum(axis=1, dtype=np.uint64)
            if len(np.unique(hashes)) == len(hashes):
                break
            seed += 1
        order = np.argsort(hashes)
        hashes, matrix = hashes[order], matrix[order].astype(np.int32)
        bitmap = np.zeros(1 << BITMAP, bool)
        bitmap[hashes >> np.uint64(64 - BITMAP)] = True
        return k, factors, hashes, matrix, bitmap, [rows[found[i]] for i in order]

    def ids(self, text: bytes) -> np.ndarray:
        """The text's words as numbers, 0 for words that no window has. Long texts are cut at the ends of words."""
        get, out, at = self.vocabulary.get, [], 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and _TABLE[text[end]] != 32:
                end += 1
            words = text[at:end].translate(_TABLE).split()
            out.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[set]]]:
        """(length, places, items of each place) of the windows that occur, every hit compared word by word."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for k, factors, hashes, matrix, bitmap, items in self.lengths:
            n = len(ids) - k + 1
            if n <= 0:
                continue
            places = np.flatnonzero(known[k:] - known[:n] == k)
            if not len(places):
                continue
            h = np.zeros(len(places), np.uint64)
            for i in range(k):
                h += ids[places + i].astype(np.uint64) * factors[i]
            some = bitmap[h >> np.uint64(64 - BITMAP)]
            places, h = places[some], h[some]
            row = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[row] == h
            places, row = places[same], row[same]
            if len(places):
                real = (ids[places[:, None] + np.arange(k)] == matrix[row]).all(axis=1)
                places, row = places[real], row[real]
                if len(places):
                    yield k, places, [items[r] for r in row]


def covered(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans of word numbers as one."""
    step = np.zeros(n + 1, np.int64)
    for s, e in spans:
        step[s] += 1
        step[e] -= 1
    inside = np.concatenate([[0], np.cumsum(step)[:-1] > 0, [0]]).astype(np.int8)
    turns = np.diff(inside)
    return list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them."""
    import re

    starts, ends = [], []
    for m in re.finditer(rb"[^ ]+", text.translate(_TABLE)):
        starts.append(m.start())
        ends.append(m.end())
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at : starts[s]])
        at = ends[e - 1]
    return b"".join([*kept, text[at:]])


_FOUND = "n_words long, spans array<struct<s:long,e:long>>, items array<string>"
_FOUND_TYPES = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string()))]


def scanned(rows: DataFrame, windows: object, cut: bool = False) -> DataFrame:
    """Add one set's spans (word numbers) and items to rows (_in, text, n_words, spans, items); cut also takes the spans out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            texts = batch.column(1)
            found: list[list] = [[], [], []]
            changed = []
            for i in range(len(batch)):
                text = (texts[i].as_py() or "").encode()
                ids = known.ids(text)
                spans = [(x["s"], x["e"]) for x in batch.column(3)[i].as_py()]
                items = set(batch.column(4)[i].as_py())
                new = [(p, p + k, who) for k, places, whose in known.hits(ids) for p, who in zip(places.tolist(), whose, strict=True)]
                if new:
                    items.update(*(who for _, _, who in new))
                    spans = covered(len(ids), [*spans, *((s, e) for s, e, _ in new)])
                found[0].append(len(ids))
                found[1].append([{"s": s, "e": e} for s, e in spans])
                found[2].append(sorted(x for x in items if x is not None))
                if cut:
                    changed.append(without(text, spans).decode() if spans else texts[i].as_py())
            made = [pa.array(v, t) for v, (_, t) in zip(found, _FOUND_TYPES, strict=True)]
            text = pa.array(changed, pa.string()) if cut else texts
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *made], names=["_in", "text", *(n for n, _ in _FOUND_TYPES)])

    return rows.mapInArrow(tidy(run), f"_in {rows.schema['_in'].dataType.simpleString()}, text string, {_FOUND}")


def contaminations(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", cut: bool = False, most: int = PART_WINDOWS) -> DataFrame:
    """Rows of docs as (_in, text, n_words, spans, items): spans of word numbers inside occurring windows, merged, and the ids of their items.

    The benchmark's distinct windows are counted before they are broadcast: up to `most` windows with their items, and PART_BYTES of
    their words, are one set; beyond, they are dealt by hash to as many sets as keep the bounds, and the documents are scanned by one
    after the other, so nothing is left out. Windows are found by a 64-bit hash and compared word by word. A text's
    words are numbers in one array; rows are independent and never shuffled.

    Null and empty texts have no words and no spans; long texts are scanned whole. An item with a null id marks words and is not named; repeated
    item ids are one item, repeated rows of docs are rows of their own. An empty benchmark finds nothing, empty docs have no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = stage_table(item_windows(benchmark, size), "bench-windows")
    n, weight = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()
    parts = max(1, -(-n // most), -(-weight // PART_BYTES))
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("w", "item"), F.lit(parts)))
    rows = carried(docs, text=F.col(text)).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<s:long,e:long>>"), "items": F.array().cast("array<string>")})
    for part in range(parts):
        told = dealt.filter(F.col("part") == part).select("w", "item").toArrow()
        known = spark.sparkContext.broadcast(WindowSet(told.column(0).to_pylist(), told.column(1).to_pylist()))
        rows = scanned(rows, known, cut and part == parts - 1)
        if part < parts - 1:
            rows = stage_table(rows, f"bench-scan-{part}")
    return rows


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = WINDOW, text: str = "text", most_share: float = 0.5, **kw) -> DataFrame:
    """docs without what they share with the benchmark; columns as they are, whatever their names.

    remove='spans' takes the shared words, and what lies between them, out of the text, and the documents of which they are more than
    most_share of the words; remove='documents' takes every document with a hit. Edge cases: see contaminations().
    """
    rows = contaminations(docs, benchmark, size, text, cut=remove == "spans", **kw)
    hit = hit_words(F.col("spans"))
    kept = rows.filter(hit == 0) if remove == "documents" else rows.filter(hit <= most_share * F.col("n_words"))
    return kept.select(*[(F.col("text") if c == text and remove == "spans" else F.col("_in")[c]).alias(c) for c in docs.columns])


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten words of `benchmark`. Edge cases: see contaminations()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = contaminations(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n = hit_words(F.col("spans"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    rows = rows.select(F.col("_in.doc_id").alias("doc_id"), "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{ITEM_WORD}'), [])"

OP12_SQL = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, unnest(list_transform(range(greatest(1, len(w) - {WINDOW - 1})), lambda j: array_to_string(w[j + 1:j + {WINDOW}], ' '))) AS win
  FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM i),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, k, unnest(range(len(w) - k + 1)) AS s, w FROM d, k WHERE len(w) >= k),
h AS (SELECT r, s, k, array_to_string(w[s + 1:s + k], ' ') AS win FROM p),
o AS (SELECT r, s, h.k, item_id FROM h JOIN i ON i.win = h.win AND i.k = h.k),
n AS (SELECT r, count(DISTINCT c) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS c FROM o) GROUP BY r),
m AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM o GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
