"""Merkle manifest of a dataset: a mountain-range stack per indexed partition, then a distributed merge of what is left at the edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, ship, stage_table, table, tidy

FANOUT = 8
#: Hex digits of a digest.
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = pa.schema([("g", pa.string()), ("height", pa.int32()), ("level", pa.int32()), ("at", pa.int64()), ("run", pa.bool_()), ("h", pa.string())])
_ROW_SQL = "g string, height int, level int, at long, run boolean, h string"


def leaf_hash(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and the value, null as a dash."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def levels_of(n: Column, fanout: int = FANOUT) -> Column:
    """Levels above n nodes until one is left: the number of powers of the fanout, from 1 on, below n."""
    powers, p = [], 1
    while p < 2**62:
        powers.append(F.lit(p))
        p *= fanout
    return F.size(F.filter(F.array(*powers), lambda x: x < n)).cast("int")


class Mountains:
    """The open runs of one stretch of consecutive nodes, one per level.

    A run that is complete and began at a multiple of the fanout becomes a record and carries its digest to the
    level above. A run that the stretch entered in the middle, or that it leaves unfinished, gives its nodes
    as they are: its other nodes are in other stretches.
    """

    def __init__(self, fanout: int, emit):
        self.fanout, self.emit, self.open = fanout, emit, []

    def push(self, at: int, digest: str) -> None:
        level = 0
        while True:
            if level == len(self.open):
                self.open.append((at, []))
            first, nodes = self.open[level]
            if not nodes:
                first = at
                self.open[level] = (first, nodes)
            nodes.append(digest)
            if (at + 1) % self.fanout:
                return
            self.open[level] = (0, [])
            if len(nodes) < self.fanout:
                self.leave(level, first, nodes)
                return
            at //= self.fanout
            kids = "".join(nodes)
            self.emit(level, at, True, kids)
            digest = hashlib.sha256(kids.encode()).hexdigest()
            level += 1

    def leave(self, level: int, first: int, nodes: list[str]) -> None:
        for i, h in enumerate(nodes):
            self.emit(level, first + i, False, h)

    def flush(self) -> None:
        for level, (first, nodes) in enumerate(self.open):
            self.leave(level, first, nodes)
        self.open = []


def stacked(fanout: int):
    """Arrow function over rows (g, height, idx, leaf): run records (children's digests in one string) and nodes left over.

    Whatever stretches the task's rows form, records are right: where a row does not follow the one before it, the stack is left
    and begun anew. Memory is one open run per level, and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _ROW]
        state = {"g": None, "height": 0, "next": -1}

        def emit(level: int, at: int, is_run: bool, h: str) -> None:
            for column, v in zip(out, (state["g"], state["height"], level, at, is_run, h), strict=True):
                column.append(v)

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _ROW, strict=True)], schema=_ROW)
            for c in out:
                c.clear()
            return made

        mountains = Mountains(fanout, emit)
        for batch in batches:
            for g, height, idx, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if idx != state["next"] or g != state["g"]:
                    mountains.flush()
                    state.update(g=g, height=height)
                mountains.push(idx, leaf)
                state["next"] = idx + 1
            yield full()
        mountains.flush()
        yield full()

    return run


@dataclass
class Manifest:
    """leaves (g, idx, height, leaf and the columns carried), runs by level (g, height, at, kids), tops (g, height, subroot, root, path)."""

    leaves: DataFrame
    runs: list[DataFrame]
    tops: DataFrame
    fanout: int


def indexed(rows: DataFrame, order: list[str], name: str, fanout: int) -> DataFrame:
    """Stored rows (g, leaf, ...) with idx, the place within g by order, and height, the levels above g's leaves.

    Rows are dealt to ranges of (g, order) and sorted inside; the id that Spark gives to rows in turn then holds the range and the place
    in it, and sums of the ranges' sizes give the rest. A large g is many ranges.
    """
    by = ["g", *order]
    # AQE may join small ranges; the row ids below are made after that
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    ranged = stage_table(ranged.withColumn("_p", F.shiftright("_m", 33)), f"{name}-ordered")
    sizes = ranged.groupBy("g", "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    inside = Window.partitionBy("g")
    sizes = sizes.withColumns({"_before": F.sum("_n").over(inside.orderBy("_p")) - F.col("_n"), "height": levels_of(F.sum("_n").over(inside), fanout)})
    placed = join_small(ranged, stage_table(sizes.drop("_n"), f"{name}-ranges"), ["g", "_p"], "inner")
    return placed.withColumn("idx", F.col("_m") - F.col("_first") + F.col("_before")).drop("_m", "_first", "_before")


def merged(nodes: DataFrame, levels: int, name: str, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(runs by level, tops) from nodes (g, height, level, at, h) that no stretch could finish, level by level up to one node for each g.

    A group is one run, the fanout's nodes at most; the last run of a level is hashed as it is, without padding. Each level is a small stored table.
    """
    runs, tops, carried = [], nodes.filter("level = height"), None
    for level in range(levels):
        here = nodes.filter((F.col("level") == level) & (F.col("height") > level)).select("g", "height", "at", "h")
        here = here if carried is None else here.unionByName(carried.filter(F.col("height") > level).select("g", "height", "at", "h"))
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        done = here.groupBy("g", "height", F.expr(f"at div {fanout}").alias("run")).agg(kids.alias("kids"))
        done = stage_table(done.select("g", "height", F.col("run").alias("at"), "kids"), f"{name}-merge-{level}")
        runs.append(done)
        carried = done.select("g", "height", F.lit(level + 1).alias("level"), "at", F.sha2("kids", 256).alias("h"))
        tops = tops.unionByName(carried.filter("level = height").select(*tops.columns))
    return runs, tops.select("g", "height", F.col("h").alias("subroot"))


def sides(kids: Column, at: Column, fanout: int) -> Column:
    """The digests before and after node `at` in its run's string."""
    place = (F.pmod(at, F.lit(fanout)) * HEX).cast("int")
    return F.struct(F.substring(kids, F.lit(1), place).alias("l"), F.substring(kids, place + (HEX + 1), F.lit(fanout * HEX)).alias("r"))


_PATH = "array<struct<l:string,r:string>>"


def paths(runs: list[DataFrame], tops: DataFrame, name: str, fanout: int) -> DataFrame:
    """(g, at, kids, path, subroot, root): every run of leaves with the sides of its digest up to the root, from the top down.

    tops: (g, height, subroot, root, path). A g of one leaf has no run; it gets a row without kids. The runs of each level meet those
    of the level above, an eighth of their number.
    """
    said = ["subroot", "root"]
    above = tops.filter("height = 0").select("g", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("kids"), "path", *said)
    for level in range(len(runs) - 1, -1, -1):
        first = runs[level].filter(F.col("height") == level + 1).join(tops.select("g", "path", *said), "g").select("g", "at", "kids", "path", *said)
        up = above.filter("kids is not null").select("g", F.col("at").alias("_up"), F.col("kids").alias("_kids"), "path", *said)
        lower = runs[level].filter(F.col("height") > level + 1).withColumn("_up", F.expr(f"at div {fanout}")).join(up, ["g", "_up"])
        path = F.concat(F.array(sides(F.col("_kids"), F.col("at"), fanout)), F.col("path"))
        found = first.unionByName(lower.select("g", "at", "kids", path.alias("path"), *said)).unionByName(above.filter("kids is null"))
        above = stage_table(found, f"{name}-paths-{level}")
    return above


def build(rows: DataFrame, order: list[str], fanout: int = FANOUT, name: str = "manifest") -> Manifest:
    """The manifest of rows (g, leaf, ...): one tree for each g over its leaves by order, one tree over the g's by g.

    g is text that sorts as the groups shall and is never null; order columns sort ascending, nulls first. Further columns are carried by the leaves.
    """
    ship(rows.sparkSession)
    leaves = indexed(rows, order, name, fanout)
    dealt = leaves.select("g", "height", "idx", "leaf", "_p").sortWithinPartitions("_p", "g", "idx").drop("_p")
    told = stage_table(dealt.mapInArrow(tidy(stacked(fanout)), _ROW_SQL), f"{name}-stacks")
    levels = told.agg(F.max("height")).first()[0] or 0
    inner, tops = merged(told.filter("not run").drop("run"), levels, name, fanout)
    runs = [told.filter(F.col("run") & (F.col("level") == i)).select("g", "height", "at", F.col("h").alias("kids")).unionByName(r) for i, r in enumerate(inner)]
    # one row for each g from here to the root
    tops = stage_table(tops, f"{name}-tops")
    every = Window.partitionBy(F.lit(0))
    ranked = tops.select(F.col("g").alias("_g"), F.col("subroot").alias("h"), (F.row_number().over(every.orderBy("g")) - 1).cast("long").alias("at"), F.count("*").over(every).alias("_n"))
    ranked = stage_table(ranked.select("_g", F.lit("").alias("g"), levels_of(F.col("_n"), fanout).alias("height"), F.lit(0).alias("level"), "at", "h"), f"{name}-groups")
    above = ranked.agg(F.max("height")).first()[0] or 0
    upper, root = merged(ranked.drop("_g"), above, f"{name}-root", fanout)
    root = root.select("g", "height", F.col("subroot").alias("root")).withColumns({"subroot": F.lit(None).cast("string"), "path": F.array().cast(_PATH)})
    up = paths(upper, root, f"{name}-root", fanout)
    both = ranked.withColumn("_up", F.expr(f"at div {fanout}")).join(up.select(F.col("at").alias("_up"), "kids", "path", "root"), "_up")
    path = F.when(F.col("kids").isNull(), F.col("path")).otherwise(F.concat(F.array(sides(F.col("kids"), F.col("at"), fanout)), F.col("path")))
    proved = both.select(F.col("_g").alias("g"), path.alias("path"), "root")
    return Manifest(leaves, runs, stage_table(tops.join(proved, "g"), f"{name}-proved"), fanout)


def proofs(made: Manifest) -> DataFrame:
    """Every leaf with its path (left and right siblings of each level, from the leaf up), subroot and root, beside the columns carried.

    Leaves meet the row of their run, so that the digests above are stored once for a run.
    """
    up = paths(made.runs, made.tops, "manifest", made.fanout)
    leaves = made.leaves.withColumn("at", F.expr(f"idx div {made.fanout}"))
    kids = F.col("kids")
    path = F.when(kids.isNull(), F.col("path")).otherwise(F.concat(F.array(sides(kids, F.col("idx"), made.fanout)), F.col("path")))
    return leaves.join(up, ["g", "at"]).withColumn("path", path).drop("kids", "at", "_p")


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))


def group_key(value: Column) -> Column:
    """Text that sorts as the value does by its UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def document_proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang", now: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs: key, leaf, today (the leaf of the row as it is now), path, subroot, root.

    now gives columns of docs other values for `today`: what a later reader finds in place of what was hashed. Both leaves come from one
    scan; texts are neither shuffled nor seen by Python. Nulls in any column are hashed as such; rows with a null key come first in their
    group, by leaf; repeated keys stand by leaf, and equal rows are leaves of their own. A null group is a group of its own and comes first.
    Long texts are hashed whole. Other columns are not read, whatever their names. An empty table has no rows.
    """
    told = leaf_hash(*[F.col(c) for c in columns])
    today = leaf_hash(*[(now or {}).get(c, F.col(c)) for c in columns]) if now else told
    rows = docs.select(group_key(F.col(group)).alias("g"), F.col(key).alias("k"), told.alias("leaf"), today.alias("today"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("today", F.when(F.col("today") != F.col("leaf"), F.col("today")))
    made = build(stage_table(rows, "manifest-leaves"), ["k", "leaf", "_row"], fanout)
    return proofs(made).select(F.col("k").alias(key), "leaf", F.coalesce("today", "leaf").alias("today"), "path", "subroot", "root")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded again for a third of them with a text in lower case. Edge cases: see document_proofs()."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = document_proofs(table(spark, sf_dir, "documents"), now={"text": text})
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.col("today")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of the text x in SQL, by its table of 256 remainders, which the rule makes.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: xor(c // 2, (c % 2) * 3988292384))) AS t)"
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode({x}))), 2), lambda i: ('0x' || substr(hex(encode({x})), i, 2))::BIGINT)),
  lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::INT])), 4294967295::BIGINT)"""



_VALUE = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"

OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(text="text")} AS leaf,
        {_LEAF.format(text="translate(text, '" + UPPER + "', '" + LOWER + "')")} AS low, {CRC.format(x="doc_id::VARCHAR")} % 3 = 0 AS chosen FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
n(g, level, i, h, many) AS (
  SELECT g, 0, idx, leaf, count(*) OVER (PARTITION BY g) FROM o
  UNION ALL
  SELECT g, any_value(level) + 1, i // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)), (any_value(many) + {FANOUT - 1}) // {FANOUT} FROM n WHERE many > 1 GROUP BY g, i // {FANOUT}),
s AS (SELECT g, h AS subroot FROM n WHERE many = 1),
u(level, i, h, many) AS (
  SELECT 0, row_number() OVER (ORDER BY g) - 1, subroot, count(*) OVER () FROM s
  UNION ALL
  SELECT any_value(level) + 1, i // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)), (any_value(many) + {FANOUT - 1}) // {FANOUT} FROM u WHERE many > 1 GROUP BY i // {FANOUT}),
a AS (SELECT g, level, i, h, false AS top FROM n WHERE many > 1 UNION ALL SELECT '', level, i, h, true FROM u WHERE many > 1),
k AS (SELECT top, g, level, i, h, string_agg(h, '') OVER (PARTITION BY top, g, level, i // {FANOUT} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
        string_agg(h, '') OVER (PARTITION BY top, g, level, i // {FANOUT} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM a),
e AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM s),
p AS (SELECT o.g, o.idx, k.top, k.level, coalesce(k.l, '') AS l, coalesce(k.r, '') AS r FROM o JOIN k ON NOT k.top AND k.g = o.g AND k.i = o.idx // ({FANOUT} ** k.level)::BIGINT
  UNION ALL SELECT o.g, o.idx, k.top, k.level, coalesce(k.l, ''), coalesce(k.r, '') FROM o JOIN e USING (g) JOIN k ON k.top AND k.i = e.i // ({FANOUT} ** k.level)::BIGINT),
q AS (SELECT g, idx, list({{'l': l, 'r': r}} ORDER BY top, level) AS path FROM p GROUP BY g, idx),
f AS (SELECT o.doc_id, o.leaf, s.subroot, (SELECT h FROM u WHERE many = 1) AS root, coalesce(q.path, []) AS path, CASE WHEN chosen THEN low ELSE leaf END AS today
  FROM o JOIN s USING (g) LEFT JOIN q USING (g, idx)),
v AS (SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda x: x.l || x.r)), 'string_agg', '')) AS proof_sha256,
  (list_reduce(list_prepend({{'l': '', 'r': '', 'h': today}}, list_transform(path, lambda x: {{'l': x.l, 'r': x.r, 'h': ''}})),
    lambda x, y: {{'l': '', 'r': '', 'h': sha256(y.l || x.h || y.r)}})).h AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM v
"""
