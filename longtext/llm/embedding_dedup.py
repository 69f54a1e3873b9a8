"""Embedding near-duplicates by epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longtext.operators.components import connected_components

from .common import ship, stage_table, table

COSINE = 0.9
#: Vectors that the principal directions are fitted on, at most: those with the least hash. They steer the order only.
SAMPLE = 4096
#: Leading principal directions that make the grid.
GRID = 4
#: Vectors in a block of the sequence, and intervals that one interval of the next level joins.
BLOCK, FAN = 1024, 8
#: Neighbouring blocks that meet others together, at most, and bytes of their vectors, about; a table has PARTS such groups at least, where it has as many blocks.
GROUP, GROUP_BYTES, PARTS = 32, 16 << 20, 8


def usable(e: Column) -> Column:
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def unit(rows: pa.Array) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in rows.to_pylist()])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(classes: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Orthogonal bases by dimension, leading directions first, from a bounded sample."""
    rows = classes.orderBy(F.xxhash64("c"), "c").limit(sample).select("dim", "e").toPandas()
    made = {}
    for dim, e in rows.groupby("dim")["e"]:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in e])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x -= x.mean(axis=0)
        made[int(dim)] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return made


def sequence(classes: DataFrame, bases, epsilon: float, block: int) -> DataFrame:
    """Classes in epsilon grid order, cut into blocks: (dim, blk, c, m, x), x the unit vector as bytes of doubles in principal directions.

    The order is by dimension, then by the cells of width epsilon on the leading directions, then by the
    first coordinate, so that ranges stay even where one cell is full. Ranges come from a sample of the order.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(0).to_pylist()
            frame = pd.DataFrame({"dim": dims, "i": range(len(dims))})
            for dim, g in frame.groupby("dim"):
                at = pa.array(g["i"].to_numpy())
                x = unit(batch.column(3).take(at))
                basis = bases.value.get(int(dim))
                y = x if basis is None else x @ basis
                cells = np.floor(y[:, :GRID] / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        batch.column(2).take(at),
                        pa.array(cells.tolist(), pa.list_(pa.int32())),
                        pa.array(y[:, 0]),
                        pa.array([v.tobytes() for v in y], pa.binary()),
                    ],
                    names=["dim", "c", "m", "cell", "y0", "x"],
                )

    placed = classes.select("dim", "c", "m", "e").mapInArrow(place, "dim int, c long, m long, cell array<int>, y0 double, x binary")
    placed = stage_table(placed, "ego-placed")
    n = placed.count()
    ordered = placed.repartitionByRange(max(1, min(4096, -(-n // (4 * block)))), "dim", "cell", "y0", "c").sortWithinPartitions("dim", "cell", "y0", "c")
    ordered = ordered.withColumn("blk", F.monotonically_increasing_id())
    # the id's upper bits name the range, its lower 33 the row in it
    return stage_table(ordered.select("dim", F.expr(f"(blk >> 33) * 1048576 + (blk & 8589934591) div {block}").alias("blk"), "c", "m", "x"), "ego-sequence")


def boxes(rows: DataFrame) -> DataFrame:
    """(dim, blk, lo, hi): the bounding box of each block in all directions."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            frame = batch.to_pandas()
            for key, g in frame.groupby(["dim", "blk"]):
                x = np.stack([np.frombuffer(v, np.float64) for v in g["x"]])
                lo, hi = x.min(axis=0), x.max(axis=0)
                if key in held:
                    lo, hi = np.minimum(lo, held[key][0]), np.maximum(hi, held[key][1])
                held[key] = lo, hi
        if held:
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in held], pa.int32()),
                    pa.array([k[1] for k in held], pa.int64()),
                    pa.array([v[0].tolist() for v in held.values()], kind),
                    pa.array([v[1].tolist() for v in held.values()], kind),
                ],
                names=["dim", "blk", "lo", "hi"],
            )

    parts = rows.select("dim", "blk", "x").mapInArrow(bound, "dim int, blk long, lo array<double>, hi array<double>")
    return parts.groupBy("dim", "blk").agg(merged("lo", "least").alias("lo"), merged("hi", "greatest").alias("hi"))


def merged(column: str, how: str) -> Column:
    pick = F.least if how == "least" else F.greatest
    return F.aggregate(
        F.collect_list(column), F.lit(None).cast("array<double>"), lambda a, x: F.when(a.isNull(), x).otherwise(F.zip_with(a, x, lambda p, q: pick(p, q)))
    )


def block_pairs(found: DataFrame, epsilon: float) -> DataFrame:
    """(dim, i, j, ki, kj), ki <= kj: the pairs of blocks that are not provably distant, by name and by place in the sequence.

    Intervals of FAN neighbours in the sequence form the next level. From the top level down, each pair of
    intervals whose boxes are farther apart than epsilon ends there; the others give their parts' pairs.
    """
    levels = [stage_table(numbered(found), "ego-boxes")]
    while (levels[-1].groupBy("dim").count().agg(F.max("count")).first()[0] or 0) > FAN:
        up = levels[-1].groupBy("dim", F.floor(F.col("k") / FAN).cast("long").alias("k"))
        levels.append(stage_table(up.agg(merged("lo", "least").alias("lo"), merged("hi", "greatest").alias("hi")), "ego-boxes"))
    pairs = None
    for level in reversed(levels):
        a = level.select("dim", F.col("k").alias("i"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
        b = level.select(F.col("dim").alias("dim_b"), F.col("k").alias("j"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        if pairs is None:  # at most FAN intervals of each dimension
            met = a.join(b, (F.col("dim") == F.col("dim_b")) & (F.col("i") <= F.col("j")))
        else:
            up = pairs.select(F.col("dim").alias("dim_u"), F.col("i").alias("iu"), F.col("j").alias("ju"))
            met = a.join(up, (F.col("dim") == F.col("dim_u")) & (F.floor(F.col("i") / FAN) == F.col("iu")))
            met = met.join(b, (F.col("dim") == F.col("dim_b")) & (F.floor(F.col("j") / FAN) == F.col("ju")) & (F.col("i") <= F.col("j")))
        gap = F.zip_with(F.zip_with("la", "hb", lambda p, q: p - q), F.zip_with("lb", "ha", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
        far = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
        pairs = met.filter(far <= (epsilon + 1e-6) ** 2).select("dim", "i", "j")
    names = levels[0].select("dim", "k", "blk")
    i, j = names.select("dim", F.col("k").alias("i"), F.col("blk").alias("bi")), names.select("dim", F.col("k").alias("j"), F.col("blk").alias("bj"))
    return pairs.join(i, ["dim", "i"]).join(j, ["dim", "j"]).select("dim", F.col("bi").alias("i"), F.col("bj").alias("j"), F.col("i").alias("ki"), F.col("j").alias("kj"))


def numbered(found: DataFrame, parts: int = 64) -> DataFrame:
    """Add k, the place of each block in the sequence: places inside ranges plus the blocks of the ranges before."""
    ranged = stage_table(found.repartitionByRange(parts, "dim", "blk").withColumn("_p", F.spark_partition_id()), "ego-ranges")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("dim", "blk"))
    return ranged.withColumn("_r", inside).join(before, "_p").withColumn("k", F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before")


def forest(mask: np.ndarray, same: bool) -> np.ndarray:
    """For rows then columns of a link matrix: the least index reachable, by repeated minima."""
    n, m = mask.shape
    label = np.arange(n + m)
    if same:
        label[n:] = label[:n]
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    part = mask[np.ix_(rows, cols)]
    while len(rows):
        left = np.minimum(label[rows], np.where(part, label[n + cols][None, :], n + m).min(axis=1))
        right = np.minimum(label[n + cols], np.where(part, left[:, None], n + m).min(axis=0))
        if (left == label[rows]).all() and (right == label[n + cols]).all():
            break
        label[rows], label[n + cols] = left, right
        if same:
            label[:n] = label[n:] = np.minimum(label[:n], label[n:])
    return label


def linked(rows: DataFrame, pairs: DataFrame, cosine: float, group: int | None = None) -> DataFrame:
    """(c, k, root): for each class with links in a pair of groups of blocks, the vectors linked there and a class of its part; never the pairs themselves.

    `group` neighbouring blocks travel together: a task gets two groups and compares their pairs of blocks that are not
    provably distant, so a vector is sent once for each group that it meets, and not for each block.
    """
    pairs = stage_table(pairs, "ego-pairs")
    data = rows.select("dim", "blk", "c", "m", "x")
    if group is None:
        most, dim = pairs.agg(F.max("kj"), F.max("dim")).first()
        group = max(1, min(GROUP, GROUP_BYTES // (8 * BLOCK * (dim or 1)), -(-((most or 0) + 1) // PARTS)))
    cells = pairs.withColumns({"gi": F.floor(F.col("ki") / group), "gj": F.floor(F.col("kj") / group)})
    sides = cells.select("dim", "gi", "gj", F.explode(F.array("i", "j")).alias("blk")).distinct()
    sides = stage_table(sides, "ego-sides")

    def meet(key: tuple, frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        held, found = {}, [pd.DataFrame({"c": [], "k": [], "root": []}, dtype=np.int64)]
        for blk, g in frame.groupby("blk"):
            x = np.frombuffer(b"".join(g["x"]), np.float64).reshape(len(g), -1)
            held[blk] = x, x.astype(np.float32), g["c"].to_numpy(), g["m"].to_numpy()
        del frame
        for i, j in zip(wanted["i"], wanted["j"], strict=True):
            (x, x32, a, am), (y, y32, b, bm) = held[i], held[j]
            rough = x32 @ y32.T
            if i == j:
                np.fill_diagonal(rough, -2)
            if rough.max() < cosine - 1e-6 * (x.shape[1] + 10):  # rounding of singles; what may link is computed in doubles
                continue
            mask = x @ y.T >= cosine
            if i == j:
                np.fill_diagonal(mask, False)
            if not mask.any():
                continue
            label, names = forest(mask, i == j), np.concatenate([a, b])
            many = np.concatenate([mask @ bm, [] if i == j else am @ mask]).astype(np.int64)
            pick = np.flatnonzero(many > 0)
            found.append(pd.DataFrame({"c": names[pick], "k": many[pick], "root": names[label[pick]]}))
        return pd.concat(found).groupby(["c", "root"], as_index=False)["k"].sum()[["c", "k", "root"]]

    by = ["dim", "gi", "gj"]
    return data.join(sides, ["dim", "blk"]).groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(meet, "c long, k long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: key, n_links, component_id, kept.

    Unit vectors with cosine c are sqrt(2 - 2c) apart, so links are neighbours within epsilon. Vectors are
    turned to principal directions, sorted by the cells of an epsilon grid on the leading ones, cut into
    blocks, and intervals of the sequence are joined recursively, leaving out those whose boxes are
    provably farther apart; blocks that remain are compared in full, in doubles where singles leave a doubt, so no link is
    lost. Blocks travel in groups (see linked), so each vector is sent once for each group that it meets.
    Equal vectors are one class with a multiplicity: copies cost one comparison and links are counted by
    multiplicity, never listed. Each pair of blocks gives at most one row per class.

    Null or zero vectors and those with null or non-finite components link with nothing. Vectors of
    different lengths never link. Repeated rows count as copies of each other. Empty input: no rows.
    """
    ship(vectors.sparkSession)
    e = F.col(f"`{column}`")
    rows = vectors.select(F.col(f"`{key}`").alias("id"), e.alias("e")).withColumn("c", F.when(usable(F.col("e")), F.xxhash64("e")))
    classes = rows.filter("c is not null").groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("m"), F.first("e").alias("e"))
    classes = stage_table(classes.withColumn("dim", F.size("e")), "ego-classes")
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    bases = vectors.sparkSession.sparkContext.broadcast(principal(classes, SAMPLE))
    placed = sequence(classes, bases, max(epsilon, 1e-9), block)
    met = stage_table(linked(placed, block_pairs(boxes(placed), epsilon), cosine), "ego-links")
    labels = connected_components(met, "c", "root", stage_table)
    counts = met.groupBy("c").agg(F.sum("k").alias("k"))
    known = classes.select("c", "least", "m").join(counts, "c", "left").join(labels.withColumnRenamed("node", "c"), "c", "left")
    known = known.withColumn("component", F.coalesce("component", "c"))
    roots = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(roots, "component").select("c", (F.col("m") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "c").join(known, "c", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(vec_id, c) AS (SELECT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(m.c, v.vec_id) AS component_id, coalesce(m.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN m ON m.vec_id = v.vec_id
"""
