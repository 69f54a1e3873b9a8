"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Edges (two ids each) up to which a step sends the least neighbours to all tasks instead of dealing the edges again.
MOST_SENT = 250_000


def dealt(df: DataFrame) -> DataFrame:
    """df as the side of a join that is dealt out by key: without the hint Spark sends what it takes for small, through the driver, in every step."""
    return df.hint("merge")


def _with_least(edges: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    return edges.join(F.broadcast(least) if small else dealt(least), "u")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both, least, small).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least, small).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(
    edges: DataFrame, a: str, b: str, save: Callable[[DataFrame, str], DataFrame], rounds: int = 60, most: int = MOST_SENT
) -> DataFrame:
    """(node, component) for every node of an edge table: component is the least node reachable.

    save(df, name) writes df to storage that the cluster shares and reads it back, so that each round
    starts from files and lost executors cost one round at most. Every step keeps each node's edges to
    its least neighbour only, with minima combined per task before the shuffle; edges never grow in
    number, and the rounds are logarithmic in the longest path. Edges that already name the least node are
    settled by one round. Up to `most` edges, counted each round, least neighbours are broadcast; beyond, they are
    joined by shuffles and nothing is sent. Self-loops are allowed and nulls ignored. Edge cases: no edges, no rows.
    """
    tag = uuid.uuid4().hex[:8]
    pair = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    loops = pair.filter("u = v").select("u")
    now = save(pair.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"edges-{tag}")
    mark = _state(now)
    for i in range(rounds if mark[0] else 0):
        small = mark[0] <= most
        now = save(_small_star(_large_star(now, small), small), f"stars-{tag}-{i}")
        seen = _state(now)
        if seen == mark:
            break
        mark = seen
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    known = stars.select("u")
    roots = now.select(F.col("v").alias("u")).union(loops).distinct().join(F.broadcast(known) if mark[0] <= most else dealt(known), "u", "left_anti")
    return stars.union(roots.select("u", F.col("u").alias("component"))).withColumnRenamed("u", "node")
