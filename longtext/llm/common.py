"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        local = sc.master.startswith("local[") or sc.master == "local"
        base = tempfile.mkdtemp(prefix="longtext-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_longtext"
        sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/longtext-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch that goes to a Python function: long texts make batches of few rows.
BATCH_LIMIT = 16 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors where their PYTHONPATH does not have it, and bound Arrow batches where the session does not."""
    import shutil

    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(batch, str(2**31 - 1)) == str(2**31 - 1):
        spark.conf.set(batch, str(BATCH_LIMIT))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_longtext_sent", False):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "longtext"), "zip", root, "longtext")
    spark.sparkContext.addPyFile(made)
    spark.sparkContext._longtext_sent = True


def give_back() -> None:
    """In a Python worker: return freed memory to the system, so that idle workers hold little between stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # not glibc
        pass


def tidy(run):
    """run, an iterator function over Arrow batches, which gives memory back when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run):
    """run, a function of a key and its group, which gives memory back after each group."""

    def wrapped(key, rows):
        try:
            return run(key, rows)
        finally:
            give_back()

    return wrapped


def carried(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct column _in beside the named columns, so that no name of the caller's can clash with an internal one."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), *[v.alias(k) for k, v in more.items()])


def returned(columns: list[str], **new: Column) -> list[Column]:
    """The caller's columns out of _in, some with new values."""
    return [new.get(c, F.col("_in")[c]).alias(c) for c in columns]


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on, how: str, rows: int = 200_000) -> DataFrame:
    """Join that broadcasts the second side only where its counted rows are within a bound."""
    return big.join(F.broadcast(small) if small_enough(small, rows) else small, on, how)


def cumulative(lengths: Column) -> Column:
    """Exclusive running sums of an array of ints, as an array; blocks of 32 keep the copies that appending makes short."""
    inner = lambda part, base: F.aggregate(
        part,
        F.struct(base.alias("o"), F.array().cast("array<int>").alias("a")),
        lambda s, x: F.struct((s["o"] + x).alias("o"), F.concat(s["a"], F.array(s["o"])).alias("a")),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 32).cast("int")), lambda b: F.slice(lengths, b * 32 + 1, 32))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(
        F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("o"), F.array().cast("array<array<int>>").alias("a")),
            lambda s, part: F.transform(
                F.array(inner(part, s["o"])), lambda r: F.struct(r["o"].alias("o"), F.concat(s["a"], F.array(r["a"])).alias("a"))
            )[0],
            lambda s: F.flatten(s["a"]),
        )
    )


def match_spans(df: DataFrame, text: str, patterns: dict[str, str | Column]) -> DataFrame:
    """Add for each name an array of structs (s, e, m): start, end (code points, end exclusive) and text of every leftmost non-overlapping match.

    The text between matches (split) and the matches alternate, so starts are running sums of
    their lengths. Texts without a match are scanned once.
    """
    def lengths(k: str) -> Column:
        gap = F.col(f"{k}_g")
        return F.transform(F.col(f"{k}_m"), lambda m, i: F.length(m) + F.length(gap[i + 1]))

    def spans(k: str) -> Column:
        start = lambda i: F.col(f"{k}_c")[i] + F.length(F.col(f"{k}_g")[0])
        return F.transform(F.col(f"{k}_m"), lambda m, i: F.struct(start(i).alias("s"), (start(i) + F.length(m)).alias("e"), m.alias("m")))

    some = {k: F.size(f"{k}_m") > 0 for k in patterns}
    found = df.withColumns({f"{k}_m": F.regexp_extract_all(F.col(text), p if isinstance(p, Column) else F.lit(p), F.lit(0)) for k, p in patterns.items()})
    gaps = found.withColumns({f"{k}_g": F.when(some[k], F.split(F.col(text), p, -1)) for k, p in patterns.items()})
    steps = gaps.withColumns({f"{k}_l": F.when(some[k], lengths(k)) for k in patterns})
    starts = steps.withColumns({f"{k}_c": F.when(some[k], cumulative(F.col(f"{k}_l"))) for k in patterns})
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    out = starts.withColumns({k: F.when(some[k], spans(k)).otherwise(none) for k in patterns})
    return out.drop(*[f"{k}_{x}" for k in patterns for x in "mglc"])
