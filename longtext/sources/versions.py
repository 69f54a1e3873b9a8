"""Serving tables in versions: keyed merges by copy on write of the partitions they touch, published by one atomic rename."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from longtext.sources.store import latest


#: Bytes of stored rows that one task of a merge writes, about.
SLICE = 64 << 20


#: Bytes of a stored batch up to which Spark may send it to all tasks of a merge.
SENT = 1 << 20


class Conflict(RuntimeError):
    """Another job has published the same version first; nothing of this job is visible."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _bytes(spark: SparkSession, path: str) -> int:
    fs, where = _files(spark, path)
    return fs.getContentSummary(where).getLength()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    fs, folder = _files(spark, f"{root}/_versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def record(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """What the newest version, or the one named, says; None where there is none."""
    found = versions(spark, root)
    if version is None and not found:
        return None
    version = found[-1] if version is None else version
    fs, path = _files(spark, f"{root}/_versions/{version:010d}.json")
    stream = fs.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return json.loads(text) | {"version": version}


def publish(spark: SparkSession, root: str, after: int, told: dict) -> int:
    """Make version after + 1 the newest: its record is written aside, then renamed to a name that must not exist yet."""
    version, jvm = after + 1, spark._jvm
    fs, aside = _files(spark, f"{root}/_aside/{uuid.uuid4().hex}")
    fs.mkdirs(_files(spark, f"{root}/_versions")[1])
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(told).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    place = fs.makeQualified(_files(spark, f"{root}/_versions/{version:010d}.json")[1])
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(aside), place, options)
    except Exception as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version} of {root} exists") from None
        raise
    return version


@dataclass
class VersionedTable:
    """A table of one row per key under `path`, whose rows lie in partitions by a hash of the key.

    A version is a small record: which folder holds each partition. A merge reads and writes the partitions that its batch touches, into new
    folders, and leaves the others where they are; readers of older versions are not disturbed, and a job that dies before the
    rename has changed nothing. Two jobs at once: the later one gets Conflict and may run again. Choose `buckets` so that a
    partition is some hundred MB; the record grows with them, not with the rows. Rows with a null in the key are left out, as are empty strings.
    `by` names the key columns whose hash deals the rows, all by default: rows that agree in them are found together.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64
    by: tuple[str, ...] | None = None
    slice: int = SLICE

    def exists(self) -> bool:
        return bool(versions(self.spark, self.path))

    def _told(self, version: int | None = None) -> dict:
        return record(self.spark, self.path, version) or {"version": 0, "schema": None, "parts": {}, "buckets": self.buckets, "keys": list(self.keys)}

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.by or self.keys]), F.lit(buckets)).cast("int")

    def _rows(self, told: dict, parts: dict) -> DataFrame:
        schema = StructType.fromJson(told["schema"])
        folders = [f"{self.path}/{folder}" for folder in parts.values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the newest version, or of an older one that is kept."""
        told = self._told(version)
        if told["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no version")
        return self._rows(told, told["parts"])

    def touched(self, keys: DataFrame) -> list[str]:
        """Partitions that hold rows with these values of the dealing columns."""
        told = self._told()
        found = keys.select(self._bucket(told["buckets"]).alias("b")).distinct().collect()  # at most one for each partition
        return sorted({str(r.b) for r in found} & set(told["parts"]))

    def lookup(self, keys: DataFrame, send: bool = True) -> DataFrame:
        """Rows whose dealing columns are among these distinct keys; only their partitions are read. send: Spark may send the keys to all tasks."""
        told = self._told()
        if told["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no version")
        rows = self._rows(told, {b: told["parts"][b] for b in self.touched(keys)})
        keys = keys.select(*(self.by or self.keys))
        return rows.join(keys if send else keys.hint("merge"), list(self.by or self.keys), "left_semi")

    def _whole(self) -> Column:
        return reduce(and_, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in self.keys])

    def upsert(self, batch: DataFrame, order: tuple[str, ...] = (), columns: tuple[str, ...] | None = None) -> int:
        """Insert rows with new keys and replace those with known ones; the new version's number.

        Of rows in the batch with the same key the greatest by order counts. With columns, known rows change in these only. Columns that the
        table does not have are added, null in older rows; columns that the batch does not have are null in its new rows
        and kept in known ones.
        """
        rows = latest(batch.filter(self._whole()), list(self.keys), *order)
        return self._merge(rows, columns, remove=False)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows with these keys; the new version's number."""
        return self._merge(keys.filter(self._whole()).select(*self.keys).distinct(), None, remove=True)

    def _merge(self, rows: DataFrame, columns: tuple[str, ...] | None, remove: bool) -> int:
        told = self._told()
        run = f"data/{uuid.uuid4().hex}"
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        rows = rows.withColumn("_b", self._bucket(told["buckets"]))
        rows.write.parquet(staged)
        fs, folder = _files(self.spark, staged)
        try:
            batch = self.spark.read.schema(rows.schema).parquet(staged)
            touched = {str(r[0]) for r in batch.select("_b").distinct().collect()}  # at most one for each partition
            before = {b: f for b, f in told["parts"].items() if b in touched}
            old = self._rows(told, before) if told["schema"] else None
            batch = batch.drop("_b")
            made = self._merged(old, batch if _bytes(self.spark, staged) <= SENT else batch.hint("merge"), columns, remove)
            made = made.withColumn("_b", self._bucket(told["buckets"]))
            # a partition of the table is written by as many tasks as its bytes ask for, each its own file of the folder
            held = sum(_bytes(self.spark, f"{self.path}/{f}") for f in before.values()) + _bytes(self.spark, staged)
            slices = max(1, -(-held // (max(1, len(touched)) * self.slice)))
            part = F.pmod(F.xxhash64(F.lit("slice"), *[F.col(k) for k in self.keys]), F.lit(slices))
            made.repartition(max(1, len(touched)) * slices, "_b", part).write.partitionBy("_b").parquet(f"{self.path}/{run}")
        finally:
            fs.delete(folder, True)
        fs, folder = _files(self.spark, f"{self.path}/{run}")
        written = {s.getPath().getName()[3:]: f"{run}/{s.getPath().getName()}" for s in fs.listStatus(folder) if s.getPath().getName().startswith("_b=")}
        parts = {b: f for b, f in told["parts"].items() if b not in touched} | written
        schema = made.drop("_b").schema.jsonValue()
        return publish(self.spark, self.path, told["version"], {"schema": schema, "parts": parts, "buckets": told["buckets"], "keys": list(self.keys)})

    def _merged(self, old: DataFrame | None, batch: DataFrame, columns: tuple[str, ...] | None, remove: bool) -> DataFrame:
        keys = list(self.keys)
        if old is None:
            return batch.limit(0) if remove else batch
        if remove:
            return old.join(batch, keys, "left_anti")
        both = old.withColumn("_old", F.lit(True)).alias("o").join(batch.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")
        names = [*old.columns, *(c for c in batch.columns if c not in old.columns)]

        def value(c: str) -> Column:
            if c in keys:
                return F.col(c)
            if c not in batch.columns:
                return F.col(f"o.{c}")
            if c not in old.columns:
                return F.col(f"n.{c}")
            new = F.col("_new") if columns is None or c in columns else F.col("_old").isNull()
            return F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

        return both.select(*[value(c).alias(c) for c in names])

    def clean(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the newest `keep` versions names, and the records of the older ones; the folders deleted.

        Not while another job merges: its folders have no version yet.
        """
        found = versions(self.spark, self.path)
        held = {f.rsplit("/", 1)[0] for v in found[-keep:] for f in self._told(v)["parts"].values()}
        for v in found[:-keep]:
            fs, path = _files(self.spark, f"{self.path}/_versions/{v:010d}.json")
            fs.delete(path, False)
        fs, folder = _files(self.spark, f"{self.path}/data")
        gone = []
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            name = f"data/{s.getPath().getName()}"
            if name not in held:
                fs.delete(s.getPath(), True)
                gone.append(name)
        return gone
