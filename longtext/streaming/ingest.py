"""Incremental ingest: files that arrive in a folder, processed once each, restartable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from longtext.sources.store import append


def ingest(spark: SparkSession, folder: str, schema: StructType | str, out: str, checkpoint: str, key: str = "id", transform: Callable[[DataFrame], DataFrame] | None = None, kind: str = "parquet") -> int:
    """Process every file of the folder that the checkpoint has not seen, append rows with new keys to out, and return their number.

    Each micro-batch is appended by key, so a batch that is run again after a failure adds nothing twice.
    """
    added = 0

    def write(batch: DataFrame, _: int) -> None:
        nonlocal added
        added += append(transform(batch) if transform else batch, out, key)

    stream = spark.readStream.schema(schema).format(kind).load(folder)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return added
