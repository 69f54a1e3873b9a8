"""Tables of SQL databases, read and written in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that a fetch brings at once.
FETCH = 10_000


def _options(url: str, driver: str | None, properties: dict[str, str] | None) -> dict[str, str]:
    return {"url": url, "fetchsize": str(FETCH), **({"driver": driver} if driver else {}), **(properties or {})}


def key_bounds(spark: SparkSession, url: str, table: str, key: str, driver: str | None = None, properties: dict[str, str] | None = None) -> tuple:
    """Least and greatest key, and the number of rows, as the database tells them."""
    told = _options(url, driver, properties) | {"query": f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n FROM {table}"}
    return tuple(spark.read.format("jdbc").options(**told).load().first())


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 16, rows_each: int = 1_000_000, driver: str | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A table, or a subquery with an alias, of a database.

    key: a number, date or timestamp column; its range, which the database is asked for, is cut evenly into at most `partitions` scans of about rows_each
    rows at least. Rows with a null key are in the first. Without a key, or where the range is a point, one scan. Filters and the choice of columns
    that follow reach the database, as do its own joins in a subquery.
    """
    told = _options(url, driver, properties) | {"dbtable": table}
    if key:
        lo, hi, n = key_bounds(spark, url, table, key, driver, properties)
        parts = min(partitions, max(1, -(-n // rows_each)))
        if lo is not None and lo != hi and parts > 1:
            told |= {"partitionColumn": key, "lowerBound": str(lo), "upperBound": str(hi), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**told).load()


def save_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", partitions: int = 8, driver: str | None = None, properties: dict[str, str] | None = None) -> None:
    """Write df to a table by at most `partitions` connections; 'overwrite' empties the table and keeps its definition."""
    told = _options(url, driver, properties) | {"dbtable": table, "numPartitions": str(partitions), "batchsize": str(FETCH), "truncate": "true"}
    df.write.format("jdbc").options(**told).mode(mode).save()
