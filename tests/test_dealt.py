"""What one task holds where keys compress well."""

from pyspark.sql import functions as F

from longtext.sources import store


def test_new_rows_are_not_merged_into_few_tasks(spark):
    ids = spark.range(100_000).withColumnRenamed("id", "event_id")
    for joined in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
        try:
            found = store.new_rows(ids.union(ids), ids.filter("event_id % 3 = 0"), "event_id")
            held = [r[0] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
            rows = [r[0] for r in found.collect()]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(held) < 20_000
        assert sorted(rows) == [i for i in range(100_000) if i % 3]


def test_new_rows_with_repeats_and_nulls_on_both_sides(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"), (3, "f")], "id long, x string")
    old = spark.createDataFrame([(2,), (2,), (None,)], "id long")
    assert sorted((r.id or 0) for r in store.new_rows(batch, old).collect()) == [0, 1, 3]
