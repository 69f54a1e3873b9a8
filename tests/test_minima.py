"""Minhash bands: the Arrow function equals Spark's own seeded hashes."""

import pytest
from pyspark.sql import functions as F

from longtext.operators import dedupe


def by_expressions(parts, bands, rows):
    seeds = F.sequence(F.lit(0), F.lit(bands * rows - 1))
    minima = F.transform(seeds, lambda s: F.array_min(F.transform(parts, lambda x: F.xxhash64(F.xxhash64(x), s))))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(minima, b * rows + 1, rows)))


def test_bands_equal_those_of_expressions(spark):
    rows = [(i, [f"p{j * (i + 1) % 91}" for j in range(i * 7 % 60)]) for i in range(80)] + [(80, []), (81, ["é"])]
    df = spark.createDataFrame(rows, "id long, parts array<string>").repartition(3)
    got = {r.id: (r.x, r.y) for r in df.select("id", dedupe.band_keys(F.transform("parts", lambda x: F.xxhash64(x)), 4, 3).alias("x"), by_expressions(F.col("parts"), 4, 3).alias("y")).collect()}
    assert len(got) == 82 and all(x == y for x, y in got.values())


@pytest.mark.parametrize("most", [1, 50])
def test_bands_in_pieces(spark, most):
    df = spark.createDataFrame([(i, [f"{j * 7919}" for j in range(i)]) for i in range(30)], "id long, parts array<string>").coalesce(1)
    made = df.select("id", dedupe.bands_function(3, 2, most)(F.transform("parts", lambda x: F.xxhash64(x))).alias("x"), by_expressions(F.col("parts"), 3, 2).alias("y"))
    assert all(r.x == (r.y if r.id else None) for r in made.collect())


def test_bands_hash_no_set_for_every_seed_in_expressions(spark):
    """128 seeds over every shingle are one pass of numpy, not an interpreted lambda for each."""
    plan = spark.range(1).select(dedupe.band_keys(F.array(F.lit(1).cast("long"))).alias("k"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "array_min" not in plan
