"""What one task of a merge or of an index writes does not grow with the table."""

import glob

from longtext.operators import index
from longtext.sources.versions import VersionedTable


def test_a_partition_of_a_serving_table_is_written_by_several_tasks(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ("id",), 2, slice=4000)
    rows = spark.range(3000).selectExpr("cast(id as string) id", "sha2(cast(id as string), 256) text")
    table.upsert(rows)
    table.upsert(rows.filter("id % 3 = 0").selectExpr("id", "'new' text"))
    table.delete(rows.filter("id % 7 = 1").select("id"))
    files = glob.glob(f"{tmp_path}/t/data/*/_b=0/*.parquet")
    assert len(files) > 3 * 3
    got = {r.id: r.text for r in table.read().collect()}
    assert set(got) == {str(i) for i in range(3000) if i % 7 != 1} and all((v == "new") == (int(k) % 3 == 0) for k, v in got.items())


def test_a_folder_of_an_index_is_written_by_several_tasks(spark, tmp_path):
    made = index.TextIndex(spark, str(tmp_path / "i"), 1, part=10)
    made.append(spark.range(1000).selectExpr("id", "concat('word', id % 7) text"))
    made.append(spark.range(0, 1000, 5).selectExpr("id", "'zebra' text"))
    made.merge(2)
    assert sorted(r.id for r in made.search("word3").collect()) == [i for i in range(1000) if i % 7 == 3 and i % 5]
    folder = sorted(glob.glob(f"{tmp_path}/i/segments/*/lists/b=0"), key=lambda f: len(glob.glob(f"{f}/*.parquet")))
    assert len(glob.glob(f"{folder[-1]}/*.parquet")) >= 3
