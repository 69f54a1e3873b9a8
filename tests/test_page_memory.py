"""Pages reach a Python worker in batches that are bounded by bytes."""

from longtext.sources import html


def test_batches_of_pages_are_bounded_where_the_session_sets_no_bound(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    pages = spark.createDataFrame([("u", "<html><h1>T</h1><div><p>a</div></html>")], "url string, html string")
    try:
        spark.conf.unset(name)
        html.documents(pages, "archive_3", least=1)
        assert int(spark.conf.get(name)) == html.BATCH_BYTES
        spark.conf.set(name, "1000000")
        html.documents(pages, "archive_3", least=1)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
