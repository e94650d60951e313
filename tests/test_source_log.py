"""The device log of the queries is written by as many tasks as there are, under one number."""

from axonlake.plans import catalogue
from axonlake.plans.views import log


def test_log_is_written_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a small table would be merged into one task
    try:
        df = catalogue.queries()["source_device_log"](spark, "/root/testdata/sf0.001")
        files = [f for f in df.inputFiles() if "/log/" in f]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(files) == 4
    assert {(int(r["worm"]) % 2, r["file_ord"]) for r in df.select("worm", "file_ord").distinct().collect()} == {(0, 7), (1, 0)}
    assert df.count() == log(spark, "/root/testdata/sf0.001").count()
