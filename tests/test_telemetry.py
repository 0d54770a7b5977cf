"""Rows counted by running queries against counts of the same rows."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import telemetry


def test_rows_observed_by_an_action(spark):
    rows = spark.range(1000).withColumn("v", F.when(F.col("id") % 3 == 0, F.col("id")))
    seen, found = telemetry.observed(rows, "numbers", total=F.sum("v"), largest=F.max("v"))
    assert seen.groupBy().count().first()[0] == 1000
    assert found.get == {"rows": 1000, "total": sum(range(0, 1000, 3)), "largest": 999}


def test_no_rows(spark):
    seen, found = telemetry.observed(spark.range(0), "none")
    assert seen.collect() == [] and found.get == {"rows": 0}


@pytest.fixture
def heard(spark):
    listener = telemetry.StreamMetrics("in", "out")
    spark.streams.addListener(listener)
    yield listener
    spark.streams.removeListener(listener)


def test_batches_of_a_stream_add_up(spark, heard, tmp_path):
    """Several files, one a batch; a second run hears what is new only; series nobody asked for are left out."""

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        seen = stream.observe("in", F.count(F.lit(1)).alias("rows"), F.sum("id").alias("total")).where("id % 2 = 0")
        seen = seen.observe("out", F.count(F.lit(1)).alias("rows")).observe("other", F.count(F.lit(1)).alias("rows"))
        heard.wait(seen.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start(f"{tmp_path}/out"))

    spark.range(0, 30).repartition(3).write.parquet(f"{tmp_path}/in")
    run()
    assert heard.totals == {"in": {"rows": 30, "total": sum(range(30))}, "out": {"rows": 15}}
    spark.range(30, 40).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert heard.totals == {"in": {"rows": 40, "total": sum(range(40))}, "out": {"rows": 20}}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_text_for_scrapers(spark):
    found = {'a"b\\c': {"rows": 3}, "d": {"rows": 4, "words": 9}}
    lines = telemetry.exposition("lodestar", found).splitlines()
    assert lines == [
        "# TYPE lodestar_rows_total counter",
        'lodestar_rows_total{series="a\\"b\\\\c"} 3',
        'lodestar_rows_total{series="d"} 4',
        "# TYPE lodestar_words_total counter",
        'lodestar_words_total{series="d"} 9',
    ]
    assert {tuple(r) for r in telemetry.as_rows(spark, found).collect()} == {('a"b\\c', "rows", 3), ("d", "rows", 4), ("d", "words", 9)}
    assert telemetry.as_rows(spark, {}).collect() == []
