"""Visited URLs of crawls in a stream: once per crawl, again after its end."""

import pytest
from pyspark.sql import functions as F

from trawlwork.streaming import streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, ROCKS)
    yield spark
    spark.conf.set(SETTING, before) if before else spark.conf.unset(SETTING)


def test_visited_until_the_crawl_ends(rocks, tmp_path):
    spark = rocks
    batches = [
        [("c", "a", 1, False), ("c", "a", 2, False), ("c", "b", 3, False), ("d", "a", 1, False)],
        [("c", "a", 4, False), ("d", "b", 5, False), ("c", None, 6, False)],
        [("c", None, 7, True), ("c", "a", 7, False), ("c", "a", 8, False), ("d", "a", 9, False)],
        [("c", "b", 10, False), ("c", "a", 11, False), ("d", None, 12, True)],
        [("d", "a", 13, False), ("c", "a", 14, None)],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "crawl string, url string, seconds int, ends boolean"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("seconds"))
        admitted = streams.stream_visited_by_crawl(stream, "crawl", "url", "ts", "ends", shares=3)
        streams.write_stream(admitted, out, str(tmp_path / "state")).awaitTermination()
    got = sorted((r.crawl, r.url, int(r.ts.timestamp())) for r in spark.read.parquet(out).collect())
    assert got == [("c", "a", 1), ("c", "a", 7), ("c", "b", 3), ("c", "b", 10), ("d", "a", 1), ("d", "a", 13), ("d", "b", 5)]
