"""Keyed tables with commits, and reading through them."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from trawlwork.operators import cache as C


def rows(spark, values, when=None):
    df = spark.createDataFrame([(k, v) for k, v in values], "key string, value double")
    return df if when is None else df.withColumn("updated_at", F.lit(when).cast("timestamp"))


def held(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_commits_are_seen_whole(spark, tmp_path):
    table = C.KeyedTable(spark, str(tmp_path / "t"), "double", buckets=16)
    assert table.version() == (0, []) and held(table.read()) == {} and held(table.lookup(rows(spark, [("a", 0.0)]))) == {}
    table.commit(rows(spark, [("a", 1.0), ("b", 2.0)]))
    before = table.read()  # an open reader
    table.commit(rows(spark, [("a", 5.0), ("c", 3.0)]))
    assert held(before) == {"a": 1.0, "b": 2.0}
    assert held(table.read()) == {"a": 5.0, "b": 2.0, "c": 3.0}
    table.compact()
    assert table.version()[0] == 3 and len(table.version()[1]) == 1 and held(table.read()) == {"a": 5.0, "b": 2.0, "c": 3.0}
    assert held(before) == {"a": 1.0, "b": 2.0}
    with pytest.raises(ValueError):
        C.KeyedTable(spark, str(tmp_path / "t"), "double", buckets=8).read()
    # A second writer that built on the same version fails, and its rows are not seen.
    late = C.KeyedTable(spark, str(tmp_path / "t"), "double", buckets=16)
    with pytest.raises(Exception, match="(?i)exists"):
        late._write(rows(spark, [("z", 9.0)], "2024-01-01").withColumn("key_hash", C.cache_key(F.col("key"))).withColumn("bucket", F.lit(0)), 2, [])
    assert "z" not in held(table.read())


def test_lookup_opens_few_buckets(spark, tmp_path):
    table = C.KeyedTable(spark, str(tmp_path / "t"), "double", buckets=64)
    table.commit(spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("double").alias("value")))
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 100, 10)] + [("none",)], "key string")
    found = table.lookup(keys)
    assert held(found) == {f"k{i}": float(i) for i in range(0, 100, 10)}
    opened = [f for f in found.inputFiles() if "/data/" in f]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1][:200]
    asked = {r[0] for r in keys.withColumn("key_hash", C.cache_key(F.col("key"))).select(table._bucket()).distinct().collect()}
    assert len(asked) <= 11 and len(opened) >= len(asked)


def test_read_through_writes_back(spark, tmp_path):
    table = C.KeyedTable(spark, str(tmp_path / "t"), "double", buckets=4)
    table.commit(rows(spark, [("a", 1.0)]))
    seen = spark.sparkContext.accumulator(0)

    def compute(missing):
        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(value=b["key"].str.len().astype(float))

        return missing.filter(F.col("key") != "fails").mapInPandas(count, "key string, value double")

    requests = spark.createDataFrame([(k,) for k in ("a", "bb", "bb", "ccc", "fails")], "key string")
    seen_hits = Observation()
    first = table.read_through(requests, compute, seen_hits)
    assert held(first) == {"a": 1.0, "bb": 2.0, "ccc": 3.0} and held(first) == held(first)
    assert seen.value == 2 and seen_hits.get == {"requests": 5, "distinct_keys": 4, "hits": 1}
    again = Observation()
    assert held(table.read_through(requests.filter("key <> 'fails'"), compute, again)) == {"a": 1.0, "bb": 2.0, "ccc": 3.0}
    assert seen.value == 2 and again.get == {"requests": 4, "distinct_keys": 3, "hits": 4}
    report = C.cache_hit_report(requests.filter("key <> 'fails'").withColumn("namespace", F.lit("n")), table.read().withColumn("namespace", F.lit("n"))).first()
    assert (report.hits, report.misses, report.distinct_keys) == (4, 0, 3)
