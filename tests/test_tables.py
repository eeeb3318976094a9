from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from trawlwork.operators import cache as C
from trawlwork.operators import places as P
from trawlwork.plans.lineage import scratch_path, shared_dir
from trawlwork.plans.skew import hot_keys, lookup_join
from trawlwork.sources import tables as T
from trawlwork.streaming import streams

ROWS = "key string, value double, updated_at timestamp"


def at(day):
    return datetime(2024, 1, day)


def cache_of(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("key_hash", C.cache_key(F.col("key"))).select(
        "key_hash", "key", "value", "updated_at"
    )


def values(df):
    return {r.key: r.value for r in df.collect()}


def test_upsert_and_report(spark):
    cache = cache_of(spark, [("a", 1.0, at(1)), ("b", 2.0, at(1))])
    new = spark.createDataFrame([("a", 5.0, at(2)), ("c", 7.0, at(2)), ("c", 8.0, at(3))], ROWS)
    assert values(C.cache_upsert(cache, new)) == {"a": 5.0, "b": 2.0, "c": 8.0}
    assert values(C.cache_upsert(cache, new, enabled=False)) == {"a": 1.0, "b": 2.0}
    report = {r.key: r.overwrites for r in C.cache_overwrite_report(cache, new).collect()}
    assert report == {"a": 1, "c": 1}


def test_lookup_and_read_through(spark):
    cache = cache_of(spark, [("a", 1.0, at(1))])
    asked = spark.createDataFrame([("a",), ("a",), ("x",)], "key string")
    assert sorted((r.key, r.value) for r in C.cache_lookup(asked, cache).collect() if r.value) == [("a", 1.0)] * 2
    assert {r.value for r in C.cache_lookup(asked, cache, enabled=False).collect()} == {None}
    compute = lambda m: m.select("key", F.lit(9.0).alias("value"))
    known, fresh = C.cache_read_through(asked, cache, compute)
    assert (values(known), values(fresh)) == ({"a": 1.0}, {"x": 9.0})
    known, fresh = C.cache_read_through(asked, cache, compute, enabled=False)
    assert (values(known), values(fresh)) == ({}, {"a": 9.0, "x": 9.0})


def test_keys(column):
    import hashlib

    assert column(C.cache_key, ["abc"]) == [hashlib.md5(b"abc").hexdigest()]
    pair = column(C.cache_key, [("a", None), (None, "a")], "x string, y string")
    assert pair[0] != pair[1]


def test_batches_replay_and_compaction(spark, tmp_path):
    path = str(tmp_path / "table")
    C.write_cache_batch(spark.createDataFrame([("a", 1.0, at(1)), ("b", 2.0, at(1))], ROWS), path, 0)
    second = spark.createDataFrame([("a", 3.0, at(2)), ("a", 4.0, at(2)), ("c", 5.0, at(1))], ROWS)
    ordered = second.withColumn("n", F.col("value"))
    for _ in range(2):
        C.write_cache_batch(ordered, path, 1, ["updated_at", "n"])
    assert values(C.read_cache(spark, path, "double")) == {"a": 4.0, "b": 2.0, "c": 5.0}
    C.compact_cache(spark, path, "double", str(tmp_path / "packed"))
    assert values(C.read_cache(spark, str(tmp_path / "packed"), "double")) == {"a": 4.0, "b": 2.0, "c": 5.0}


def test_hit_report(spark):
    asked = spark.createDataFrame([("n", "a"), ("n", "a"), ("n", "x"), ("m", "a")], "namespace string, key string")
    caches = spark.createDataFrame([("n", "a")], "namespace string, key string")
    caches = caches.select("namespace", C.cache_key(F.col("key")).alias("key_hash"))
    got = {r.namespace: (r.hits, r.misses, r.distinct_keys) for r in C.cache_hit_report(asked, caches).collect()}
    assert got == {"n": (2, 1, 2), "m": (0, 1, 1)}


def test_hot_keys_join_like_any_other(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), "id")
    wide = F.when(F.col("k") == "7", F.repeat(F.lit("w"), 10_000)).otherwise(F.lit("n"))
    right = spark.range(60).select(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")).withColumn("v", wide)
    assert [r.k for r in hot_keys(left, ["k"], 500).collect()] == ["hot"]
    for how in ("left", "inner"):
        plain = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
        for rows in (500, 10, 10**9):
            assert sorted(map(tuple, lookup_join(left, right, ["k"], how, rows).collect()), key=str) == plain


def test_the_session_names_the_shared_folder(spark):
    def session(master, **conf):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)),
            sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
        )

    named = session("spark://m", spark_checkpoint_dir="hdfs://shared/dir/")
    assert shared_dir(named) == "hdfs://shared/dir"
    assert scratch_path(named, "x").startswith("hdfs://shared/dir/app-1/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://m"))
    assert shared_dir(spark) == shared_dir(spark)


def test_places_responses(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"searched_type":"bar","results":[{"place_id":"1","name":"A","geometry":{"location":{"lat":1.5,"lng":2}},"types":["bar"]},'
        '{"place_id":"2","name":"B"}]}\n{"searched_type":"food","status":"ZERO"}\n'
    )
    got = [tuple(r) for r in T.read_places(spark, str(tmp_path)).orderBy("place_id").collect()]
    assert got == [("bar", "1", "A", 1.5, 2.0, ["bar"]), ("bar", "2", "B", None, None, None)]


def test_ranked_csv(spark, tmp_path):
    rows = [("a, \"x\"", 0.1, {"n": 0.5}), ("b", 0.9, {"n": 1.0}), ("c", None, None)]
    results = spark.createDataFrame(rows, "scraped_item string, combined_score double, attribute_scores map<string,double>")
    out = str(tmp_path / "csv")
    assert T.write_ranked_results(results, out)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*"))).splitlines()
    body = [x for x in lines if not x.startswith("scraped_item")]
    assert lines[0] == "scraped_item,combined_score,attribute_scores"
    assert body == ['b,0.9,"{""n"":1.0}"', '"a, ""x""",0.1,"{""n"":0.5}"', "c,,"]
    assert not T.write_ranked_results(results.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


PLACES = "place_id string, name string, lat double, lon double, types array<string>"


def test_nearby(spark):
    # One degree of latitude is 111,195 m on this sphere.
    rows = [
        ("in", "Borsch Bar", 29.85, -95.37, ["bar", "food"]),
        ("edge", "Edge", 29.76 + 16092 / 111195.08, -95.37, ["food"]),
        ("out", "Far", 29.76 + 16094 / 111195.08, -95.37, ["food"]),
        ("type", "None", 29.76, -95.37, ["shop"]),
        ("null", "Null", None, -95.37, ["food"]),
    ]
    places = spark.createDataFrame(rows, PLACES)
    near = P.places_nearby(places, 29.76, -95.37, ["food", "bar"])
    assert sorted((r.place_id, r.searched_type) for r in near.collect()) == [("edge", "food"), ("in", "bar"), ("in", "food")]
    once = P.places_nearby(places, 29.76, -95.37, ["bar", "food"], dedupe=True, keyword="BORSCH")
    assert [(r.place_id, r.searched_type) for r in once.collect()] == [("in", "bar")]


def test_place_sites(spark):
    places = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "place_id string")
    details = spark.createDataFrame([("a", "g1"), ("b", "g2")], "place_id string, google_url string")
    link = '<a data-item-id="menu" data-tooltip="Open menu link" href="http://s/">'
    listings = spark.createDataFrame([("g1", link), ("g2", "<p>")], "google_url string, html string")
    found, dropped = P.place_sites(places, details, listings)
    assert sorted((r.place_id, r.establishment_url) for r in found.collect()) == [("a", "http://s/")] * 2
    assert sorted(r.place_id for r in dropped.collect()) == ["b", "c"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "key string, value double, ts timestamp_ntz"
    spark.createDataFrame([("a", 1.0, at(1)), ("a", 2.0, at(2)), ("b", 3.0, at(1))], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    admitted = streams.stream_visited_dedup(stream, "key", "ts", "10 days").select("key")
    streams.write_stream(admitted, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]

    def upsert():
        rows = spark.readStream.schema(schema).parquet(source).select(
            "key", "value", F.col("ts").cast("timestamp").alias("updated_at")
        )
        streams.stream_cache_upsert(rows, str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination()
        return values(C.read_cache(spark, str(tmp_path / "t"), "double"))

    assert upsert() == {"a": 2.0, "b": 3.0}
    spark.createDataFrame([("b", 9.0, at(3)), ("c", 4.0, at(1))], schema).write.mode("append").parquet(source)
    assert upsert() == {"a": 2.0, "b": 9.0, "c": 4.0}
    assert upsert() == {"a": 2.0, "b": 9.0, "c": 4.0}
