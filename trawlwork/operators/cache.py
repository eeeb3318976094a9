"""Keyed caches as tables ``(key_hash, key, value, updated_at)``, one per namespace.

A write appends one batch folder; a read keeps the latest row per key. Writing a batch again replaces its
own folder only, so a replayed batch changes nothing, and no write rewrites the whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trawlwork.plans.lineage import cut
from trawlwork.plans.skew import lookup_join
from trawlwork.settings import CACHE_BUCKETS

_UNIT_SEPARATOR = "\u001f"


def cache_key(*parts: Column) -> Column:
    """MD5 hex of the key text; several parts are joined by a unit separator, null parts kept apart."""
    if len(parts) == 1:
        return F.md5(parts[0].cast("string"))
    return F.md5(F.concat_ws(_UNIT_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]))


def _hashed(df: DataFrame) -> DataFrame:
    return df if "key_hash" in df.columns else df.withColumn("key_hash", cache_key(F.col("key")))


def latest(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last row per ``key_hash``. The choice combines before the shuffle, so hot keys stay cheap."""
    others = [c for c in rows.columns if c != "key_hash"]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("row")
    return rows.groupBy("key_hash").agg(newest).select("key_hash", "row.*").select(*rows.columns)


def cache_lookup(requests: DataFrame, cache: DataFrame, enabled: bool = True) -> DataFrame:
    """``requests`` plus ``value``, null on a miss; a disabled cache misses always."""
    if not enabled:
        return _hashed(requests).withColumn("value", F.lit(None).cast(cache.schema["value"].dataType))
    return lookup_join(_hashed(requests), cache.select("key_hash", "value"), ["key_hash"], "left")


def cache_upsert(
    cache: DataFrame, rows: DataFrame, order: list[str] | None = None, enabled: bool = True
) -> DataFrame:
    """The table after inserting or overwriting ``rows(key, value, updated_at)``; last write wins.

    ``order`` lists the columns that decide between two rows of one key (default: ``updated_at``).
    """
    if not enabled:
        return cache
    columns = list(dict.fromkeys([*cache.columns, *(order or [])]))
    both = cache.unionByName(_hashed(rows), allowMissingColumns=True).select(*columns)
    return latest(both, order or ["updated_at"]).select(*cache.columns)


def cache_overwrite_report(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """``(key, overwrites)``: how many of the new rows replaced an earlier value of their key."""
    writes = _hashed(rows).groupBy("key_hash").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("writes"))
    known = cache.select("key_hash", F.lit(1).alias("known"))
    # A first write of an unknown key inserts, every other write overwrites.
    overwrites = F.col("writes") - F.when(F.col("known").isNull(), 1).otherwise(0)
    return (
        writes.join(known, "key_hash", "left")
        .select("key", overwrites.cast("bigint").alias("overwrites"))
        .filter(F.col("overwrites") > 0)
    )


def cache_read_through(
    requests: DataFrame,
    cache: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    enabled: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(known, fresh)``, both ``(key, value)``: cached values, and ``compute`` applied to the misses only.

    ``compute`` maps ``(key)`` to ``(key, value)``. Write ``fresh`` back with :func:`write_cache_batch`.
    """
    wanted = _hashed(requests.select("key").distinct())
    if not enabled:
        nothing = wanted.limit(0).select("key", F.lit(None).cast(cache.schema["value"].dataType).alias("value"))
        return nothing, compute(wanted.select("key"))
    known = wanted.join(cache.select("key_hash", "value"), "key_hash").select("key", "value")
    missing = wanted.join(cache.select("key_hash"), "key_hash", "left_anti").select("key")
    return known, compute(missing)


class KeyedTable:
    """A cache table of versions: what a commit writes is seen whole, by readers that start after it, or not at all.

    Rows lie in folders ``data/<commit>/bucket=<n>`` by a hash of their key. ``versions/v=<n>`` names the commits that make up version
    ``n``; a version is one small file, written last, so an open reader keeps its own version and a failed commit leaves none. One
    writer commits at a time: a second one that builds on the same version finds its number taken and fails.
    """

    def __init__(self, spark: SparkSession, path: str, value_type: str, buckets: int = CACHE_BUCKETS):
        self.spark, self.path, self.value_type, self.buckets = spark, path.rstrip("/"), value_type, buckets

    def version(self) -> tuple[int, list[str]]:
        """The newest version and its commits, oldest first; 0 without any."""
        try:
            rows = self.spark.read.schema("commits array<string>, buckets int, v bigint").json(f"{self.path}/versions")
            newest = rows.orderBy(F.desc("v")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        if newest is None:
            return 0, []
        if newest["buckets"] != self.buckets:
            raise ValueError(f"the table has {newest['buckets']} buckets")
        return newest["v"], newest["commits"]

    def _rows(self, commits: list[str]) -> DataFrame:
        schema = f"key_hash string, key string, value {self.value_type}, updated_at timestamp, bucket int"
        rows = self.spark.createDataFrame([], f"{schema}, number int")
        for number, commit in enumerate(commits):
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/data/{commit}").withColumn("number", F.lit(number)))
        return rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key_hash"), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """``(key_hash, key, value, updated_at)``: the newest row of every key in the newest version."""
        rows = self._rows(self.version()[1])
        return latest(rows, ["number", "updated_at"]).select("key_hash", "key", "value", "updated_at")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``(key_hash, key, value)`` of those of the distinct ``keys(key)`` that the table holds.

        Only the buckets that these keys fall in are opened, and no row of another key is shuffled.
        """
        wanted = _hashed(keys.select("key")).select("key_hash", self._bucket().alias("bucket"))
        asked = sorted(r["bucket"] for r in wanted.select("bucket").distinct().collect())  # as many as there are buckets at most
        rows = self._rows(self.version()[1]).filter(F.col("bucket").isin(asked) if len(asked) < self.buckets else F.lit(True))
        found = rows.join(wanted.select("key_hash"), "key_hash", "left_semi")
        return latest(found, ["number", "updated_at"]).select("key_hash", "key", "value")

    def commit(self, rows: DataFrame) -> DataFrame:
        """Add or replace the keys of ``rows(key, value)`` (``updated_at`` decides between rows of one key, now without it).

        ``rows`` is computed once; what comes back reads the rows as they are stored.
        """
        version, commits = self.version()
        stamped = rows if "updated_at" in rows.columns else rows.withColumn("updated_at", F.current_timestamp())
        kept = latest(_hashed(stamped), ["updated_at"]).select("key_hash", "key", "value", "updated_at", self._bucket().alias("bucket"))
        return self._write(kept, version, commits)

    def _write(self, rows: DataFrame, version: int, commits: list[str]) -> DataFrame:
        name = f"{version + 1:012d}-{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "key_hash").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        manifest = self.spark.createDataFrame([([*commits, name], self.buckets)], "commits array<string>, buckets int")
        manifest.coalesce(1).write.mode("error").json(f"{self.path}/versions/v={version + 1}")
        return self._rows([name]).select("key_hash", "key", "value")

    def compact(self) -> None:
        """Rewrite the newest version as one commit; older ones stay for their readers."""
        version, commits = self.version()
        if len(commits) > 1:
            rows = latest(self._rows(commits), ["number", "updated_at"])
            self._write(rows.select("key_hash", "key", "value", "updated_at", "bucket"), version, [])

    def read_through(
        self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], observation: Observation | None = None
    ) -> DataFrame:
        """``(key, value)`` of the distinct keys of ``requests(key)``: stored ones, and the misses computed and stored.

        ``compute`` maps ``(key)`` to ``(key, value)`` and sees every miss once; a key it gives no row for has none here. A
        following run finds the values. ``observation`` gets ``requests``, ``distinct_keys`` and ``hits`` on the way, without
        a pass of its own.
        """
        counted = _hashed(requests.select("key")).groupBy("key_hash").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n"))
        wanted = cut(counted, "wanted-keys")
        found = wanted.join(self.lookup(wanted).select("key_hash", "value", F.lit(True).alias("hit")), "key_hash", "left")
        if observation is not None:
            hit = F.coalesce(F.col("hit"), F.lit(False))
            found = found.observe(
                observation, F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.count(F.lit(1)).alias("distinct_keys"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("hits")
            )
        looked_up = cut(found, "looked-up")
        known = looked_up.filter("hit").select("key", "value")
        missing = looked_up.filter("hit is null").select("key")
        if missing.isEmpty():
            return known
        return known.unionByName(self.commit(compute(missing).select("key", "value")).select("key", "value"))


def cache_hit_report(requests: DataFrame, caches: DataFrame) -> DataFrame:
    """``(namespace, hits, misses, distinct_keys)`` for ``requests(namespace, key)``.

    Requests are counted per key first, so a key asked for all the time is one row in the join.
    """
    counted = _hashed(requests).groupBy("namespace", "key_hash").agg(F.count(F.lit(1)).alias("n"))
    known = caches.select("namespace", "key_hash", F.lit(True).alias("hit"))
    hit = F.col("hit").isNotNull()
    return (
        counted.join(known, ["namespace", "key_hash"], "left")
        .groupBy("namespace")
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"),
            F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("misses"),
            F.count(F.lit(1)).alias("distinct_keys"),
        )
    )


_STORED = {"key_hash": "string", "key": "string", "updated_at": "timestamp"}


def write_cache_batch(rows: DataFrame, path: str, batch: int | str, order: list[str] | None = None) -> None:
    """Store the last row per key of ``rows(key, value, updated_at)`` as batch ``batch`` of a cache table.

    The columns of ``order`` are stored too: they also decide between rows of different batches. Every writer needs batch
    names of its own; numbers sort as numbers.
    """
    order = order or ["updated_at"]
    extra = [c for c in order if c not in _STORED]
    stored = latest(_hashed(rows), order).select("key_hash", "key", "value", "updated_at", *extra)
    stored.write.mode("overwrite").parquet(f"{path}/batch={f'{batch:012d}' if isinstance(batch, int) else batch}")


def _newest(spark: SparkSession, path: str, value_type: str, order: dict[str, str] | None) -> DataFrame:
    order = order or {"updated_at": "timestamp"}
    columns = _STORED | {"value": value_type} | order | {"batch": "string"}
    rows = spark.read.schema(", ".join(f"{c} {t}" for c, t in columns.items())).parquet(path)
    return latest(rows, [*order, "batch"]).drop("batch")


def read_cache(spark: SparkSession, path: str, value_type: str, order: dict[str, str] | None = None) -> DataFrame:
    """The cache table at ``path``: the latest row per key over all its batches.

    ``order``: the columns, with types, that the batches were written with (default: ``updated_at``). Rows that agree in all
    of them go by the name of their batch.
    """
    return _newest(spark, path, value_type, order).select("key_hash", "key", "value", "updated_at")


def compact_cache(spark: SparkSession, path: str, value_type: str, into: str, order: dict[str, str] | None = None) -> None:
    """Rewrite a cache table as one batch at a new path, sorted by key for cheap lookups."""
    table = _newest(spark, path, value_type, order)
    table.repartitionByRange("key_hash").sortWithinPartitions("key_hash").write.parquet(f"{into}/batch={0:012d}")
