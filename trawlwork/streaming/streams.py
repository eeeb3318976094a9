"""Streaming forms of the visited set and of the cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trawlwork.operators.cache import write_cache_batch
from trawlwork.settings import VISIT_SHARES


def stream_visited_dedup(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Admit each key once while its state lives.

    State is bounded by the watermark: a key seen again after ``delay`` is admitted again.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class _CrawlVisits(StatefulProcessor):
    """The URLs that one share of a crawl has met, until the crawl ends or they expire."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "url string", "since timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Events of one batch in order of time; at one time an end comes before the visits."""
        events = pd.concat(list(rows)).sort_values(["ts", "ends", "url"], ascending=[True, False, True])
        admitted = []
        for url, ts, ends in zip(events["url"], events["ts"], events["ends"], strict=True):
            if ends:
                self.seen.clear()
            elif not self.seen.containsKey((url,)):
                self.seen.updateValue((url,), (ts.to_pydatetime(),))
                admitted.append((key[0], url, ts))
        yield pd.DataFrame(admitted, columns=["crawl", "url", "ts"])

    def close(self) -> None:
        pass


def stream_visited_by_crawl(
    stream: DataFrame, crawl: str, url: str, time: str, ends: str, ttl_ms: int | None = None, shares: int = VISIT_SHARES
) -> DataFrame:
    """``(crawl, url, ts)``: every URL once per crawl; a crawl's end event forgets what it has met.

    Rows whose ``ends`` is true are end events; a URL is admitted again after one, and after ``ttl_ms`` milliseconds if given, and
    not before. A crawl's URLs lie in ``shares`` shares by a hash, each with a state of its own, and an end event goes to all of them: no
    crawl is one group. Rows without a URL or a time are left out. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    share = F.pmod(F.xxhash64(url), F.lit(shares)).cast("int")
    every = F.when(F.coalesce(F.col(ends), F.lit(False)), F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(share))
    rows = stream.filter(F.col(time).isNotNull() & (F.col(ends) | F.col(url).isNotNull())).select(
        F.col(crawl).alias("crawl"),
        F.explode(every).alias("share"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.col(time).cast("timestamp").alias("ts"),
        F.coalesce(F.col(ends), F.lit(False)).alias("ends"),
    )
    kind = stream.schema[crawl].dataType.simpleString()
    mode = "none" if ttl_ms is None else "processingTime"
    return rows.groupBy("crawl", "share").transformWithStateInPandas(_CrawlVisits(ttl_ms), f"crawl {kind}, url string, ts timestamp", "append", mode)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet files, taking what is there now and then stopping."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_cache_upsert(
    stream: DataFrame, path: str, checkpoint: str, order: list[str] | None = None
) -> StreamingQuery:
    """Apply arriving ``(key, value, updated_at)`` rows to the cache table at ``path``; last write wins.

    Each micro-batch owns one batch folder, named after the checkpoint and its number: a replayed one replaces itself and
    nothing that another stream or writer has stored.
    """
    writer = hashlib.md5(checkpoint.encode()).hexdigest()

    def write(batch: DataFrame, batch_id: int) -> None:
        write_cache_batch(batch, path, f"{writer}-{batch_id:012d}", order)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
