"""Connected components of an edge table, without ever holding a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlwork.llm.common import release
from trawlwork.plans.lineage import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``(hi, lo)`` with ``hi > lo``."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
    large = both.filter("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    large = large.unionByName(edges.groupBy("hi").agg(F.min("lo").alias("lo"))).filter("hi > lo").distinct()
    below = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(below, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionByName(below.select("hi", F.col("m").alias("lo"))).filter("hi > lo").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)`` (longs, any order, repeats and loops allowed); ``component``
    is the smallest id that can be reached, and ids that are their own component may be left out.

    Large-star and small-star steps alternate until nothing changes; a step is joins and minima only, and every step
    is written to the shared folder.
    """
    spark = edges.sparkSession
    now = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    state = None
    while True:
        checksum = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first()
        if not checksum[0] or tuple(checksum) == state:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        state = tuple(checksum)
        now = cut(_stars(now), "stars")
        release(spark)
