"""Joins that hold when one key has a large share of all rows, and size checks for small sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from trawlwork.plans.lineage import cut
from trawlwork.settings import BROADCAST_ROWS, HOT_KEY_ROWS, MAX_HOT_KEYS, MAX_HOT_PARTNER_BYTES


def hot_keys(df: DataFrame, on: list[str], min_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """The most frequent keys with at least ``min_rows`` rows: never more than ``MAX_HOT_KEYS`` rows.

    The count combines before its shuffle, so a hot key costs no more than a rare one.
    """
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") >= min_rows)
        .orderBy(F.desc("_rows"), *on)
        .limit(MAX_HOT_KEYS)
        .select(*on)
    )


def sorted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow: by sorting, never by broadcast.

    The planner sees a written table as large as its compressed files, which for URLs is a small part of what their rows take on
    the driver, so left alone it would broadcast millions of rows.
    """
    return left.join(right.hint("merge"), on, how)


def lookup_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", min_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Join many rows to a table that is unique by ``on``.

    The keys of ``left`` are counted first. Without hot keys this is a :func:`sorted_join`. Rows of hot keys meet
    their partners by broadcast and are not shuffled: at most ``MAX_HOT_KEYS`` partners of at most
    ``MAX_HOT_PARTNER_BYTES`` each. Hot keys with a wider partner join like all other rows, where adaptive
    execution splits them. ``left`` is read twice more: cut a costly one first.
    """
    hot = cut(hot_keys(left, on, min_rows), "hot-keys")
    if hot.isEmpty():
        return sorted_join(left, right, on, how)
    values = [c for c in right.columns if c not in on]
    width = F.octet_length(F.to_json(F.struct(*on, *values)))
    partners = cut(right.join(F.broadcast(hot), on, "left_semi").withColumn("_width", width), "hot-partners")
    wide = partners.filter(F.col("_width") > MAX_HOT_PARTNER_BYTES).select(*on)
    hot = hot.join(wide, on, "left_anti").withColumn("_hot", F.lit(True))
    narrow = partners.filter(F.col("_width") <= MAX_HOT_PARTNER_BYTES).drop("_width")
    flagged = left.join(F.broadcast(hot), on, "left")
    busy = flagged.filter(F.col("_hot")).drop("_hot").join(F.broadcast(narrow), on, how)
    usual = sorted_join(flagged.filter(F.col("_hot").isNull()).drop("_hot"), right, on, how)
    return usual.unionByName(busy)


def numbered(df: DataFrame, order: list[str], column: str = "number") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0, found range by range; no task sees more than a range."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(df.repartitionByRange(tasks, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    # One row per range: their window is a small one.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    return ranges.withColumn("_place", inside).join(F.broadcast(starts), "_part").withColumn(column, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its counted rows are within the bound; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Rows of a table whose size is checked: more than ``limit`` rows are an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} holds more than {limit} rows")
    return rows
