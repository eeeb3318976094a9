"""Mixing sources to target weights, in blocks of words.

The words of a source form one stream, cut into the fewest blocks of at most a fixed length, which differ by a word at most.
A source owes a number of slots; slots are
dealt to output shards by multinomial counts, run through pseudorandom permutations of the source's block numbers (one
for every round over the source), and blocks are joined by number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlwork.llm.common import words
from trawlwork.plans.lineage import cut

#: The parameters of the registered query and the pipeline.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 64
OUTPUT_SHARDS = 16
SEED = 20260101
#: Parts of a source's stream that are laid out side by side, and slots dealt by one row.
STREAM_BUCKETS = 1024
SLOT_CHUNK = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_no, source_size, weight, target)`` of ``sizes(source, size)``, one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn. Together the targets are all sizes; none
    exceeds ``epochs`` times its source, and what it can't take goes to the others by weight. The level at which that
    comes out is found from running sums over the sources in the order in which they reach their limit. The windows
    without a key run over one row per source, never over documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per_source.withColumn("source_no", in_order).withColumn("weight", F.get(turn, F.col("source_no") % len(weights)))
    limited = weighed.withColumn("most", F.col("source_size") * epochs).withColumn("reach", F.col("most") / F.col("weight"))
    by_reach = Window.orderBy("reach", "source_no")
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(by_reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(
        "weight"
    ).over(by_reach.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = limited.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "source_no", "level"))).over(Window.partitionBy())
    target = F.least(F.col("most").cast("double"), F.coalesce(fits["level"] * F.col("weight"), F.col("most").cast("double")))
    return levels.withColumn("target", target).select("source", "source_no", "source_size", "weight", "target")


def _permuted(numbers: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``numbers`` through a keyed permutation of ``0 .. size - 1`` each: a Feistel network on the next power of four,
    walked until the result is below the size."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = numbers.astype(np.uint64), np.arange(len(numbers))
    limit = sizes.astype(np.uint64)
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for step in range(4):
            x = (right + keys[todo] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _blocks(size: Column, block: int) -> Column:
    """Blocks of a source's stream; none without words."""
    return F.ceil(size / block).cast("long")


def _block_start(number: Column, size: Column, blocks: Column) -> Column:
    """The place of a block's first word: the first ``size % blocks`` blocks hold a word more than the others."""
    return number * F.floor(size / blocks) + F.least(number, size % blocks)


def _block_at(place: Column, size: Column, blocks: Column) -> Column:
    """The block that holds a place of the stream."""
    short, longer = F.floor(size / blocks), size % blocks
    edge = longer * (short + 1)
    return F.when(place < edge, F.floor(place / (short + 1))).otherwise(longer + F.floor((place - edge) / short))


def _slots(sources: DataFrame, block: int, shards: int, seed: int, epochs: int) -> DataFrame:
    """``(source_no, shard, slot, epoch, block)``: every slot that a source owes, and the block it takes."""

    @F.pandas_udf("array<long>")
    def dealt(source_no: pd.Series, owed: pd.Series) -> pd.Series:
        even = np.full(shards, 1 / shards)
        return pd.Series([np.cumsum(np.random.default_rng([seed, int(s)]).multinomial(int(n), even)) for s, n in zip(source_no, owed, strict=True)])

    @F.pandas_udf("long")
    def block_of(source_no: pd.Series, epoch: pd.Series, place: pd.Series, blocks: pd.Series) -> pd.Series:
        keys = (source_no.to_numpy().astype(np.uint64) * np.uint64(1_000_003) + epoch.to_numpy().astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return pd.Series(_permuted(place.to_numpy(), blocks.to_numpy(), keys))

    blocks = _blocks(F.col("source_size"), block)
    # Slots are counted in the source's own block length; a source with a target is never left out.
    nearest = F.round(F.col("target") * blocks / F.col("source_size")).cast("long")
    owed = F.when(F.col("target") > 0, F.least(F.greatest(nearest, F.lit(1)), blocks * epochs)).otherwise(0)
    asked = sources.withColumn("blocks", blocks).withColumn("owed", owed).filter("owed > 0").withColumn("ends", dealt("source_no", "owed"))
    # A large source is cut into runs of slots first: no task makes all slots of one source. The rows of runs are few and
    # small, so that adaptive execution would put them all into one task; a stated number of partitions it leaves alone.
    runs = asked.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("owed") - 1) / SLOT_CHUNK))))
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = runs.repartition(tasks, "source_no", "run").withColumn(
        "n", F.explode(F.sequence(F.col("run") * SLOT_CHUNK, F.least(F.col("owed"), (F.col("run") + 1) * SLOT_CHUNK) - 1))
    )
    shard = F.size(F.filter("ends", lambda e: e <= F.col("n")))
    first = F.coalesce(F.get("ends", shard - 1), F.lit(0))
    numbered = spread.select(
        "source_no", "blocks", shard.alias("shard"), (F.col("n") - first).alias("slot"), F.floor(F.col("n") / F.col("blocks")).alias("epoch"), (F.col("n") % F.col("blocks")).alias("place")
    )
    return numbered.select("source_no", "shard", "slot", "epoch", block_of("source_no", "epoch", "place", "blocks").alias("block"))


def _streams(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, size, mark, copies, begin)``: where each document's words begin in its source's stream."""
    sized = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.xxhash64("text").alias("mark"),
    )
    rows = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(STREAM_BUCKETS)))
    return cut(rows, "sized")


def mix_plan(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sources, slots, pieces)`` of ``documents(doc_id, text, source)``.

    ``sources``: :func:`source_targets`. ``slots(source_no, shard, slot, epoch, block)``: the mix itself, for every
    output shard the blocks in order. ``pieces(doc_id, source, size, mark, copy, source_no, block, n_words)``: which documents a
    block's words come from; documents without words have one piece without a block.
    """
    rows = _streams(documents)
    sources = cut(source_targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, epochs), "sources")
    slots = _slots(sources, block, shards, seed, epochs)
    volume = F.col("size") * F.col("copies")
    part = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "mark")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "bucket").agg(F.sum(volume).alias("n"))
    parts = parts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # One row per source and bucket, matched null to null.
    parts = parts.join(sources.select(F.col("source").alias("_s"), "source_no", "source_size"), F.col("source").eqNullSafe(F.col("_s")))
    parts = parts.select("source_no", F.col("source").alias("_s"), F.col("bucket").alias("_b"), "begin", "source_size")
    ahead = rows.withColumn("ahead", F.sum(volume).over(part) - volume)
    laid = ahead.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    )
    laid = laid.withColumn("begin", F.col("begin") + F.col("ahead") + F.col("copy") * F.col("size")).withColumn("end", F.col("begin") + F.col("size"))
    stream, blocks = F.col("source_size"), _blocks(F.col("source_size"), block)
    touched = F.sequence(_block_at(F.col("begin"), stream, blocks), _block_at(F.col("end") - 1, stream, blocks))
    pieces = laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, touched)))
    starts, ends = (_block_start(F.col("block") + k, stream, blocks) for k in (0, 1))
    n_words = F.when(F.col("block").isNotNull(), F.least(F.col("end"), ends) - F.greatest(F.col("begin"), starts))
    return sources, slots, pieces.select("doc_id", "source", "size", "mark", "copy", "source_no", "block", F.coalesce(n_words, F.lit(0)).alias("n_words"))


def mix_documents(documents: DataFrame, **parameters) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per row of ``documents(doc_id, text, source)``.

    ``size``: words of the text. ``taken``: words of it that the mix takes, repeats counted; at most ``epochs`` times
    ``size``, since a source's slots go over its blocks in whole rounds. Null text: size 0, taken 0. A null source is a
    source of its own, last in order. Equal rows are one row of work with as many places in the stream. Ties never
    matter: the stream's order and the permutations follow from ids, texts and the seed. Parameters: :func:`mix_plan`.
    """
    sources, slots, pieces = mix_plan(documents, **parameters)
    uses = slots.groupBy("source_no", F.col("block").alias("_at")).agg(F.count(F.lit(1)).alias("uses"))
    # Slots come of a few rows of sources, and the planner takes them to be as few: left alone it would broadcast every block.
    # Pieces without a block get numbers of their own below 0, else they would all go to one task.
    at = F.coalesce("block", -1 - F.pmod(F.xxhash64("doc_id", "mark", "copy"), F.lit(1 << 40)))
    taken = (
        pieces.withColumn("_at", at)
        .join(uses.hint("merge"), ["source_no", "_at"], "left")
        .groupBy("doc_id", "mark", "copy", "source_no", "size")
        .agg(F.sum(F.col("n_words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"))
    )
    return taken.join(sources.select("source_no", "source_size", "target"), "source_no").select("doc_id", "size", "source_size", "target", "taken", "mark", "copy")


def mixed_documents(documents: DataFrame, seed: int = SEED, **parameters) -> DataFrame:
    """The mix as whole documents, with the columns of ``documents``: each row as often as the mix takes its words.

    A row comes ``taken / size`` times; the fraction is settled by a hash of id and text, so that reruns agree and a
    source's words still come near its target. Rows without words (null, empty and blank texts) have no share in the mix and
    stay as they are, null ids and sources count like all others, repeated rows come as often each, texts of any length stay
    whole, and an empty table gives an empty one.
    """
    counts = mix_documents(documents, seed=seed, **parameters).filter("size > 0")
    # Equal rows share one total.
    totals = counts.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg((F.sum("taken") / F.sum("size")).alias("_times"))
    # The input's own columns travel as one, whatever their names are.
    packed = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"))
    joined = packed.join(totals, packed["id"].eqNullSafe(totals["_id"]) & (packed["mark"] == totals["_mark"]), "left")
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("_id"), F.col("_mark")), F.lit(1 << 30)) / float(1 << 30)
    times = F.coalesce(F.floor(F.col("_times") + chance).cast("int"), F.lit(1))
    repeated = joined.withColumn("times", times).filter("times > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
