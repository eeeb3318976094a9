"""Near-duplicate documents from an inverted join over the coordinates of MinHash signatures.

Every set of word shingles gets ``COORDINATES`` minima. A document is posted under its coordinate-value pairs; two
documents are candidates if they agree in at least ``MATCHES`` of them. Prefix: with the pairs in order of rarity, two
such documents agree in one of their ``COORDINATES - MATCHES + 1`` rarest, so only those are posted. Skip: a list is
not multiplied out. Its members are compared with its first member, and only members that are still apart meet again,
in blocks. Candidates that hang together are then compared on their full sets, in blocks, and the links give the
classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlwork.llm.common import IS_SPACE, LOWER, broadcast_if_small, grouped_tables, release, text_chunks
from trawlwork.llm.components import connected_components
from trawlwork.llm.hashing import RangeHashes, mix
from trawlwork.plans.lineage import cut

#: Documents whose similarity is 0.8 agree in 51.2 of 64 coordinates on average; below 36 with a chance of 3 in a million.
COORDINATES = 64
MATCHES = 36
#: Members of a block, and shingles of all its members together, about: two blocks meet in one task.
BLOCK = 256
BLOCK_SHINGLES = 400_000
_SEEDS = np.random.default_rng(20260104)
_FACTORS = _SEEDS.integers(0, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _SEEDS.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For every text the sorted distinct 64-bit hashes of its word shingles.

    A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``; a text of fewer words is one shingle, one without words has none.
    """
    for first, last, data, offsets in text_chunks(texts):
        hashes = RangeHashes(LOWER[data])
        gap = np.ones(len(data) + 1, dtype=bool)
        gap[:-1] = IS_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begins = np.flatnonzero(~gap[:-1] & (edge[:-1] | np.r_[True, gap[:-2]])) if len(data) else np.zeros(0, dtype=np.int64)
        ends = np.flatnonzero(~gap[:-1] & (edge[1:] | gap[1:])) + 1
        words = hashes.ranges(begins, ends)
        at = np.searchsorted(begins, offsets)
        for k in range(last - first):
            own = words[at[k] : at[k + 1]]
            n = len(own)
            if not n:
                yield own
                continue
            joined = own[: max(1, n - size + 1)].copy()
            for step in range(1, min(size, n)):
                joined = mix(joined * np.uint64(0x9FB21C651E98DF25) + own[step : step + len(joined)])
            yield np.unique(joined)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of every coordinate's permuted hashes, 32 bits each."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for first in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[first : first + 1024, None] * _FACTORS + _SHIFTS) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype(np.uint32)


def _set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two keys of 64 bits each, made independently, that together stand for a whole set."""
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    first = np.bitwise_xor.reduce(mix(shingles ^ mix(place)))
    second = np.add.reduce(mix(mix(shingles + np.uint64(0x9E3779B97F4A7C15)) * (place * np.uint64(2) + np.uint64(1))))
    return int(first.view(np.int64)), int(second.view(np.int64))


def _signed(documents: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n_shingles, class_key, class_mark, sig)`` per row; equal sets have equal keys and marks, empty sets none."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, marks, sigs = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                counts.append(len(s))
                key, mark = _set_keys(s) if len(s) else (None, None)
                keys.append(key)
                marks.append(mark)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, keys, marks)), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "class_key", "class_mark", "sig"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, class_key long, class_mark long, sig binary")


def _postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``(key, id)``: the rarest coordinate-value pairs of every class that others have too."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if n:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, coordinates).astype(np.int64)
                keys = (values + (np.arange(coordinates, dtype=np.int64) << 32)).reshape(-1)
                ids = np.repeat(batch.column(0).to_numpy(), coordinates)
                for first in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + (1 << 16)]), pa.array(keys[first : first + (1 << 16)])], names=["id", "key"])

    posted = classes.select("id", "sig").mapInArrow(spread, "id long, key long")
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A value that nobody else has leads nowhere, but takes its place among the rarest ones.
    known = posted.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held"))
    places = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("held"))
    kept = known.filter(places > 0).select("id", F.explode(F.slice("held", F.lit(1), places)).alias("held"))
    return kept.select(F.col("held.key").alias("key"), "id")


def _alike(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose signatures agree in ``matches`` coordinates."""

    @F.pandas_udf("boolean")
    def agree(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(x), dtype=np.uint32).reshape(len(x), -1) for x in (left, right))
        return pd.Series((a == b).sum(axis=1) >= matches)

    joined = pairs.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    joined = joined.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    return joined.filter(agree("sig_a", "sig_b")).select("a", "b")


def _block_pairs(members: DataFrame, group: str) -> DataFrame:
    """``(group, x, y, id, label)``: the members of every group that has several labels, in tasks of two blocks at most.

    ``members(group, id, label, weight)``, where ``weight`` is what a member holds: blocks are bounded in both. The rows of a group's largest label need not meet each other, only all the others.
    Rows find their block by a hash of the id, so that no group is ever gathered to number it.
    """
    counted = members.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    groups = counted.groupBy(group).agg(
        F.sum("n").alias("all"), F.sum("w").alias("weights"), F.max(F.struct("n", "label", "w")).alias("major"), F.count(F.lit(1)).alias("labels")
    )
    groups = groups.filter("labels > 1").select(group, "all", "weights", F.col("major.label").alias("major"), F.col("major.n").alias("n"), F.col("major.w").alias("w"))
    rows = members.join(groups, group)
    others = _blocks(F.col("all") - F.col("n"), F.col("weights") - F.col("w"))
    majors = _blocks(F.col("n"), F.col("w"))
    single = _blocks(F.col("all"), F.col("weights")) == 1
    mark = F.xxhash64("id")
    block = F.when(single, 0).when(F.col("label") == F.col("major"), others + F.pmod(mark, majors)).otherwise(F.pmod(mark, others))
    last = F.when(single, 0).when(F.col("label") == F.col("major"), others - 1).otherwise(others + majors - 1)
    met = rows.withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return met.select(group, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "label")


def _blocks(members: Column, weight: Column) -> Column:
    """Blocks that so many members with so many shingles make."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(weight / BLOCK_SHINGLES), F.lit(1))


def _first_blocks(members: DataFrame, group: str) -> DataFrame:
    """As :func:`_block_pairs`, but every block meets itself and the first block only."""
    groups = members.groupBy(group).agg(_blocks(F.count(F.lit(1)), F.sum("weight")).cast("int").alias("blocks"))
    rows = members.join(groups, group).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    own = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    met = rows.withColumn("y", F.explode(own))
    return met.select(group, F.when(F.col("y") == F.col("block"), F.col("y")).otherwise(F.lit(0)).alias("x"), F.greatest("y", "block").alias("y"), "id", "label")


def _in_tasks(rows: DataFrame, group: str, compare) -> DataFrame:
    """``compare(ids, labels, payloads)`` over every task of :func:`_block_pairs`, as edges ``(a, b)``.

    ``rows(group, x, y, id, label, payload)`` are dealt by task and sorted; a Python worker sees one task's rows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_tables(batches, [group, "x", "y"]):
            ids = table.column("id").to_numpy()
            a, b = compare(ids, table.column("label").to_numpy(), table.column("payload"))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, group, "x", "y").sortWithinPartitions(group, "x", "y", "id")
    return dealt.mapInArrow(run, "a long, b long")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position that every position hangs together with."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _tree_edges(ids: np.ndarray, label: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hold together what the matrix ``linked`` holds together across labels, one per position at most."""
    left, right = np.nonzero(linked & (label[:, None] != label[None, :]))
    root = _forest(len(ids), left, right)
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[moved]], ids[moved]


def _coarse_edges(lists: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """Edges between members of a posting list that agree in ``matches`` coordinates and have different labels."""

    def compare(ids: np.ndarray, label: np.ndarray, payload: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(payload.to_pylist()), dtype=np.uint32).reshape(len(ids), -1)
        if len(ids) <= 64:
            same = (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
        else:
            same = np.zeros((len(ids), len(ids)), dtype=np.uint16)
            for column in np.ascontiguousarray(sig.T):
                same += column[:, None] == column[None, :]
        return _tree_edges(ids, label, same >= matches)

    wide = _block_pairs(lists, "key").join(sigs.select("id", F.col("sig").alias("payload")), "id")
    return _in_tasks(wide, "key", compare)


def similar_in_block(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of shingle sets have ``100 * |intersection| >= percent * |union|``: a matrix over the positions."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not n or not sizes.sum():
        return np.zeros((n, n), dtype=bool)
    values, rows = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    first = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(first) - 1
    count = np.bincount(column)
    shared = count[column] > 1
    column, rows = (np.cumsum(count > 1) - 1)[column[shared]], rows[shared]
    both = np.zeros((n, n), dtype=np.float32)
    # Columns in slices: a bounded dense matrix at a time.
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 8192, 8192))
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if j > i:
            has = np.zeros((n, 8192), dtype=np.float32)
            has[rows[i:j], column[i:j] - k * 8192] = 1
            both += has @ has.T
    both = np.rint(both).astype(np.int64)
    return (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)


def _exact_edges(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one family that have different labels; ``met`` says who meets in which task."""

    def compare(ids: np.ndarray, label: np.ndarray, payload: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        listed = [np.frombuffer(s, dtype=np.uint64) for s in payload.to_pylist()]
        return _tree_edges(ids, label, similar_in_block(listed, percent))

    return _in_tasks(met.join(sets.withColumnRenamed("shingles", "payload"), "id"), "family", compare)


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``documents(doc_id, text)``.

    Two documents are linked if their sets of ``size``-word shingles have a similarity of ``percent`` / 100 or more;
    ``component_id`` is the smallest id that links lead to, itself included, and ``kept`` marks that document. Every link
    is confirmed on the full sets. Null and empty texts, and texts without words, have no shingles and no links. Rows
    that share an id are one document with several texts. A null id is a row without links: its component is null and
    it is kept. Equal sets are one class from the start, however many documents have them. Texts of any length are taken
    whole; blocks are bounded by the shingles they hold. Other columns are ignored.
    """
    spark = documents.sparkSession
    signed = cut(_signed(documents, size), "signed")
    with_id = signed.filter("doc_id is not null and class_key is not null")
    classes = cut(
        with_id.groupBy("class_key", "class_mark").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "classes"
    )
    # Two different sets of which one has fewer than 4 elements can't be 80% alike; more generally:
    least = max(1, percent // max(1, 100 - percent)) if percent < 100 else 1 << 62
    searched = classes.filter(F.col("n") >= least).select("id", "sig")
    lists = cut(_postings(searched, coordinates, matches), "postings")
    release(spark)
    # The first member of every list against the others, once per pair.
    heads = lists.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = lists.join(heads.select("key", "a"), "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    coarse = cut(_alike(pairs, searched, matches), "alike")
    # Documents alike to one and the same third are held together by it: two steps towards the smallest one do for a label.
    nearest = coarse.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("near"))
    further = nearest.select(F.col("id").alias("near"), F.col("near").alias("far"))
    labels = nearest.join(further, "near", "left").select("id", F.coalesce("far", "near").alias("component"))
    # Members of one list that are still apart meet in blocks.
    labelled = lists.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"), F.lit(0).alias("weight"))
    more = cut(_coarse_edges(labelled, searched, matches), "more-alike")
    families = cut(connected_components(coarse.unionByName(more)), "families")
    release(spark)
    # Only families' texts are read again.
    heads_too = families.select("id").unionByName(families.select(F.col("component").alias("id"))).distinct()
    sets = cut(_family_sets(documents, heads_too, size), "family-sets")
    release(spark)
    members = heads_too.join(families, "id", "left").join(classes.select("id", F.col("n").alias("weight")), "id")
    members = members.select("id", F.coalesce("component", "id").alias("family"), "weight")
    links = cut(_exact_edges(_first_blocks(members.withColumn("label", F.col("id")), "family"), sets, percent), "links")
    now = cut(connected_components(links), "labels")
    rest = members.join(now, "id", "left").select("id", "family", F.coalesce("component", "id").alias("label"), "weight")
    # A family that fitted into one block is settled.
    large = members.groupBy("family").agg(_blocks(F.count(F.lit(1)), F.sum("weight")).alias("blocks")).filter("blocks > 1").select("family")
    met = _block_pairs(rest.join(large, "family", "left_semi"), "family")
    more = cut(_exact_edges(met, sets, percent), "more-links")
    found = now if more.isEmpty() else connected_components(now.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))
    # A class has the smallest id of its documents, so the smallest class of a component has the smallest id of all.
    named = classes.select("class_key", "class_mark", "id").join(found, "id", "left").select("class_key", "class_mark", F.coalesce("component", "id").alias("component"))
    out = signed.withColumn("known", F.when(F.col("doc_id").isNotNull(), F.col("class_key"))).join(
        named.withColumnRenamed("class_key", "known"), ["known", "class_mark"], "left"
    )
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _family_sets(documents: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``(id, shingles)`` of the documents in ``ids``: the sorted distinct hashes as bytes."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text is not null")
    return rows.join(broadcast_if_small(ids), "id", "left_semi").mapInArrow(listed, "id long, shingles binary")


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all its columns.

    Rows without an id stay, and so do texts that are null or without words. Rows that share a kept id stay together. No rows
    give no rows; a text of any length is compared whole.
    """
    found = cut(near_duplicates(documents, size, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return documents.join(found, documents["doc_id"].cast("long") == found["_gone"], "left_anti")
