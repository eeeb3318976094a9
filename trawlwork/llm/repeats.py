"""Exact repeats of 100 bytes within and across documents, by bucket-pointer refinement.

A suffix is compared no further than needed: positions start in buckets of equal q-grams, and a bucket is refined by the
bucket identifiers (q-gram hashes) found at later offsets, until the whole length is covered. Buckets that have become
single leave at once. Not every position takes part: of every window of 100 bytes the q-gram with the smallest hash
(the leftmost of equals) stands for it. Equal windows choose the same place, so equal strings always meet.

1. Count the q-grams chosen anywhere. A q-gram chosen once can't be in a repeated string.
2. For every chosen place with a repeated q-gram: the starts whose windows chose it, and the identifiers of the bytes they
   cover. Places that agree in all of it repeat each other start by start; only the first of them goes on, and only
   if its q-gram's bucket holds others that differ.
3. Those places are cut into pieces of ``PIECE`` starts and refined again in the same way: a piece's bucket is the bytes that
   all windows of the piece share, so most of what differs becomes single at once.
4. What is left is refined start by start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlwork.llm.common import release, text_chunks
from trawlwork.llm.hashing import RangeHashes, mix
from trawlwork.plans.lineage import cut

LENGTH = 100
GRAM = 32
#: Starts of a piece; places have up to ``LENGTH - GRAM + 1``.
PIECE = 9
#: A run of starts as one number: how far its first start lies before the place, times this, plus the starts.
_RUN = 1 << 12
#: Bits of a position when places compete in a window; the rest of 64 belong to the q-gram's hash.
_PLACE_BITS = np.uint64(31)
#: A place in a document as one long: rows that share an id are told apart by bits above the position.
_ROW_SHIFT = 33


def _windows(grams: np.ndarray, width: int) -> np.ndarray:
    """For every start the place with the smallest (hash, place) among ``width`` grams."""
    best = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    return (best & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)


def _identifiers(grams: np.ndarray, starts: np.ndarray, lengths: np.ndarray, gram: int) -> np.ndarray:
    """One value for the bytes of each range: the bucket identifiers at offsets 0, q, 2q, ... and at its end."""
    out = mix(lengths.astype(np.uint64))
    for offset in range(0, int(lengths.max(initial=0)), gram):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + grams[starts + np.minimum(offset, lengths - gram)])
    return out


class Places:
    """The chosen places of some texts that lie one after the other in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.grams = RangeHashes(data).grams(gram)
        empty = np.zeros(0, dtype=np.int64)
        self.place = self.low = self.high = self.row = empty
        if len(data) < length:
            return
        chosen = _windows(self.grams, length - gram + 1)
        row = np.searchsorted(offsets, np.arange(len(chosen)), side="right") - 1
        inside = np.arange(len(chosen)) + length <= offsets[row + 1]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (chosen[1:] != chosen[:-1])
        self.low = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (chosen[1:] != chosen[:-1])
        self.high = np.flatnonzero(last)
        self.place, self.row = chosen[self.low], row[self.low]


_RUNS = ["q", "same", "doc", "at", "run"]
_RUN_SCHEMA = "q long, same long, doc long, at long, run int"


def _identified(documents: DataFrame) -> DataFrame:
    """``(doc, sub, text)``: ``sub`` tells rows apart that share an id, and is 0 for all others."""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    twice = cut(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc", F.lit(True).alias("twice")), "shared-ids")
    if twice.isEmpty():
        return rows.withColumn("sub", F.lit(0).cast("long"))
    mark = F.xxhash64("text").bitwiseAND((1 << 30) - 1)
    return rows.join(twice, "doc", "left").select("doc", "text", F.when(F.col("twice"), mark).otherwise(0).cast("long").alias("sub"))


def _chosen_grams(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                found = Places(data, offsets, length, gram)
                values, counts = np.unique(found.grams[found.place], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int32))], names=["q", "n"])

    return rows.select("text").mapInArrow(choose, "q long, n int")


def _places(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``(q, same, doc, at, run)``: ``at`` is the first start of the place, with the row's bits above it; ``run`` says how far
    before the place it lies and how many starts there are."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, data, offsets in text_chunks(batch.column(2)):
                found = Places(data, offsets, length, gram)
                if not len(found.low):
                    continue
                row = found.row
                n = found.high - found.low + 1
                same = mix(_identifiers(found.grams, found.low, n + length - 1, gram) + (found.place - found.low).astype(np.uint64))
                at = (subs[first + row] << _ROW_SHIFT) + found.low - offsets[row]
                run = ((found.place - found.low) * _RUN + n).astype(np.int32)
                columns = [found.grams[found.place].view(np.int64), same.view(np.int64), docs[first + row], at, run]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_RUNS)

    return rows.select("doc", "sub", "text").mapInArrow(choose, _RUN_SCHEMA)


def _with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows whose documents have a list. The lists are bounded by the documents' own lengths."""
    key = F.shiftright("at", _ROW_SHIFT)
    gathered = lists.groupBy("doc", key.alias("sub")).agg(F.collect_list(F.struct("at", "run")).alias("runs"))
    return rows.join(gathered, ["doc", "sub"], "left")


def _pieces(rows: DataFrame, wanted: DataFrame, length: int, gram: int, piece: int) -> DataFrame:
    """The wanted places in pieces of at most ``piece`` starts, as :func:`_places` gives places.

    Pieces begin at fixed distances from the place, so that the same starts meet in the same piece. A piece's ``q`` are the
    identifiers of the bytes that lie in every window a piece there can have.
    """
    mask = (1 << _ROW_SHIFT) - 1

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, runs = batch.column(0).to_numpy(), batch.column(2)
            for first, last, data, offsets in text_chunks(batch.column(1)):
                grams = RangeHashes(data).grams(gram)
                own = runs.slice(first, last - first)
                listed = own.flatten()
                if not len(listed):
                    continue
                row = np.repeat(np.arange(last - first), np.diff(own.offsets.to_numpy()))
                at, run = listed.field("at").to_numpy(), listed.field("run").to_numpy().astype(np.int64)
                far, n = run // _RUN, run % _RUN
                near = far - n + 1
                parts = far // piece - near // piece + 1
                step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                row, at, far, near = (np.repeat(x, parts) for x in (row, at, far, near))
                group = far // piece - step
                high = np.minimum(far, group * piece + piece - 1)
                low = np.maximum(near, group * piece)
                place = offsets[row] + (at & mask) + far
                core = length - piece + 1
                q = mix(_identifiers(grams, place - group * piece, np.full(len(place), core), gram) + group.astype(np.uint64))
                same = mix(_identifiers(grams, place - high, high - low + length, gram) + high.astype(np.uint64))
                at, run = at + far - high, (high * _RUN + high - low + 1).astype(np.int32)
                for i in range(0, len(at), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    columns = [q[part].view(np.int64), same[part].view(np.int64), docs[first + row[part]], at[part], run[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_RUNS)

    joined = _with_lists(rows, wanted).filter("runs is not null").select("doc", "text", "runs")
    return joined.mapInArrow(spell, _RUN_SCHEMA)


def _settle(places: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``(repeats, unsettled)``, both ``(doc, at, run)``: places that repeat an earlier one start by start, and first places
    whose bucket holds others that differ from them. Minima combine before the shuffle."""
    first = places.groupBy("q", "same").agg(F.min(F.struct("doc", "at", "run")).alias("first"), F.count(F.lit(1)).alias("n"))
    several = first.groupBy("q").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("q")
    unsettled = cut(first.join(several, "q", "left_semi").select("first.*"), f"unsettled-{name}")
    often = first.filter("n > 1").select("q", "same", "first")
    later = places.join(often, ["q", "same"]).filter(F.struct("doc", "at", "run") != F.col("first"))
    repeats = cut(later.select("doc", "at", "run"), f"repeats-{name}")
    release(places.sparkSession)
    return repeats, unsettled


def repeated_runs(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """``(rows, runs)``: the texts, and ``runs(doc, at, run)`` of starts whose ``length`` bytes also start earlier."""
    spark = documents.sparkSession
    rows = _identified(documents)
    often = cut(_chosen_grams(rows, length, gram).groupBy("q").agg(F.sum("n").alias("n")).filter("n > 1").select("q"), "repeated-grams")
    release(spark)
    places = cut(_places(rows, length, gram).join(often, "q", "left_semi"), "places")
    release(spark)
    runs, unsettled = _settle(places, "places")
    for size in (min(piece, length - gram + 1), 1):
        pieces = cut(_pieces(rows, unsettled, length, gram, size), "pieces")
        release(spark)
        repeats, unsettled = _settle(pieces, "pieces")
        runs = runs.unionByName(repeats)
    return rows, runs


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``documents(doc_id, text)``, and ``kept`` (the
    bytes that stay) if ``with_text``.

    A byte goes if a string of ``length`` bytes over it also starts earlier, in a document with a smaller id or earlier in the
    same one; overlaps count, and all is judged on the input. Null and empty texts: nothing to remove, hash of no bytes.
    A null id comes before all others. Rows that share an id and differ in text are taken one after the other (by a
    hash of the text); rows equal in both count as one document, and each gives its row. Other columns are ignored.
    """
    if not 0 < gram <= length - min(PIECE, length - gram + 1) + 1 or length >= _RUN // 2:
        raise ValueError("the q-gram must fit into the length")
    rows, runs = repeated_runs(documents, length, gram)
    mask = (1 << _ROW_SHIFT) - 1

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer() if text.as_buffer() is not None else b""
                view = memoryview(data)
                sizes.append(len(view))
                if own.is_valid and len(own.values):
                    at, n = own.values.field("at").to_numpy() & mask, own.values.field("run").to_numpy().astype(np.int64) % _RUN
                    order = np.argsort(at, kind="stable")
                    low, high = at[order], np.maximum.accumulate((at + n + length - 1)[order])
                    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
                    low, high = low[new], high[np.r_[new[1:] - 1, len(high) - 1]]
                else:
                    low = high = np.zeros(0, dtype=np.int64)
                digest, parts, at = hashlib.sha256(), [], 0
                for i, j in [*zip(low.tolist(), high.tolist(), strict=True), (len(view), len(view))]:
                    digest.update(view[at:i])
                    if with_text:
                        parts.append(bytes(view[at:i]))
                    at = j
                removed.append(int((high - low).sum()))
                spans.append(len(low))
                digests.append(digest.hexdigest())
                kept.append(b"".join(parts))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    done = _with_lists(rows, runs).select("doc", "text", "runs").mapInArrow(remove, schema)
    doc_id = F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id")
    return done.select(doc_id, *done.columns[1:])
