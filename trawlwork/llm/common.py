"""Small shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

SPACE = r"[\x20\x09-\x0D]+"
#: The bytes that separate words, and the bytes A-Z lower-cased.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Work on this many bytes of text at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 20
#: Rows of a narrow table that may travel to every task: about 16 MB.
BROADCAST_ROWS = 500_000
#: Bytes of its texts at most.
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)  # then the faster lower() is the same
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bound(value: Column, function) -> Column:
    """``function(value)`` with the value computed once, also where ``function`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def release(spark: SparkSession) -> None:
    """Let the driver forget finished plans, so that Spark removes their shuffle files.

    Called after a written table replaces the plan that made it; otherwise the files of all earlier steps stay on
    the executors' disks until the driver's next garbage collection.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS, text_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if its counted rows, and the bytes of its texts, are within the bounds; else joined by a shuffle."""
    wide = [F.octet_length(f"`{f.name}`") for f in table.schema if isinstance(f.dataType, (StringType, BinaryType))]
    held = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0)).cast("long")
    n, size = table.select(held.alias("held")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("held"), F.lit(0))).first()
    return F.broadcast(table) if n <= rows and size <= text_bytes else table


def grouped_tables(batches, keys: list[str]):
    """The rows of sorted batches, one table per run of equal ``keys``; at most one group is held besides a batch."""
    held: list[pa.Table] = []
    before = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        new = np.zeros(len(batch), dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), len(batch)]
        table = pa.Table.from_batches([batch])
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            here = tuple(c[i] for c in columns)
            if held and here != before:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(i, j - i))
            before = here
    if held:
        yield pa.concat_tables(held)


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """``(first, last, data, offsets)`` of consecutive texts: their bytes without copies, null as empty.

    Every chunk holds at most ``limit`` bytes, or a single text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1]
    offsets = offsets.astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8) if whole is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
