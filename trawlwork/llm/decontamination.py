"""Which documents hold which test items: size-partitioned MinHash containment search, then an exact check.

Only DataFrame expressions. The items are small sets, the documents large ones, so the similarity of whole sets says
nothing; what counts is the share of an item's shingles that a document holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlwork.llm.common import bound, broadcast_if_small, lower_ascii, words
from trawlwork.plans.lineage import cut


def shingles(text: Column, size: int) -> Column:
    """Word shingles, lower-cased (A-Z), as strings; a text of fewer words is one shingle, one without words has none."""
    def joined(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)])

    return bound(words(lower_ascii(text)), lambda w: _windows(w, size, joined, F.concat_ws(" ", w)))


def shingle_hashes(text: Column, size: int) -> Column:
    """As :func:`shingles`, as 64-bit hashes made from those of the words."""
    hashed = F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))

    def combined(h: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(h, i + k) for k in range(size)])

    return bound(hashed, lambda h: _windows(h, size, combined, F.aggregate(h, F.lit(0).cast("long"), lambda a, b: F.xxhash64(a, b))))


def _windows(listed: Column, size: int, value, short: Column) -> Column:
    last = F.size(listed) - size
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: value(listed, i))
    return F.when(last >= 0, many).when(F.size(listed) > 0, F.array(short))


def _sized(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(item_id, shingles, n_shingles, need)``: distinct shingles, and how many of them make a hit. Of an item of fewer than
    ``size`` words all words are one shingle."""
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(shingles(F.col("text"), size))).alias("s"))
    return (
        listed.groupBy("item_id")
        .agg(F.collect_set("s").alias("shingles"))
        .withColumn("n_shingles", F.size("shingles").cast("long"))
        .withColumn("need", F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9).cast("long"))
    )


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``(item_id, size_class, need, s)``: the MinHash sketch of every item.

    Items are partitioned by size in powers of two; a partition's upper bound ``u`` sets its sketch length
    ``k = u - ceil(threshold * u) + 1``, and an item's sketch holds its ``k`` shingles of smallest hash. A document
    that holds the asked share of an item misses fewer than ``k`` of its shingles, so it holds at least one of the
    sketch: the search loses nothing.
    """
    size_class = F.floor(F.log2(F.col("n_shingles").cast("double"))).cast("int")
    upper = F.pow(F.lit(2.0), size_class + 1) - 1
    k = (upper - F.ceil(upper * F.lit(threshold) - 1e-9) + 1).cast("int")
    by_hash = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s"))))
    return items.select("item_id", size_class.alias("size_class"), "need", F.explode(F.slice(by_hash, F.lit(1), k)).alias("m")).select(
        "item_id", "size_class", "need", F.col("m.s").alias("s")
    )


def contaminated_pairs(documents: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)``: every document that holds at least ``threshold`` of the
    distinct word shingles of an item.

    ``documents(doc_id, text)``, ``items(item_id, text)``; other columns are ignored. Texts that are null or hold no
    word, and rows without an id, hit nothing. An item of fewer than ``size`` words is one shingle of as many words and is
    found wherever these words follow each other. Texts of any length are searched whole. Rows that share an id count as one
    document (or item). No rows on either side give no rows.
    """
    found = _sized(items.filter(F.col("item_id").isNotNull()), size, threshold)
    known = cut(found, "items")
    full = known.select("item_id", "n_shingles", "need", F.explode("shingles").alias("s"))
    rows = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Documents are cut into shingles of the asked size, and of the lengths of shorter items where there are any.
    lengths = [size, *sorted(r["n"] for r in full.select(F.size(F.split("s", " ")).alias("n")).filter(F.col("n") < size).distinct().collect())]

    def cut_up(one: Callable[[Column, int], Column], text: Column) -> Column:
        return one(text, size) if len(lengths) == 1 else F.flatten(F.array(*[F.coalesce(one(text, n), F.array().cast(f"array<{'long' if one is shingle_hashes else 'string'}>")) for n in lengths]))

    hashed = rows.select("doc_id", F.explode(cut_up(shingle_hashes, F.col("text"))).alias("h"))
    # A sketch's shingle is hashed as the documents' shingles of its own length are.
    own = F.coalesce(*[F.when(F.size(F.split("s", " ")) == n, shingle_hashes(F.col("s"), n)) for n in lengths])
    posted = sketches(known, threshold).withColumn("h", F.explode(own)).select("h", "item_id").distinct()
    candidates = cut(hashed.join(broadcast_if_small(posted), "h").select("doc_id", "item_id").distinct(), "candidates")
    # The exact check reads the candidates' texts again; only their shingles that some item has go on.
    suspects = candidates.select("doc_id").distinct()
    exact = rows.join(broadcast_if_small(suspects), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(cut_up(shingles, F.col("text")))).alias("s"))
    counted = (
        exact.join(broadcast_if_small(full), "s")
        .groupBy("doc_id", "item_id", "n_shingles", "need")
        .agg(F.count_distinct("s").alias("n_found"))
        .filter(F.col("n_found") >= F.col("need"))
    )
    return counted.join(candidates, ["doc_id", "item_id"], "left_semi").select(
        "doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")
    )


def clean_documents(documents: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that hold no item, with all their columns. Rows without an id stay, and so do null and blank texts.

    Rows that share an id go together. Texts of any length are searched whole; without items all stay.
    """
    hits = cut(contaminated_pairs(documents, items, size, threshold).select(F.col("doc_id").alias("_hit")).distinct(), "hits")
    return documents.join(hits, documents["doc_id"].cast("long") == hits["_hit"], "left_anti")
