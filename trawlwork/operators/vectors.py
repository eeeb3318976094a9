"""Similarity of whole tables of vectors or phrases."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlwork.functions.text import normalize_phrase, word_ngrams
from trawlwork.functions.urls import NOT_BLANK
from trawlwork.functions.vectors import Embedding, as_matrix, embed_rows, list_array, trigram_embedding, unit_rows
from trawlwork.plans.lineage import cut
from trawlwork.plans.skew import numbered
from trawlwork.settings import MAX_NGRAM, MAX_TARGET_PHRASES, TILE_BLOCK_ROWS

# Left vectors of one comparison task when both sides are large.
_TASK_ROWS = 20_000
# Scores that are written as text at a time.
_WRITTEN = 1 << 16


def normalize_phrases(phrases: DataFrame, column: str = "phrase") -> DataFrame:
    """Distinct lower-cased, stripped, non-empty phrases."""
    # Testing the raw phrase keeps the normalized form from being computed for a filter and again after it.
    filled = phrases.filter(F.col(column).rlike(NOT_BLANK))
    return filled.select(normalize_phrase(F.col(column)).alias("phrase")).distinct()


def phrase_universe(items: DataFrame, max_n: int = MAX_NGRAM) -> DataFrame:
    """Every phrase that scoring ``items(item, ingredients)`` needs a vector for, once."""
    names = items.select(normalize_phrase(F.col("item")).alias("phrase"))
    # Distinct ingredients first: n-grams are made once per ingredient text, not once per item.
    texts = items.select(F.explode("ingredients").alias("text")).distinct()
    grams = texts.select(F.explode(word_ngrams(F.array("text"), max_n)).alias("phrase"))
    return names.unionByName(grams).filter(F.col("phrase") != "").distinct()


def embed_phrases(phrases: DataFrame, embed: Embedding = trigram_embedding) -> DataFrame:
    """``(phrase, embedding)`` for distinct phrases; a phrase that cannot be embedded is absent."""
    return embed_rows(phrases, embed)


def pairwise_similarity(left: DataFrame, right: DataFrame, key: str, right_key: str, limit: int = MAX_TARGET_PHRASES) -> DataFrame:
    """The similarity matrix of ``left(key, embedding)`` with ``right(right_key, embedding)``.

    One row per left vector: ``scores`` holds its similarity to every right vector, in ``right_key`` order. Up to ``limit`` right
    vectors ride along with the tasks; more are met tile by tile (:func:`similarity_tiles`) and put together per row.
    """
    rows = right.select(right_key, "embedding").limit(limit + 1).collect()
    if len(rows) > limit:
        own = cut(left.select(F.col(key).alias("_key"), "embedding", F.monotonically_increasing_id().alias("_row")), "left-vectors")
        tiles = similarity_tiles(own.select("_row", "embedding"), right, "_row", right_key, limit)
        joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("tile", "scores"))), lambda t: t["scores"]))
        whole = tiles.groupBy("_row").agg(joined.alias("scores"))
        return own.join(whole, "_row").select(F.col("_key").alias(key), "scores")
    rows = right.select(right_key, "embedding").orderBy(right_key).collect()
    targets = unit_rows(as_matrix([r["embedding"] for r in rows], None))

    @F.pandas_udf("array<double>")
    def score(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(unit_rows(as_matrix(vectors.tolist(), targets.shape[1])) @ targets.T))

    return left.select(key, score("embedding").alias("scores"))


def _blocks_by_tiles(left: DataFrame, right: DataFrame, width: int | None, tile_rows: int, block_rows: int, compare, schema: str) -> DataFrame:
    """``compare(block, its unit rows, tile, its unit rows, number of the tile)`` for every block of ``left`` and tile of the numbered ``right``.

    Both sides are shuffled once and packed, a row a block of about ``block_rows``; every left block meets every right one in a
    cross join that reads both again and copies neither, and a task holds one tile's results at a time. A pair of blocks makes its
    unit rows once, for all its tiles. ``compare`` takes the columns of both by name, Arrow arrays, and gives those of its result.
    """
    together = tile_rows * max(1, block_rows // tile_rows)

    def packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
        columns = F.struct(*[c for c in rows.columns if c != "block"])
        return rows.repartition(blocks, "block").groupBy("block").agg(F.collect_list(columns).alias(name)).select(name)

    # Small left sides lie in smaller blocks, so that all tasks have some.
    n, tasks = left.count(), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left_blocks, right_blocks = max(1, -(-n // block_rows), min(n, tasks)), max(1, -(-right.count() // together))
    lefts = packed(left.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(left_blocks))), left_blocks, "left")
    rights = packed(right.withColumn("block", F.floor(F.col("number") / together)), right_blocks, "right")

    def unpacked(lists: pa.ListArray, row: int) -> pa.Table:
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(lists.slice(row, 1).flatten())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                some_left, some_right = unpacked(batch.column("left"), row), unpacked(batch.column("right"), row).sort_by("number")
                units = _BlockUnits(some_left, width), _BlockUnits(some_right, width)
                tile = some_right.column("number").to_numpy() // tile_rows
                edges = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
                for first, last in zip(edges[:-1], edges[1:], strict=True):
                    left_units, right_units = _units_of(*units, first, last)
                    found = compare(some_left, left_units, some_right.slice(first, last - first), right_units, int(tile[first]))
                    yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    return lefts.crossJoin(rights.hint("shuffle_replicate_nl")).mapInArrow(meet, schema)


def _units(vectors: pa.ChunkedArray, width: int | None) -> np.ndarray:
    lists = vectors.combine_chunks()
    flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(lists) and not lists.null_count and not flat.null_count and lengths[0] and (lengths == (width or lengths[0])).all():
        return unit_rows(flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64))
    return unit_rows(as_matrix(vectors.to_pandas().tolist(), width))


class _BlockUnits:
    """Unit rows of a block's vectors, made once for each width that is asked for."""

    def __init__(self, block: pa.Table, width: int | None):
        self.vectors, self.width = block.column("embedding"), width
        self.made: dict[int, np.ndarray] = {}

    def of_width(self, width: int) -> np.ndarray:
        if width not in self.made:
            self.made[width] = _units(self.vectors, width)
        return self.made[width]


def _units_of(left: _BlockUnits, right: _BlockUnits, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the left block, and of rows ``first .. last - 1`` of the right one; without a stated width a tile's own counts."""
    tile = _units(right.vectors.slice(first, last - first), None) if right.width is None else right.of_width(right.width)[first:last]
    return left.of_width(tile.shape[1]), tile


@lru_cache(maxsize=4)
def _number_texts(decimals: int) -> tuple[np.ndarray, np.ndarray]:
    """A space and the text of ``0, 1, 2 .. 10**decimals`` units of the last place, then of the same with a minus, then of null; their
    lengths."""
    places = [f"{n // 10**decimals}.{n % 10**decimals:0{decimals}}" for n in range(10**decimals + 1)]
    texts = np.array([f" {sign}{t}" for sign in ("", "-") for t in places] + [" null"], dtype=f"S{max(8, decimals + 4)}")
    return texts, np.char.str_len(texts).astype(np.int8)


def _number_text(value: float, decimals: int) -> str:
    if np.isfinite(value):
        return f"{Decimal(repr(value)).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP):f}"
    return "null" if np.isnan(value) else "Infinity" if value > 0 else "-Infinity"


def written_scores(scores: np.ndarray, decimals: int) -> pa.Array:
    """Each row of scores as text: numbers of so many decimals with a space between them, ``null`` for NaN.

    As ``format_string('%.4f')`` writes them: halves of the shortest decimal form go up, away from zero, and a minus stays at zero.
    The texts come from a table, since a similarity is 1 at most but for numbers too small to square; near a half the decimal form
    is asked.
    """
    (texts, lengths), one = _number_texts(decimals), 10**decimals
    whole = texts.view(np.uint64) if texts.itemsize == 8 else texts
    pieces, sizes = [], []
    step = max(1, _WRITTEN // max(1, scores.shape[1]))
    for first in range(0, len(scores), step):
        some = scores[first : first + step]
        missing = np.isnan(some)
        size = np.where(missing, 0.0, np.abs(some)) * one + 0.5
        units = np.floor(size)
        close = np.abs(np.minimum(size, one + 1) - np.rint(np.minimum(size, one + 1))) < 1e-9
        if close.any():
            for at in zip(*np.nonzero(close), strict=True):
                units[at] = float(_number_text(abs(float(some[at])), decimals).replace(".", ""))
        if not (units <= one).all():
            lines = [" ".join(_number_text(x, decimals) for x in row).encode() for row in some.tolist()]
            pieces.append(b"".join(lines))
            sizes.append(np.array(list(map(len, lines)), dtype=np.int64))
            continue
        number = units.astype(np.int32) + np.signbit(some) * np.int32(one + 1)
        number[missing] = len(texts) - 1
        letters = whole.take(number).view(np.uint8).reshape(len(some), -1)
        letters[:, :1] = 0  # no space before a row's first number
        pieces.append(letters.tobytes().translate(None, b"\0"))
        sizes.append(lengths.take(number).sum(axis=1, dtype=np.int64) - (scores.shape[1] > 0))
    ends = np.cumsum(np.concatenate([np.zeros(1, dtype=np.int64), *sizes]))
    return pa.LargeStringArray.from_buffers(len(scores), pa.py_buffer(ends), pa.py_buffer(b"".join(pieces))).cast(pa.string())


def similarity_tiles(
    left: DataFrame, right: DataFrame, key: str, right_key: str, tile_rows: int = MAX_TARGET_PHRASES, block_rows: int = TILE_BLOCK_ROWS, decimals: int | None = None
) -> DataFrame:
    """``(key, tile, scores)``: the similarity matrix in pieces; tile ``t`` holds the scores of the right vectors ``t * tile_rows`` and
    following, in ``right_key`` order. Neither side nor a row of the matrix is ever in one place.

    With ``decimals`` the scores are text (:func:`written_scores`), made where they are computed."""
    placed = cut(numbered(right.select(right_key, "embedding"), [right_key]), "numbered-right")
    first = placed.filter("number = 0").select("embedding").first()
    width = len(first[0]) if first and first[0] is not None else None
    kind = left.schema[key].dataType.simpleString()

    def compare(some_left: pa.Table, left_units: np.ndarray, some_right: pa.Table, right_units: np.ndarray, tile: int) -> dict[str, pa.Array]:
        scores = left_units @ right_units.T
        keys = some_left.column(key).combine_chunks()
        shown = list_array(scores, np.isnan(scores)) if decimals is None else written_scores(scores, decimals)
        return {key: keys, "tile": pa.array(np.full(len(keys), tile, dtype=np.int32)), "scores": shown}

    schema = f"{key} {kind}, tile int, scores {'array<double>' if decimals is None else 'string'}"
    return _blocks_by_tiles(left.select(key, "embedding"), placed.select("number", "embedding"), width, tile_rows, block_rows, compare, schema)


def best_by_group(vectors: DataFrame, targets: DataFrame, tile_rows: int = MAX_TARGET_PHRASES, block_rows: int = TILE_BLOCK_ROWS) -> DataFrame:
    """``(phrase, best)``: for ``vectors(phrase, embedding)``, distinct by phrase, the greatest similarity to a target of every group.

    ``targets(group, embedding)`` may be of any number: they are met tile by tile, and a task gives one row per phrase and group of
    its tile. ``best`` maps groups to scores; null targets and those with nulls have no say, null vectors no row.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    placed = cut(numbered(targets.select("group", "embedding").filter(whole), ["group"]), "numbered-targets")
    first = placed.filter("number = 0").select("embedding").first()
    width = len(first[0]) if first else 1

    def compare(some_left: pa.Table, left_units: np.ndarray, some_right: pa.Table, right_units: np.ndarray, tile: int) -> dict[str, pa.Array]:
        scores = left_units @ right_units.T
        groups = some_right.column("group").to_pandas().to_numpy()
        edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        best = np.maximum.reduceat(scores, edges, axis=1).reshape(-1)
        phrases = some_left.column("phrase").combine_chunks().take(pa.array(np.repeat(np.arange(len(some_left)), len(edges))))
        return {"phrase": phrases, "group": pa.array(np.tile(groups[edges], len(some_left)), pa.string()), "score": pa.array(best, mask=np.isnan(best))}

    pairs = _blocks_by_tiles(vectors.filter("embedding is not null").select("phrase", "embedding"), placed, width, tile_rows, block_rows, compare, "phrase string, group string, score double")
    maxima = pairs.groupBy("phrase", "group").agg(F.max("score").alias("score"))
    return maxima.groupBy("phrase").agg(F.map_from_entries(F.collect_list(F.struct("group", "score"))).alias("best"))


def max_similarity(left: DataFrame, right: DataFrame, key: str, limit: int = MAX_TARGET_PHRASES) -> DataFrame:
    """Per left vector the highest similarity to any right vector.

    ``(key, score)``, one row per left row, also for repeated keys. Right vectors that are null or hold nulls are left out, as
    among target phrases; without any the score is null. A pair of different lengths scores 0. Up to ``limit`` distinct
    right vectors ride along with the tasks. Beyond that both sides are cut into blocks, every pair of blocks is one
    task, and only each distinct left vector's best score leaves it.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    right = right.select("embedding").filter(whole).distinct()
    rows = right.limit(limit + 1).collect()
    if len(rows) <= limit:
        targets = _by_length([r["embedding"] for r in rows])

        @F.pandas_udf("double")
        def best(vectors: pd.Series) -> pd.Series:
            return pd.Series(_best_scores(vectors.tolist(), targets))

        return left.select(key, best("embedding").alias("score"))

    task_rows = min(_TASK_ROWS, limit)
    right_blocks = -(-right.count() // limit)
    lefts = left.select("embedding").distinct()
    left_blocks = max(1, -(-lefts.count() // task_rows))

    def split(df: DataFrame, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64("embedding"), F.lit(blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<bigint>"))
        )

    def compare(some_left: pd.DataFrame, some_right: pd.DataFrame) -> pd.DataFrame:
        scores = _best_scores(some_left["embedding"].tolist(), _by_length(some_right["embedding"].tolist()))
        return pd.DataFrame({"embedding": some_left["embedding"], "score": scores})

    kind = left.schema["embedding"].dataType.simpleString()
    # Blocks hold distinct vectors, so copies cannot swell one block.
    partial = (
        split(lefts, "lb", left_blocks, "rb", right_blocks)
        .groupBy("lb", "rb")
        .cogroup(split(right, "rb", right_blocks, "lb", left_blocks).groupBy("lb", "rb"))
        .applyInPandas(compare, f"embedding {kind}, score double")
    )
    scored = partial.groupBy(F.col("embedding").alias("_vector")).agg(F.max("score").alias("score"))
    return left.join(scored, F.col("embedding").eqNullSafe(F.col("_vector")), "left").select(key, "score")


def _by_length(vectors: list) -> dict[int, np.ndarray]:
    """Unit rows of the vectors of each length."""
    lengths: dict[int, list] = {}
    for vector in vectors:
        lengths.setdefault(len(vector), []).append(vector)
    return {n: unit_rows(as_matrix(rows, n)) for n, rows in lengths.items()}


def _best_scores(vectors: list, targets: dict[int, np.ndarray]) -> list[float | None]:
    """The highest similarity of each vector to any target; None for a null vector or without targets."""
    out: list[float | None] = [None] * len(vectors)
    if not targets:
        return out
    lengths: dict[int, list[int]] = {}
    for place, vector in enumerate(vectors):
        if vector is not None:
            lengths.setdefault(len(vector), []).append(place)
    for n, places in lengths.items():
        scores = np.zeros(len(places))
        if n in targets:
            scores = (unit_rows(as_matrix([vectors[p] for p in places], n)) @ targets[n].T).max(axis=1)
            # Among targets of other lengths, which score 0.
            scores = np.maximum(scores, 0) if len(targets) > 1 else scores
        for place, score in zip(places, scores.tolist(), strict=True):
            out[place] = None if np.isnan(score) else score
    return out
