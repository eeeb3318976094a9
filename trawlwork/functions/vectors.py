"""Vectors of phrases and their similarity.

Vector arithmetic runs in numpy on Arrow batches; only the few target phrases travel with the tasks. These
steps are ``mapInArrow`` stages, so the optimizer can neither repeat them nor fold them into expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 256
# Phrases handled at once: bounds a task's memory whatever the length of a batch's phrase lists.
_BLOCK = 8192

# Takes phrases, returns one vector per phrase; None stands for a phrase without a vector.
Embedding = Callable[[Sequence[str]], Sequence]


def trigram_embedding(phrases: Sequence[str]) -> np.ndarray:
    """Deterministic default: counts of hashed character trigrams of the phrase between two spaces."""
    if not len(phrases):
        return np.zeros((0, DIMENSIONS), dtype=np.float32)
    padded = [f" {p} " for p in phrases]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    bucket = (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) % DIMENSIONS
    inside = row[:-2] == row[2:]
    cells = row[:-2][inside] * DIMENSIONS + bucket[inside]
    counts = np.bincount(cells, minlength=len(padded) * DIMENSIONS)
    return counts.reshape(len(padded), DIMENSIONS).astype(np.float32)


def as_matrix(vectors: Sequence, dimensions: int | None) -> np.ndarray:
    """Stack vectors; a missing one becomes NaN, one of the wrong length zeros (similarity 0)."""
    if isinstance(vectors, np.ndarray) and vectors.ndim == 2:
        if dimensions is None or vectors.shape[1] == dimensions:
            return vectors.astype(np.float64)
    try:
        stacked = np.stack(vectors).astype(np.float64)
        if stacked.ndim == 2 and dimensions in (None, stacked.shape[1]):
            return stacked
    except (ValueError, TypeError):
        pass
    if dimensions is None:
        dimensions = next((len(v) for v in vectors if v is not None), 1)
    out = np.zeros((len(vectors), dimensions))
    for i, vector in enumerate(vectors):
        if vector is None:
            out[i] = np.nan
        elif len(vector) == dimensions:
            out[i] = vector
    return out


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=matrix.copy(), where=norms > 0)


class Targets:
    """Phrases to compare with, by group (an attribute, or the one group of URL keywords)."""

    def __init__(self, groups: dict[str, list[str]], embed: Embedding):
        self.names = list(groups)
        phrases, owner = [], []
        for index, name in enumerate(self.names):
            for phrase in groups[name]:
                if phrase:
                    phrases.append(phrase)
                    owner.append(index)
        vectors = list(embed(phrases)) if phrases else []
        present = [i for i, v in enumerate(vectors) if v is not None and not np.isnan(v).any()]
        self.owner = np.array([owner[i] for i in present], dtype=int)
        self.unit = unit_rows(as_matrix([vectors[i] for i in present], None)) if present else np.zeros((0, 1))

    def best(self, vectors: Sequence) -> np.ndarray:
        """Highest similarity of each vector to each group; NaN for a missing vector or an empty group."""
        out = np.full((len(vectors), len(self.names)), np.nan)
        if len(self.owner) and len(vectors):
            scores = unit_rows(as_matrix(vectors, self.unit.shape[1])) @ self.unit.T
            for group in range(len(self.names)):
                mine = scores[:, self.owner == group]
                if mine.shape[1]:
                    out[:, group] = mine.max(axis=1)
        return out


def list_array(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Rows of a matrix as Arrow lists; ``missing`` cells become null."""
    offsets = np.arange(0, values.size + 1, values.shape[1] or 1, dtype=np.int32)[: len(values) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), mask=missing.ravel()))


def _best_of_lists(lists: pa.Array, targets: Targets, embed: Embedding) -> pa.Array:
    """Per list of phrases and group, the highest similarity; each distinct phrase is embedded once."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    encoded = lists.flatten().dictionary_encode()
    phrases = np.array(encoded.dictionary.to_pylist(), dtype=object)
    scores = np.full((len(phrases), len(targets.names)), np.nan)
    for start in range(0, len(phrases), _BLOCK):
        block = phrases[start : start + _BLOCK]
        scores[start : start + _BLOCK] = targets.best(embed(list(block)))
    scores[np.isnan(scores) | (phrases == "")[:, None]] = -np.inf
    best = np.full((len(lengths), len(targets.names)), -np.inf)
    filled = lengths > 0
    if filled.any():
        rows = scores[encoded.indices.to_numpy(zero_copy_only=False)]
        best[filled] = np.maximum.reduceat(rows, (np.cumsum(lengths) - lengths)[filled])
    return list_array(best, np.isinf(best))


def with_best_similarity(
    df: DataFrame, phrases: Column, groups: dict[str, list[str]], embed: Embedding, name: str
) -> DataFrame:
    """``df`` plus ``name array<double>``: the highest cosine similarity of each row's phrase list to each
    group, null where there is none. One narrow stage; the target vectors are made once, on the driver.
    """
    targets = Targets(groups, embed)
    kept = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = _best_of_lists(batch.column("_phrases"), targets, embed)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], best], [*kept, name])

    return df.withColumn("_phrases", phrases).mapInArrow(score, schema)


def embed_rows(phrases: DataFrame, embed: Embedding) -> DataFrame:
    """``(phrase, embedding)`` of ``phrases(phrase)``, without rows whose phrase cannot be embedded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [p for p in batch.column("phrase").to_pylist() if p]
            for start in range(0, len(wanted), _BLOCK):
                block = wanted[start : start + _BLOCK]
                vectors = embed(block)
                if isinstance(vectors, np.ndarray) and vectors.ndim == 2:
                    present = np.ascontiguousarray(vectors, dtype=np.float32)
                    lists = list_array(present, np.isnan(present))
                else:
                    pairs = [(p, np.asarray(v, np.float32)) for p, v in zip(block, vectors, strict=True) if v is not None]
                    block, vectors = [p for p, _ in pairs], [v for _, v in pairs]
                    lists = pa.array(vectors, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.string()), lists], ["phrase", "embedding"])

    return phrases.select("phrase").mapInArrow(run, "phrase string, embedding array<float>")


def score_vectors(vectors: DataFrame, targets: Targets) -> DataFrame:
    """``(phrase, best)`` of ``vectors(phrase, embedding)``: similarity of each vector to each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = targets.best(batch.column("embedding").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("phrase"), list_array(best, np.isnan(best))], ["phrase", "best"]
            )

    return vectors.select("phrase", "embedding").mapInArrow(run, "phrase string, best array<double>")


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors in double precision; 0 for a zero vector or unequal lengths."""
    norms = F.sqrt(_dot(left, left)) * F.sqrt(_dot(right, right))
    same = F.size(left) == F.size(right)
    return F.when(same & (norms > 0), _dot(left, right) / norms).otherwise(F.lit(0.0))
