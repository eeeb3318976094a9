"""Whitening of embeddings on their leading principal components, found by spectrum slicing.

Entries become whole numbers, so that counts, sums and the covariance are exact, however the rows are dealt. Of the
covariance, at most a few thousand numbers a side, the leading eigenvalues are isolated one by one: the LDL^T factors of
a shifted matrix count, by the signs of their pivots (Sylvester), how many eigenvalues lie above the shift, and shifts are
halved until an interval holds one. Rayleigh quotient iteration from inside the interval converges cubically; the counts
just above and below every value found certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024.0, 100_000
COMPONENTS = 8
#: Numbers beyond this stand for themselves no longer: a double that large has no whole neighbours in a long.
_MOST = 1 << 52
_LIMB = 30
#: Sums of doubles are added as whole numbers of this many to one.
_UNITS = 1 << 40
_PIVOT = (1 + 17**0.5) / 8


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows whose vector is whole, and their entries as whole numbers; missing ends are zeros."""
    lists = batch.column(1)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is NaN
    wrong = np.r_[0, np.cumsum(~np.isfinite(values))]
    lengths = np.diff(offsets)
    good = np.flatnonzero((wrong[offsets[1:]] == wrong[offsets[:-1]]) & np.asarray(lists.is_valid()))
    width = int(lengths[good].max()) if len(good) else 0
    # The place of every entry; those past a shorter vector's end point at an added zero.
    at = offsets[good][:, None] + np.arange(width)
    at[np.arange(width) >= lengths[good][:, None]] = len(values)
    scaled = np.floor(SCALE * np.r_[values, 0.0][at])
    return good, np.clip(scaled, -_MOST, _MOST).astype(np.int64) + OFFSET


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.concatenate([x, np.full((len(x), width - x.shape[1]), OFFSET, dtype=np.int64)], axis=1)


def _limbs(row: list[int], column: list[int], value: list[int]) -> pa.RecordBatch:
    """Whole numbers of any size as rows ``(i, j, limb, v)`` whose sums by limb fit a long."""
    out: list[tuple[int, int, int, int]] = []
    for i, j, v in zip(row, column, value, strict=True):
        sign, rest, limb = (1 if v >= 0 else -1), abs(v), 0
        while rest:
            out.append((i, j, limb, sign * (rest & ((1 << _LIMB) - 1))))
            rest >>= _LIMB
            limb += 1
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", "limb", "v"])


def _summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[tuple[int, int], int]:
    """Exact totals by ``(i, j)`` of what the tasks' ``partial`` sums yield: at most the square of the dimensions."""
    found = rows.mapInArrow(partial, "i long, j long, limb long, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v"))
    totals: dict[tuple[int, int], int] = {}
    for i, j, limb, v in found.collect():
        totals[i, j] = totals.get((i, j), 0) + (v << (_LIMB * limb))
    return totals


def _first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros(0, dtype=object)  # as if all entries beyond a batch's width were the offset
    for batch in batches:
        good, x = _vectors(batch)
        if x.shape[1] > len(total):
            total = np.r_[total, np.full(x.shape[1] - len(total), n * OFFSET, dtype=object)]
        n += len(good)
        if len(good):
            # Halves, so that no sum of a batch leaves a long.
            part = ((x >> _LIMB).sum(axis=0).astype(object) << _LIMB) + (x & ((1 << _LIMB) - 1)).sum(axis=0).astype(object)
            total[: x.shape[1]] += part
            total[x.shape[1] :] += len(good) * OFFSET
    shifted = [int(t) - n * OFFSET for t in total]
    # Row -1: how many rows and dimensions there are.
    yield _limbs([-1, *range(len(shifted)), *[-2] * len(shifted)], [0] * (1 + len(shifted)) + [*range(len(shifted))], [n, *shifted, *[1] * len(shifted)])


def products(y: np.ndarray) -> np.ndarray:
    """The exact sums of products of the columns of whole numbers, as Python's own numbers."""
    most = int(np.abs(y).max()) if y.size else 0
    rows = (1 << 53) // max(1, most * most)
    if not rows:
        wide = y.astype(object)
        return wide.T @ wide
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    for first in range(0, len(y), min(rows, 1 << 16)):
        part = y[first : first + min(rows, 1 << 16)].astype(np.float64)  # every partial sum is a whole number below 2^53
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def negative_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are below zero, from the pivots of LDL^T (Bunch and Kaufman's choice)."""
    a, n, k, negative = matrix.copy(), len(matrix), 0, 0

    def swap(p: int, q: int) -> None:
        a[[p, q]] = a[[q, p]]
        a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        most = below.max() if len(below) else 0.0
        two = False
        if abs(a[k, k]) < _PIVOT * most:
            r = k + 1 + int(below.argmax())
            others = np.abs(a[k:, r])
            others[r - k] = 0
            if abs(a[k, k]) * others.max() < _PIVOT * most * most:
                if abs(a[r, r]) >= _PIVOT * others.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            block, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            negative += 1  # such a block always has one eigenvalue of either sign
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            pivot = a[k, k]
            negative += bool(pivot < 0)
            if pivot:
                rest = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(rest, rest / pivot)
            k += 1
    return negative


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues of a covariance that are not zero to its precision, and unit eigenvectors as columns."""
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    values, vectors = np.zeros(0), np.zeros((n, 0))
    if not norm:
        return values, vectors
    eye, least = np.eye(n), 8 * n * np.finfo(float).eps * norm
    rng = np.random.default_rng(20261201)

    def above(shift: float) -> int:
        return negative_pivots(shift * eye - matrix)

    def iterate(shift: float) -> tuple[float, np.ndarray]:
        x = rng.normal(size=n)
        x, rho, best = x / np.linalg.norm(x), shift, None
        for step in range(40):
            try:
                x = np.linalg.solve(matrix - rho * eye, x)
            except np.linalg.LinAlgError:
                x = np.linalg.solve(matrix - (rho + least / 8) * eye, x)
            for _ in range(2):  # away from what has been found: eigenvalues that agree to the last digits share a space
                x -= vectors @ (vectors.T @ x)
            x /= np.linalg.norm(x)
            quotient = float(x @ matrix @ x)
            rest = np.linalg.norm(matrix @ x - quotient * x)
            if best is not None and step > 3 and rest >= best[0]:
                break
            if best is None or rest < best[0]:
                best = (rest, quotient, x)
            rho = shift if step < 2 else quotient  # first towards the shift, then by the quotient
        return best[1], best[2]

    high = norm * (1 + 1e-12)
    for number in range(1, min(count, n) + 1):
        low, top = 0.0, high
        if above(least) < number:
            break
        in_low, in_top = n, above(top)
        while True:
            isolated = in_low == number and in_top == number - 1
            if isolated or top - low <= least:
                value, vector = iterate((low + top) / 2)
                if low - least <= value <= top + least:
                    break
                if top - low <= least:  # one of several that no shift divides
                    break
            middle = (low + top) / 2
            found = above(middle)
            low, in_low, top, in_top = (middle, found, top, in_top) if found >= number else (low, in_low, middle, found)
        # The counts certify the number; values that agree within the precision of the matrix are told apart by no count.
        if above(value - 4 * least) < number or above(value + 4 * least) >= number:
            raise ArithmeticError(f"component {number} is not certified")
        values, vectors = np.r_[values, value], np.c_[vectors, vector * np.sign(vector[np.abs(vector).argmax()])]
    return values, vectors


class Whitening:
    """Exact count and sums of the fit list, and the leading components of its covariance."""

    def __init__(self, embeddings: DataFrame, components: int = COMPONENTS):
        """``embeddings(vec_id, embedding)``, see :func:`whiten`."""
        rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        self.rows = rows
        first = _summed(rows, _first_sums)
        self.n = n = first.get((-1, 0), 0)
        self.width = width = sum(1 for i, _ in first if i == -2)
        self.sums = [first.get((i, 0), 0) + n * OFFSET for i in range(width)]
        middle = np.array([(2 * s + n) // (2 * n) for s in self.sums], dtype=np.int64) if n else np.zeros(0, dtype=np.int64)
        rest = [s - n * int(m) for s, m in zip(self.sums, middle, strict=True)]
        self.middle, self.rest = middle, rest
        self.values, self.vectors, self.trace = np.zeros(0), np.zeros((width, 0)), 0.0
        self.identity_error = 0.0
        if not n or not width:
            return

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width), dtype=object)
            for batch in batches:
                good, x = _vectors(batch)
                if len(good):
                    total += products(_widened(x, width) - middle)
            upper = np.triu_indices(width)
            yield _limbs(*(u.tolist() for u in upper), [int(v) for v in total[upper]])

        sums = _summed(rows, second)
        # Centred on whole numbers; what is left of the means, less than one half each, is taken off exactly too.
        covariance = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                covariance[i, j] = covariance[j, i] = (n * sums.get((i, j), 0) - rest[i] * rest[j]) / (n * n)
        self.trace = float(covariance.trace())
        self.values, self.vectors = leading_components(covariance, components)
        self._measure()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.middle) - np.array([r / self.n for r in self.rest])
        return centred @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> pa.Array:
        """``sum((n x - S)^2)``, exact; null where it does not fit a long."""
        y = x - self.middle
        most = self.n * int(np.abs(y).max()) + max(map(abs, self.rest)) if y.size else 0
        if self.width * most * most < 1 << 63:
            whole = self.n * y - np.array(self.rest, dtype=np.int64)
            return pa.array((whole * whole).sum(axis=1), pa.int64())
        exact = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in y]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def _plain(self) -> Whitening:
        """Without the table, for the tasks."""
        copy = object.__new__(Whitening)
        copy.__dict__.update({k: v for k, v in self.__dict__.items() if k != "rows"})
        return copy

    def _measure(self) -> None:
        """Whether the whitened rows are uncorrelated and of variance one, measured on all of them."""
        k = len(self.values)
        if not k:
            return
        own, width = self._plain(), self.width

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for batch in batches:
                good, x = _vectors(batch)
                if len(good):
                    w = own.whitened(_widened(x, width))
                    total += np.r_[w.T @ w, w.sum(axis=0)[None, :]]
            places = np.indices(total.shape).reshape(2, -1).tolist()
            yield _limbs(*places, [int(v) for v in np.rint(total.reshape(-1) * _UNITS)])

        sums = _summed(self.rows, moments)
        total = np.array([[sums.get((i, j), 0) / (_UNITS * self.n) for j in range(k)] for i in range(k + 1)])
        self.identity_error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())

    def transform(self) -> DataFrame:
        """The rows of :func:`whiten`."""
        own, width, k = self._plain(), self.width, len(self.values)
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, x = _vectors(batch)
                if not len(good) or not k:
                    continue
                x = _widened(x, width)
                each = pa.array(np.repeat(np.arange(len(good)), k))
                m = len(good) * k
                columns = [
                    batch.column(0).take(pa.array(good)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(good))),
                    pa.array(np.full(m, own.n, dtype=np.int64)),
                    own.deviations(x).take(each),
                    pa.array(own.whitened(x).reshape(-1)),
                    pa.array(np.tile(own.values / own.trace, len(good))),
                    pa.array(np.full(m, own.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return self.rows.mapInArrow(rows, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every whole vector of
    ``embeddings(vec_id, embedding)`` and every one of its leading components.

    Vectors that are null or hold null or non-finite entries are left out. An entry ``c`` counts as
    ``floor(1024 c) + 100000``, beyond 2^52 as 2^52; a vector shorter than the longest one goes on with zeros. ``n`` rows with
    sums S are the fit list. ``deviation`` is the exact sum of ``(n x - S)^2``, null where no long holds it. Components are
    numbered from 1 by falling variance; directions without variance, to the precision of the covariance, are no
    components, so that fewer rows than dimensions, or equal rows, give fewer components, and one row, or none, no
    rows at all. Null and repeated ids are rows like all others; other columns are ignored. The driver holds the covariance:
    the square of the dimensions, whatever the number of rows.
    """
    return Whitening(embeddings, components).transform()
