"""Toxicity: words as bags of subword vectors, texts as averages of their words, a softmax on top, trained jointly.

A misspelled word that was never seen still has most of its character n-grams in common with the words it comes from.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlwork.llm.common import training_fold
from trawlwork.plans.lineage import cut

BUCKETS = 1 << 17
DIMENSIONS = 4
GRAMS = (3, 4, 5)
EPOCHS = 60
#: Labelled rows that are learned from at most, of each class, and the longest text among them in bytes. Chosen by a
#: hash of the id; this bounds what reaches the driver.
SAMPLE_ROWS = 4000
SAMPLE_TEXT_BYTES = 12_000
THRESHOLD = 0.7
#: A subword's vector is shrunk by how many standard errors lie between the shares of documents that hold it, toxic and not:
#: to a half at ``HALF``, to next to nothing where chance would do, else with few labels single documents are learned by
#: heart. There is no cut that a small table could not reach. What would be shrunk below ``LEAST`` is not trained.
HALF, LEAST = 4.0, 0.05
#: Rows that the folds of the calibration train on in all, about: 2 folds at least, 8 at most.
FOLD_ROWS = 2000
#: Words whose values a Python worker remembers; longer ones are worked out each time, so that this bounds bytes too.
REMEMBERED, LONG_WORD = 200_000, 64
#: Entries of the sample's tables that training works on at a time.
AT_ONCE = 1 << 19

_WORD = re.compile(r"\w+")


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the character n-grams of ``<word>`` and of the word itself."""
    marked = f"<{word}>"
    grams = [marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, text_bytes: int) -> list[tuple[str, int]]:
    """``(text, label)`` of the first ``rows`` rows of each class, from the training fold only, for the driver.

    Taken in the order of a hash of the id and one of the text, among the labelled documents of at most ``text_bytes`` bytes: reruns
    learn from the same rows. Labels that are null or neither 0 nor 1 teach nothing. An id that is labelled more than once counts
    with its highest label. Only ids and hashes are joined and sorted; the chosen rows' texts are read after that.
    """
    known = labels.filter(training_fold(F.col("doc_id")) & F.col(label).isin(0, 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    short = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").filter(F.octet_length("text") <= text_bytes)
    there = short.select("doc_id", "mark").join(known, "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("mark")]
    chosen = cut(reduce(DataFrame.unionByName, (there.filter(F.col("label") == k).orderBy(*order).limit(rows) for k in (0, 1))), "labelled-sample")
    found = short.join(F.broadcast(chosen), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + count - 1`` of every pair, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _slices(edges: np.ndarray) -> list[tuple[int, int, slice]]:
    """Runs of consecutive groups that hold at most ``AT_ONCE`` entries together, or one group, and where their entries are."""
    first, found = 0, []
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + AT_ONCE, side="right")) - 1)
        found.append((first, last, slice(int(edges[first]), int(edges[last]))))
        first = last
    return found


def _sums(values: np.ndarray, source: np.ndarray, edges: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``values[:, source]`` over consecutive groups of entries, none empty; a bounded number of entries at a time."""
    out = np.zeros((len(values), len(edges) - 1))
    for first, last, at in _slices(edges):
        own, starts, factor = source[at], edges[first:last] - at.start, 1 if scale is None else scale[at]
        for d, row in enumerate(values):
            out[d, first:last] = np.add.reduceat(row[own] * factor, starts)
    return out


def _spread(values: np.ndarray, source: np.ndarray, index: np.ndarray, width: int, scale: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``values[:, source]`` by ``index``."""
    out = np.zeros((len(values), width))
    for first in range(0, len(index), AT_ONCE):
        own, to = source[first : first + AT_ONCE], index[first : first + AT_ONCE]
        factor = 1 if scale is None else scale[first : first + AT_ONCE]
        for d, row in enumerate(values):
            out[d] += np.bincount(to, row[own] * factor, width)
    return out


class Sample:
    """Labelled texts as numbers: their words with shares, and the words' subwords, told once for all models trained on them."""

    def __init__(self, rows: list[tuple[str, int]]):
        numbers: dict[str, int] = {}
        words, shares, labels = [], [], []
        for text, label in rows:
            found = words_of(text)
            if found:
                own, n = np.unique(np.array([numbers.setdefault(w, len(numbers)) for w in found], dtype=np.int32), return_counts=True)
                words.append(own)
                shares.append((n / len(found)).astype(np.float32))
                labels.append(label)
        self.label = np.array(labels, dtype=np.int64)
        self.edges = np.cumsum([0, *map(len, words)])
        self.word = np.concatenate([np.zeros(0, dtype=np.int32), *words])
        self.share = np.concatenate([np.zeros(0, dtype=np.float32), *shares])
        pieces = array("i")
        counts = []
        for w in numbers:
            own = subwords(w)
            pieces.extend(own)
            counts.append(len(own))
        self.piece = np.frombuffer(pieces, dtype=np.int32) if len(pieces) else np.zeros(0, dtype=np.int32)
        self.piece_count = np.array(counts, dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_count) - self.piece_count
        self.doc = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(self.edges))
        self.piece_word = np.repeat(np.arange(len(counts), dtype=np.int32), self.piece_count)

    def holding(self, docs: np.ndarray) -> np.ndarray:
        """How many of these texts hold each subword."""
        count = np.zeros(BUCKETS, dtype=np.int64)
        for i in docs:
            own = self.word[self.edges[i] : self.edges[i + 1]]
            seen = np.zeros(BUCKETS, dtype=bool)
            seen[self.piece[_ranges(self.piece_start[own], self.piece_count[own])]] = True
            count += seen
        return count

    def margins(self, model: SubwordModel, docs: np.ndarray) -> np.ndarray:
        """Log odds of these texts, as :meth:`SubwordModel.margins` finds them."""
        value = _sums(model.weights[None, :], self.piece, np.r_[self.piece_start, len(self.piece)])[0] / np.maximum(self.piece_count, 1)
        return np.array([self.share[self.edges[i] : self.edges[i + 1]] @ value[self.word[self.edges[i] : self.edges[i + 1]]] for i in docs]) + model.bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a balanced logistic fit; targets are drawn in by the number of rows, so that it stays finite."""
    counts = np.bincount(label, minlength=2)
    wanted = np.where(label == 1, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    weight = 0.5 / counts[label]
    spread = margin.std() or 1.0
    rows = np.stack([margin / spread, np.ones(len(margin))], axis=1)
    fit = np.zeros(2)
    for _ in range(50):
        odds = 1 / (1 + np.exp(-np.clip(rows @ fit, -30, 30)))
        slope = rows.T @ (weight * (odds - wanted)) + 1e-3 * fit
        curve = (rows * (weight * odds * (1 - odds))[:, None]).T @ rows + 1e-3 * np.eye(2)
        fit -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return max(float(fit[0]), 0.0) / spread, float(fit[1])


class _Known(dict):
    """Values of words, worked out when they are first asked for; long words are not kept."""

    def __init__(self, value: Callable[[str], float]):
        super().__init__()
        self.value = value

    def __missing__(self, word: str) -> float:
        value = self.value(word)
        if len(word) <= LONG_WORD:
            self[word] = value
        return value


class SubwordModel:
    """Trained in numpy; afterwards a word's weight is the mean over its subwords of what the softmax makes of their vectors."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def train(cls, sample: Sample | list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 20260102, docs: np.ndarray | None = None) -> SubwordModel:
        """``docs``: the texts of the sample that are learned from, all without it. The gradient is that of all of them; what is
        held of words and texts at a time is bounded."""
        sample = sample if isinstance(sample, Sample) else Sample(sample)
        docs = np.arange(len(sample.label)) if docs is None else docs
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
        output = rng.normal(0, 0.5, (DIMENSIONS, 2))
        bias = np.zeros(2)
        target = sample.label[docs]
        if not len(target) or target.min() == target.max():  # nothing to tell apart
            share = (target.sum() + 0.5) / (len(target) + 1) if len(target) else 0.0
            return cls(np.zeros(BUCKETS, dtype=np.float32), float(np.log(share / (1 - share))) if share else -20.0)
        rows = np.bincount(target, minlength=2)[:, None]
        holding = np.stack([sample.holding(docs[target == k]) for k in (0, 1)])
        overall = holding.sum(axis=0) / rows.sum()
        error = np.sqrt(overall * (1 - overall) * (1 / rows).sum() + 1e-12)
        strength = (np.abs(holding[1] / rows[1] - holding[0] / rows[0]) / (HALF * error)) ** 4
        shrunk = strength / (strength + 1)
        used = shrunk >= LEAST
        shrunk = np.where(used, shrunk, 0)[:, None]
        # Words of these texts with a subword that counts, numbered anew; the mean is over all subwords of a word.
        found = np.flatnonzero(used[sample.piece])
        piece, owner = sample.piece[found], sample.piece_word[found]
        number = np.full(len(sample.label), -1, dtype=np.int32)
        number[docs] = np.arange(len(docs), dtype=np.int32)
        kept = np.zeros(len(sample.piece_count), dtype=bool)
        kept[owner] = True
        entry = np.flatnonzero((number[sample.doc] >= 0) & kept[sample.word])
        word, share, doc = sample.word[entry], sample.share[entry], number[sample.doc[entry]]
        here = np.unique(word)
        renamed = np.full(len(kept), -1, dtype=np.int32)
        renamed[here] = np.arange(len(here), dtype=np.int32)
        of_piece = renamed[owner]
        piece, of_piece, word = piece[of_piece >= 0], of_piece[of_piece >= 0], renamed[word]
        per_word = 1 / sample.piece_count[here]
        piece_edges = np.searchsorted(of_piece, np.arange(len(here) + 1))
        filled = np.unique(doc)  # the other texts have no such word: their mean is zero
        renamed = np.zeros(len(docs), dtype=np.int32)
        renamed[filled] = np.arange(len(filled), dtype=np.int32)
        doc = renamed[doc]
        edges = np.searchsorted(doc, np.arange(len(filled) + 1))
        del found, owner, entry
        weight = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())) / len(target)
        vectors, shrunk = vectors.T.copy(), shrunk.T
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, output, bias)]
        means = np.zeros((DIMENSIONS, len(docs)))
        for step in range(1, epochs + 1):
            word_vectors = _sums(shrunk * vectors, piece, piece_edges) * per_word
            means[:, filled] = _sums(word_vectors, word, edges, share)
            scores = means.T @ output + bias
            odds = np.exp(scores - scores.max(axis=1, keepdims=True))
            delta = odds / odds.sum(axis=1, keepdims=True)
            delta[np.arange(len(target)), target] -= 1
            delta *= weight[:, None]
            to_word = _spread((output @ delta.T)[:, filled], doc, word, len(here), share) * per_word
            to_vectors = shrunk * _spread(to_word, of_piece, piece, BUCKETS)
            for values, slope, (first, second) in zip((vectors, output, bias), (to_vectors, means @ delta, delta.sum(axis=0)), moments, strict=True):
                first += 0.1 * (slope - first)
                second += 0.01 * (slope * slope - second)
                values -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        return cls(((shrunk * vectors).T @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))

    @classmethod
    def calibrated(cls, rows: list[tuple[str, int]]) -> SubwordModel:
        """:meth:`train`, with slope and bias fitted on the margins of rows that the model which scores them has not seen.

        The fewer rows, the more a model's margins on its own rows promise more than new texts keep, and a fixed threshold
        would then let all of them pass.
        """
        sample = Sample(rows)
        model, label = cls.train(sample), sample.label
        positives = int(label.sum())
        folds = min(positives, len(label) - positives, min(8, max(2, FOLD_ROWS // max(1, len(label)))))
        if folds < 2:
            return model
        place = np.where(label == 1, np.cumsum(label), np.cumsum(1 - label)) % folds
        margin = np.zeros(len(label))
        for k in range(folds):
            own = np.flatnonzero(place == k)
            margin[own] = sample.margins(cls.train(sample, docs=np.flatnonzero(place != k)), own)
        slope, bias = _logistic(margin, label)
        return cls((model.weights * slope).astype(np.float32), model.bias * slope + bias)

    def word(self, word: str) -> float:
        return float(self.weights[subwords(word)].mean())

    def margins(self):
        """A function from a text to its log odds; it remembers the words it has met."""
        known = _Known(self.word)

        def margin(text: str | None) -> float:
            words = words_of(text or "")
            if len(known) > REMEMBERED:
                known.clear()
            return (sum(map(known.__getitem__, words)) / len(words) if words else 0.0) + self.bias

        return margin

    def scorer(self):
        """A function from a text to its score."""
        margin = self.margins()

        return lambda text: 1 / (1 + np.exp(-np.clip(margin(text), -500, 500)))


def scored(documents: DataFrame, model, threshold: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, with a model that has a ``scorer()``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value.scorer()
        for batch in batches:
            scores = np.array([value(t) for t in batch.column(2).to_pylist()], dtype=np.float64)
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = documents.select(doc_id.alias("doc_id"), F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def train_toxicity(documents: DataFrame, labels: DataFrame) -> SubwordModel:
    return SubwordModel.calibrated(labelled_sample(documents, labels, "toxic", SAMPLE_ROWS, SAMPLE_TEXT_BYTES))


def toxicity_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``documents(doc_id, text)``.

    Learned from ``labels(doc_id, toxic)`` in the training fold; the score sees the text only, and all of it. Null texts are
    scored as empty ones: the softmax of the bias. Null ids are scored too and never held out; repeated rows are scored
    alike; other columns are ignored. Without labels of both classes every text gets the same score.
    """
    return scored(documents, train_toxicity(documents, labels), threshold)


def drop_toxic(documents: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; learned from ``labelled`` documents.

    Nulls, empty texts, repeated rows and missing labels count as in :func:`toxicity_scores`; no rows give no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train_toxicity(labelled, labels))
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([value(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
