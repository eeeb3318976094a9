"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from trawlwork.llm.toxicity import labelled_sample, scored

DIMENSIONS = 96
#: Places of an index vector that are not zero, half of them -1.
NONZERO = 6
CONTEXT = 2
#: Times a token must occur in the sample to have a vector of its own; rarer ones share that of their shape.
MIN_COUNT = 5
HIDDEN = 32
EPOCHS = 60
SAMPLE_ROWS = 2500
SAMPLE_TEXT_BYTES = 12_000
THRESHOLD = 0.5

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens_of(text: str) -> list[str]:
    """Words and runs of signs as they are written; a token that repeats the one before it is the mark ``<same>``."""
    found = _TOKEN.findall(text)
    return ["<same>" if i and t == found[i - 1] else t for i, t in enumerate(found)]


def shape(token: str) -> str:
    """What a rare token is known by: its kinds of characters and its length, roughly."""
    if token.isalpha():
        kind = "upper" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "lower"
    else:
        kind = "digit" if token.isdigit() else "mixed" if any(c.isalnum() for c in token) else f"sign{token[0]}"
    return f"<{kind}{min(len(token) // 4, 3)}>"


def index_vector(token: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a token's sparse index vector, from a hash of the token."""
    rng = np.random.default_rng(zlib.crc32(token.encode("utf-8", "surrogatepass")))
    return rng.choice(DIMENSIONS, NONZERO, replace=False), np.repeat([1.0, -1.0], NONZERO // 2)


class QualityModel:
    def __init__(self, numbers: dict[str, int], vectors: np.ndarray, layers: list[np.ndarray], temperature: float):
        self.numbers, self.vectors, self.layers, self.temperature = numbers, vectors, layers, temperature

    @staticmethod
    def _ids(tokens: list[str], numbers: dict[str, int]) -> np.ndarray:
        """A number per token: its own, else its shape's, else 0."""
        return np.array([n if (n := numbers.get(t)) is not None else numbers.get(shape(t), 0) for t in tokens], dtype=np.int64)

    @classmethod
    def train(cls, sample: list[tuple[str, int]], seed: int = 20260107) -> QualityModel:
        rng = np.random.default_rng(seed)
        listed = [tokens_of(text) for text, _ in sample]
        counts = Counter(t for tokens in listed for t in tokens)
        own = sorted(t for t, n in counts.items() if n >= MIN_COUNT)
        names = ["<unknown>", *own, *sorted({shape(t) for t in counts} - set(own))]
        numbers = {t: i for i, t in enumerate(names)}
        # Word vectors: the sum of the index vectors of all neighbours, then of unit length.
        index = np.zeros((len(names), DIMENSIONS))
        for i, name in enumerate(names):
            places, signs = index_vector(name)
            index[i, places] = signs
        vectors = 0.01 * index
        bags = [cls._ids(tokens, numbers) for tokens in listed]
        for ids in bags:
            for step in range(1, CONTEXT + 1):
                if len(ids) > step:
                    pairs, n = np.unique(ids[:-step] * len(names) + ids[step:], return_counts=True)
                    left, right = pairs // len(names), pairs % len(names)
                    np.add.at(vectors, left, index[right] * n[:, None])
                    np.add.at(vectors, right, index[left] * n[:, None])
        # A word's own index keeps words apart that stand in the same contexts.
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) + 0.5 * index / np.sqrt(NONZERO)
        model = cls(numbers, vectors.astype(np.float32), [], 1.0)
        target = np.array([label for _, label in sample], dtype=np.float64)
        if not len(target) or target.min() == target.max():
            share = (target.sum() + 0.5) / (len(target) + 1)
            model.layers = [np.zeros((DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])]
            return model
        pooled = np.array([model.pool(ids) for ids in bags])
        fold = rng.permutation(len(target))
        fit, aside = fold[len(fold) // 5 :], fold[: len(fold) // 5]
        layers = [rng.normal(0, np.sqrt(2 / DIMENSIONS), (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
        balance = np.where(target == 1, 0.5 / max(target[fit].mean(), 1e-6), 0.5 / max(1 - target[fit].mean(), 1e-6))
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
                step += 1
                x, hidden, score = model._forward(pooled[rows], layers)
                delta = (1 / (1 + np.exp(-score)) - target[rows]) * balance[rows] / len(rows)
                back = np.outer(delta, layers[2]) * (hidden > 0)
                slopes = [x.T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ delta + 1e-4 * layers[2], np.array([delta.sum()])]
                for values, slope, (first, second) in zip(layers, slopes, moments, strict=True):
                    first += 0.1 * (slope - first)
                    second += 0.001 * (slope * slope - second)
                    values -= 0.003 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        model.layers = layers
        if len(aside):
            # The temperature with the least cross-entropy on rows that the network has not seen.
            score = model._forward(pooled[aside], layers)[2]
            against = np.where(target[aside] == 1, -score, score)
            steps = np.geomspace(0.25, 8, 61)
            loss = [np.mean(balance[aside] * np.logaddexp(0, against / t)) for t in steps]
            model.temperature = float(steps[int(np.argmin(loss))])
        return model

    @staticmethod
    def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hidden = np.maximum(0, x @ layers[0] + layers[1])
        return x, hidden, np.clip(hidden @ layers[2] + layers[3][0], -500, 500)

    def pool(self, ids: np.ndarray) -> np.ndarray:
        """The mean of the word vectors, zero for a text without tokens."""
        if not len(ids):
            return np.zeros(DIMENSIONS)
        used, n = np.unique(ids, return_counts=True)
        return (n @ self.vectors[used]) / len(ids) * 4

    def scorer(self):
        def score(text: str | None) -> float:
            pooled = self.pool(self._ids(tokens_of(text or ""), self.numbers))
            return float(1 / (1 + np.exp(-self._forward(pooled[None, :], self.layers)[2][0] / self.temperature)))

        return score


def train_quality(documents: DataFrame, labels: DataFrame) -> QualityModel:
    return QualityModel.train(labelled_sample(documents, labels, "quality", SAMPLE_ROWS, SAMPLE_TEXT_BYTES))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``documents(doc_id, text)``.

    Learned from ``labels(doc_id, quality)`` in the training fold, at most ``SAMPLE_ROWS`` of each class; word vectors,
    network and temperature all come from that sample. The score sees the text only, and all of it. Null texts are scored
    as empty ones, which pool to zero. Null ids are scored too and never held out; repeated rows are scored alike; other
    columns are ignored. Without labels of both classes every text gets the same score.
    """
    return scored(documents, train_quality(documents, labels), threshold)
