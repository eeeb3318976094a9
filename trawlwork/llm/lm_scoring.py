"""Language-model scores by cross-entropy difference: how much better a target model predicts a text than a background model.

Both models are word bigrams over one vocabulary, counted over all documents and over the target documents, with the same
smoothing; background counts are scaled to the target's number of words, so that both models trust their counts alike.
Every word and every bigram of the corpus has its counts. Those of words are a written table. Those of bigrams, of which most
occur once, are not stored: chunks of texts send the distinct bigrams they hold, and how often, to buckets by hash; there
the chunks' counts are added up and go back to each chunk in the order it sent them. A bigram has one entry per chunk, so no
bucket has hot keys. Bigrams of two frequent words, by far the most, travel as exact numbers in few bytes, all others as keys.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlwork.llm.common import broadcast_if_small, release, training_fold
from trawlwork.llm.hashing import mix
from trawlwork.plans.lineage import cut

#: Weight of the backed-off unigram model, in words.
BACKOFF = 50.0
#: Counts of the most frequent words, as many as have room at this share each (500,000), are looked up in the tasks. All others
#: come by bucket.
HOT_SHARE = 1 / 500_000
#: Losses are summed in whole units of this many to a nat, so that the order of the sum never matters.
UNITS = 1e9
#: Words whose numbers a Python worker remembers, and words that it works on at a time (a longer text is taken alone).
REMEMBERED = 300_000
CHUNK_WORDS = 500_000
#: Bytes of text whose bigrams meet in one bucket; every chunk sends rows to every bucket, so beyond so many buckets they grow, up to
#: the larger bytes.
BUCKET_BYTES, BUCKETS, MOST_BUCKET_BYTES = 4 << 20, 1000, 16 << 20


def word_shape(word: str) -> str:
    """What a word outside the vocabulary is known by."""
    if word.isalpha():
        kind = "upper" if word.isupper() and len(word) > 1 else "title" if word[0].isupper() else "lower"
    else:
        kind = "digit" if word.isdigit() else "mixed" if any(c.isalnum() for c in word) else "sign"
    return f"\n{kind}{min(len(word) // 3, 4)}"  # a word never begins with a line end


SHAPES = [f"\n{kind}{n}" for kind in ("upper", "title", "lower", "digit", "mixed", "sign") for n in range(5)]


class WordKeys:
    """Words as numbers of this worker, and the 64-bit keys they have everywhere: 0 stands before the first word."""

    def __init__(self, words: list[str] | None):
        """``words``: those that are words of their own, all others go by their shape; None: all are."""
        self.words = None if words is None else set(words)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.digests = [bytes(8)]

    def keys(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.digests), dtype="<i8")

    def ids(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        known = self.known
        for w in set(words).difference(known):
            name = w if self.words is None or w in self.words else word_shape(w)
            known[w] = len(self.digests)
            self.digests.append(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest())
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def _chunks(batches: Iterator[pa.RecordBatch], words: list[str] | None):
    """``(rows, lengths, word, keys)`` of consecutive rows with a ``text``: their words as numbers, and the key of each
    number; 0 stands before the first word."""
    own = WordKeys(words)
    for batch in batches:
        first, held, parts = 0, 0, []
        texts = batch.column(batch.schema.get_field_index("text"))
        for i in range(len(texts)):
            parts.append(own.ids(texts[i].as_py()))
            held += len(parts[-1])
            if held < CHUNK_WORDS and i + 1 < len(texts):
                continue
            lengths, word = np.array([len(x) for x in parts], dtype=np.int64), np.concatenate(parts)
            keys = own.keys()
            used = np.zeros(len(keys), dtype=bool)
            used[0] = used[word] = True
            yield batch.slice(first, i + 1 - first), lengths, (np.cumsum(used) - 1)[word], keys[used]
            first, held, parts = i + 1, 0, []
            if len(own.known) > REMEMBERED:
                own.forget()


def _before(lengths: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The number before every word."""
    before = np.zeros(len(word), dtype=np.int64)
    before[1:] = word[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    return before


def _order(values: np.ndarray, size: int) -> np.ndarray:
    """The stable order of whole numbers below ``size``; sorting them with their places in one number is much faster."""
    bits = len(values).bit_length()
    if size << bits >= 1 << 63:
        return np.argsort(values, kind="stable")
    return np.sort((values << bits) | np.arange(len(values))) & ((1 << bits) - 1)


def _bigrams(lengths: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(before, word, place)``: the distinct bigrams in their order, and for every word the number of the bigram it ends."""
    codes = _before(lengths, word) * size + word
    order = _order(codes, size * size)
    codes = codes[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = codes[1:] != codes[:-1]
    place = np.empty(len(codes), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    codes = codes[new]
    return codes // size, codes % size, place


def _flags(column: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """A boolean column of the rows, for each of their words."""
    return np.repeat(column.to_numpy(zero_copy_only=False).astype(bool), lengths)


def _word_counts(rows: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts, counted in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for text in batch.column(0).to_pylist():
                counts.update((text or "").split())
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _unit_counts(rows: DataFrame, words: list[str] | None) -> DataFrame:
    """``(key, n, n_target, ahead, ahead_target)`` over all texts: counts as word and as what stands before a word."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    names = ["key", "n", "n_target", "ahead", "ahead_target"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lengths, word, keys in _chunks(batches, shared.value):
            before, chosen = _before(lengths, word), _flags(part.column(1), lengths)
            found = [np.bincount(x, minlength=len(keys)) for x in (word, word[chosen], before, before[chosen])]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (keys, *found)], names=names)

    counted = rows.select("text", "target").mapInArrow(count, ", ".join(f"{n} long" for n in names))
    sums = counted.groupBy("key").agg(*(F.sum(n).alias(n) for n in names[1:]))
    return sums.filter((F.col("n") > 0) | (F.col("ahead") > 0))


class BigramModels:
    """Target and background: written counts of every word, and the texts whose bigrams count.

    ``units(key, n, n_target, ahead, ahead_target)``: counts as word and as what stands before. ``rows(text, target)`` are read
    again where documents are scored. Keys have 64 bits: among a hundred million words two share one with a chance of 3 in
    10,000. Bigrams of two frequent words (:class:`HotWords`) are told apart exactly; all others have 63 bits of their own besides
    their bucket.
    """

    def __init__(self, words: list[str] | None, documents: DataFrame, target: Column, bigram_share: float):
        self.words, self.documents, self.target = words, documents, F.coalesce(target, F.lit(False)).alias("target")
        self.units = cut(_unit_counts(documents.select("text", self.target), words), "units")
        release(documents.sparkSession)
        self.total, self.target_total, own = self.units.agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))
        ).first()
        self.size = (own if words is None else len(words)) + len(SHAPES) + 1
        # Both models as if they had seen as many words as the target.
        self.scale = self.target_total / self.total if self.total else 1.0
        #: Rarer bigrams are backed off.
        self.least = bigram_share * self.total

    def hot(self) -> HotWords:
        most, room, least = F.greatest("n", "ahead"), 1 / HOT_SHARE if HOT_SHARE else math.inf, math.inf
        # So many words have a count; there are few different counts, about the root of all words.
        for n, words in sorted(self.units.groupBy(most).count().collect(), reverse=True):
            room -= words
            if room < 0:
                break
            least = n
        rows = self.units.filter(most >= F.lit(least)).toArrow()
        return HotWords(*(rows.column(c).to_numpy() for c in ("key", "n", "n_target", "ahead", "ahead_target")))


#: References to rare words begin here.
RARE = 1 << 31


class HotWords:
    """Counts of the most frequent words. A word is referred to by its rank among them, or, if it is rare, by 31 bits of its key."""

    def __init__(self, key: np.ndarray, *counts: np.ndarray):
        by_count = np.lexsort((key, -counts[0]))
        self.bits_of, self.columns = np.append(key[by_count] & (RARE - 1), 0), [np.append(x[by_count], 0) for x in counts]
        self.rank = np.argsort(key[by_count])
        self.key = key[by_count][self.rank]
        #: Bits of the number of a pair.
        self.width = 2 * max(1, len(key).bit_length())

    def refer(self, keys: np.ndarray) -> np.ndarray:
        rare = RARE | (keys & (RARE - 1))
        if not len(self.key):
            return rare
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, self.rank[at], rare)

    def bits(self, refs: np.ndarray) -> np.ndarray:
        """31 bits of the keys."""
        return np.where(refs >= RARE, refs - RARE, self.bits_of[np.minimum(refs, len(self.key))]).astype(np.uint64)

    def counts(self, refs: np.ndarray) -> list[np.ndarray]:
        """0 for rare words."""
        return [x[np.minimum(refs, len(self.key))] for x in self.columns]


    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of pairs, no two alike and spread evenly over ``width`` bits; -1 if a word is rare."""
        half, mask = np.uint64(self.width // 2), np.uint64((1 << self.width) - 1)
        x = (first.astype(np.uint64) << half) | second.astype(np.uint64)
        for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):  # each step can be undone, so pairs stay apart
            x = ((x ^ (x >> half)) * np.uint64(odd)) & mask
        return np.where(np.maximum(first, second) < RARE, (x ^ (x >> half)).astype(np.int64), -1)


def _bucket_count(text_bytes: int) -> int:
    return max(min(1 + text_bytes // BUCKET_BYTES, BUCKETS), 1 + text_bytes // MOST_BUCKET_BYTES)


def _deal(hot: HotWords, refs: np.ndarray, first: np.ndarray, second: np.ndarray, buckets: int):
    """``(order, bucket, number)`` of a chunk's bigrams and of its rare words: the order in which they are sent, and the bucket and
    number of each. In a bucket numbers rise; what has none (-1) comes last."""
    n, bits, rare = np.uint64(buckets), hot.bits(refs), np.flatnonzero(refs >= RARE)
    number = hot.pairs(refs[first], refs[second])
    numbered = np.flatnonzero(number >= 0)
    by_key = (mix((bits[first] << np.uint64(31)) | bits[second]) % n).astype(np.int64)
    bucket = np.where(number < 0, by_key, number * buckets >> hot.width)
    order = np.r_[numbered[_order(number[numbered], 1 << hot.width)], np.flatnonzero(number < 0)]
    of_words = (mix(bits[rare]) % n).astype(np.int64)
    return (order[_order(bucket[order], buckets)], bucket, number), (_order(of_words, buckets), of_words, np.full(len(rare), -1))


def _pack(word: np.ndarray) -> bytes:
    return pa.compress(word.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    data = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(data, dtype=np.uint8).reshape(4, n).T.copy().view("<u4").reshape(n).astype(np.int64)


_LONGS, _BYTES = pa.list_(pa.int64()), pa.list_(pa.int8())
#: What goes between chunks and buckets: the bigrams (2 counts each) or the rare words (4) that a chunk has in one bucket; or a
#: chunk's texts, in a bucket below 0, with as many words as ``width``. Most counts are small: ``small`` has -1 where the count is the next one of ``large``.
#: ``asked`` has the bytes of all entries, ``sizes`` how many each has (see :func:`_squeezed`).
_SENT = pa.schema(
    [
        *((n, pa.int64()) for n in ("chunk", "bucket", "width")),
        *((n, _LONGS) for n in ("large", "doc_ids", "lengths")),
        ("small", _BYTES),
        *((n, pa.binary()) for n in ("asked", "sizes", "refs", "words")),
    ]
)
_SENT_SQL = (
    "chunk long, bucket long, width long, large array<long>, doc_ids array<long>, lengths array<long>, small array<tinyint>, "
    "asked binary, sizes binary, refs binary, words binary"
)


def _sent(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _SENT], schema=_SENT)


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array, kind: pa.DataType = _LONGS) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind.value_type), type=kind)


def _flat(column: pa.ChunkedArray, kind: pa.DataType = _LONGS) -> pa.Array:
    """The entries of all lists of a column."""
    return pa.concat_arrays([pa.array([], kind.value_type), *(x.flatten() for x in column.chunks)])


def _packed(ends: np.ndarray, counts: np.ndarray) -> dict[str, pa.Array]:
    """Counts, a row for each entry, as lists of the entries up to each of ``ends``."""
    width, flat = counts.shape[1], counts.ravel().astype(np.int64, copy=False)
    big = flat > 127
    before = np.r_[0, np.cumsum(big)][ends * width]
    return {"small": _lists(ends * width, np.where(big, -1, flat).astype(np.int8), _BYTES), "large": _lists(before, flat[big])}


def _unpacked(rows: pa.Table, width: int) -> np.ndarray:
    counts = _flat(rows.column("small"), _BYTES).to_numpy().astype(np.int64)
    counts[counts < 0] = _flat(rows.column("large")).to_numpy()
    return counts.reshape(-1, width)


#: The size of an entry that is a key of 8 bytes.
KEY = 9


def _binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, *(pa.py_buffer(x.tobytes()) for x in (offsets.astype(np.int32), data))])


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)


def _squeezed(ends: np.ndarray, number: np.ndarray, keys: np.ndarray) -> dict[str, pa.Array]:
    """Lists of the entries up to each of ``ends``, as :func:`_deal` orders them: a number as the step from the one before it, in
    as few bytes as hold it; what has none (-1) as its key."""
    step, numbered = np.diff(number, prepend=0), number >= 0
    step[ends[:-1]] = number[ends[:-1]]
    sizes = np.where(numbered, np.searchsorted(256 ** np.arange(8), step, side="right"), KEY).astype(np.uint8)
    parts = np.where(numbered, step, keys).astype("<i8").view(np.uint8).reshape(-1, 8)
    begin = np.r_[0, np.cumsum(np.minimum(sizes, 8), dtype=np.int64)][ends]
    return {"sizes": _binaries(ends, sizes), "asked": _binaries(begin, parts[np.arange(8) < sizes[:, None]])}


def _unsqueezed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """``(entries, lengths)``: the numbers and keys of all rows, and how many each row has."""
    sizes, lengths = _joined(rows.column("sizes")), pc.binary_length(rows.column("sizes")).to_numpy().astype(np.int64)
    parts = np.zeros((len(sizes), 8), dtype=np.uint8)
    parts[np.arange(8) < sizes[:, None]] = _joined(rows.column("asked"))
    entries, numbered = parts.reshape(-1).view("<i8").astype(np.int64), sizes != KEY
    running = np.r_[0, np.cumsum(np.where(numbered, entries, 0))]
    return np.where(numbered, running[1:] - np.repeat(running[np.cumsum(lengths) - lengths], lengths), entries), lengths


def _entries(rows: DataFrame, hot, words, buckets: int, trained: bool, scored: bool) -> DataFrame:
    """What the chunks of ``rows(row, doc_id, text, target)`` send: their bigrams and rare words, with counts if the models learn
    from them, and their texts if they are to be scored."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lengths, word, keys in _chunks(batches, words.value):
            # Number 0 stays; frequent words come next, so that what is sent packs well.
            refs = hot.value.refer(keys)
            own = np.r_[0, 1 + np.argsort(refs[1:], kind="stable")]
            number = np.empty(len(own), dtype=np.int64)
            number[own] = np.arange(len(own))
            word, keys, refs = number[word], keys[own], refs[own]
            first, second, place = _bigrams(lengths, word, len(keys))
            rare = np.flatnonzero(refs >= RARE)
            chunk, pairs = part.column(0)[0].as_py(), []
            for weights in (None, _flags(part.column(3), lengths)):
                pairs.append(np.bincount(place, weights, len(first)) if trained else np.zeros(len(first)))
            units = [np.bincount(x, n, len(keys))[rare] for x in (second, first) for n in pairs]
            if scored:
                one = [0, len(lengths)]
                about = {"doc_ids": _lists(one, part.column(1)), "lengths": _lists(one, lengths), "refs": pa.array([_pack(np.diff(refs, prepend=0))], pa.binary())}
                yield _sent(1, chunk=pa.array([chunk]), bucket=pa.array([-1 - chunk]), width=pa.array([len(refs)]), words=pa.array([_pack(word)], pa.binary()), **about)
            # The key of a bigram has 63 bits, and its bucket comes from others; it is below 0, as no number is.
            both = mix(mix(keys.view(np.uint64))[first] + keys.view(np.uint64)[second] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) | np.iinfo(np.int64).min
            of_pairs, of_words = _deal(hot.value, refs, first, second, buckets)
            for (order, bucket, number), asked, counts in ((of_pairs, both, np.stack(pairs, 1)), (of_words, keys[rare], np.stack(units, 1))):
                met, begin = np.unique(bucket[order], return_index=True)
                ends = np.append(begin, len(order))
                about = {"chunk": pa.array([chunk if scored else None] * len(met), pa.int64()), "bucket": pa.array(met)}
                about["width"] = pa.array(np.full(len(met), counts.shape[1]))
                yield _sent(len(met), **about, **_squeezed(ends, number[order], asked[order]), **_packed(ends, counts[order]))

    return rows.mapInArrow(send, _SENT_SQL)


def _add_up(table: pa.Table) -> pa.Table:
    """The entries of one bucket, with the counts of all chunks."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    out = []
    for width in (2, 4):
        rows = table.filter(pc.equal(table.column("width"), width))
        if len(rows):
            own = _unpacked(rows, width)
            asked, lengths = _unsqueezed(rows)
            _, place = np.unique(asked, return_inverse=True)
            sums = np.stack([np.bincount(place, x).astype(np.int64)[place] for x in own.T], 1)
            ends = np.r_[0, np.cumsum(lengths)]
            about = {c: pa.concat_arrays(rows.column(c).chunks) for c in ("chunk", "bucket", "width")}
            back = _sent(len(rows), **about, **_packed(ends, sums))
            out.append(back.filter(pc.is_valid(back.column("chunk"))))
    return pa.Table.from_batches(out, _SENT)


def _losses(table: pa.Table, least: float, scale: float, words: float, hot: HotWords, buckets: int) -> pa.Table:
    """``(doc_id, n_words, summed_target, summed_background)`` of a chunk's texts, from what came back from all buckets."""
    is_text = pc.less(table.column("bucket"), 0)
    texts, back = table.filter(is_text), table.filter(pc.invert(is_text)).sort_by("bucket")
    pairs, units = (_unpacked(back.filter(pc.equal(back.column("width"), w)), w) for w in (2, 4))
    lengths = _flat(texts.column("lengths")).to_numpy()
    refs = np.cumsum(_unpack(texts.column("refs")[0].as_py(), texts.column("width")[0].as_py())) % (2 * RARE)
    first, second, place = _bigrams(lengths, _unpack(texts.column("words")[0].as_py(), int(lengths.sum())), len(refs))
    rare = np.flatnonzero(refs >= RARE)
    of_pairs, of_words = (x[0] for x in _deal(hot, refs, first, second, buckets))
    n, n_target, ahead, ahead_target = counts = hot.counts(refs)
    for x, found in zip(counts, units.T, strict=True):
        x[rare[of_words]] = found
    pair = np.empty_like(pairs)
    pair[of_pairs] = pairs
    known, ends, sums = pair[:, 0] >= least, np.cumsum(lengths), []
    for seen, as_before, as_word, share in ((pair[:, 1], ahead_target, n_target, 1.0), (pair[:, 0], ahead, n, scale)):
        unigram = (as_word * share + 1) / words
        loss = np.log(as_before * share + BACKOFF)[first] - np.log(np.where(known, seen, 0) * share + BACKOFF * unigram[second])
        running = np.r_[0, np.cumsum(np.rint(loss * UNITS).astype(np.int64)[place])]
        sums.append(pa.array(running[ends] - running[ends - lengths]))
    columns = [_flat(texts.column("doc_ids")), pa.array(lengths), *sums]
    return pa.Table.from_arrays(columns, names=["doc_id", "n_words", "summed_target", "summed_background"])


def train_models(documents: DataFrame, target: Column, word_share: float = 0.0, bigram_share: float = 0.0) -> BigramModels:
    """Models of ``documents(text)``; ``target`` says which of them the target model learns from (null: no).

    Every word and bigram counts. A share above 0 leaves words that are rarer to their shape and rarer bigrams to the
    backed-off model; the words that stay, at most ``1 / word_share``, then travel to the tasks.
    """
    words = None
    if word_share > 0:
        counted = cut(_word_counts(documents), "words")
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        words = sorted(r["word"] for r in counted.filter(F.col("n") >= word_share * total).select("word").collect())
    return BigramModels(words, documents, target, bigram_share)


def cross_entropy_difference(documents: DataFrame, models: BigramModels) -> DataFrame:
    """``(doc_id, n_words, target_loss, background_loss, score)`` for every row of ``documents(doc_id, text)``.

    Losses are nats per word; ``score`` is target minus background: below 0, the text is more like the target. Words are
    separated by white space as Python sees it. Null and empty texts: no words, losses and score 0. Null ids and repeated rows
    are scored like all others; other columns are ignored. The very table that the models learned from is read once, as both;
    with any other, the models' texts are read besides.
    """
    context = documents.sparkSession.sparkContext
    hot, words = context.broadcast(models.hot()), context.broadcast(models.words)
    row, text, doc_id = F.monotonically_increasing_id().alias("row"), F.col("text"), F.col("doc_id").cast("long").alias("doc_id")
    same = documents is models.documents
    held = documents.select(text) if same else documents.select(text).unionByName(models.documents.select(text))
    buckets = _bucket_count(held.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    release(documents.sparkSession)  # when the words were counted, that job's events could still hold its plan
    sent = _entries(documents.select(row, doc_id, text, models.target if same else F.lit(False).alias("target")), hot, words, buckets, same, True)
    if not same:
        learned = models.documents.select(row, F.lit(None).cast("long").alias("doc_id"), text, models.target)
        sent = sent.unionByName(_entries(learned, hot, words, buckets, True, False))
    least, scale, everything = models.least, models.scale, float(models.target_total + models.size)

    def score(table: pa.Table) -> pa.Table:
        return _losses(table, least, scale, everything, hot.value, buckets)

    summed = "doc_id long, n_words long, summed_target long, summed_background long"
    scored = sent.groupBy("bucket").applyInArrow(_add_up, _SENT_SQL).groupBy("chunk").applyInArrow(score, summed)
    first, second = (F.coalesce(F.try_divide(F.col(f"summed_{k}") / UNITS, F.col("n_words")), F.lit(0.0)) for k in ("target", "background"))
    losses = [F.round(x, 9).alias(n) for x, n in ((first, "target_loss"), (second, "background_loss"), (first - second, "score"))]
    return scored.select("doc_id", "n_words", *losses)


def score_against_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`cross_entropy_difference` with the good labelled documents (quality 1, not toxic, training fold) as target."""
    good = labels.filter(training_fold(F.col("doc_id")) & (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    good = cut(good.select(F.col("doc_id").cast("long").alias("_good")).distinct(), "target-ids")
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = own.join(broadcast_if_small(good), own["doc_id"] == good["_good"], "left")
    return cross_entropy_difference(marked, train_models(marked, F.col("_good").isNotNull()))
