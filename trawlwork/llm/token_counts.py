"""Token counts of whole texts with a public tokenizer.

Proven once, on the driver: which strings of the vocabulary encode alone as exactly one token. A pre-token among them
counts one without any merging; only the others go through the library's merges.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a Python worker remembers; beyond it the memory starts anew. Results do not depend on it.
REMEMBERED = 300_000
#: Characters of texts whose new words are counted together.
CHUNK_CHARS = 1 << 20


def whole_tokens(tokenizer, strings: list[str] | None = None) -> set[str]:
    """The vocabulary strings (without the word-end mark) that the tokenizer encodes alone as one token."""
    if strings is None:
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
        strings = sorted({t.removesuffix(suffix) for t in tokenizer.get_vocab()})
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return {s for s, e in zip(strings, encoded, strict=True) if s and len(e.ids) == 1}


def _pre_token_pattern(tokenizer) -> str | None:
    """The expression the tokenizer splits with, when it keeps the matches and drops the rest."""
    import json

    pre = json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    if steps and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed":
        return steps[0]["pattern"].get("Regex")
    return None


def _keeps_letters(tokenizer) -> bool:
    """Whether a-z reach the merges as they are, in one piece; their merges then need no preparation by the library."""
    letters = string.ascii_lowercase
    same = tokenizer.normalizer is None or tokenizer.normalizer.normalize_str(letters) == letters
    return same and tokenizer.pre_tokenizer is not None and [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(letters)] == [letters]


class WordCounter:
    """Tokens of a word (a run without spaces), with what has been counted before kept at hand.

    The tokenizer drops white space and never joins across it, so the count of a text is the sum over its words.
    """

    def __init__(self, tokenizer, whole: set[str]):
        self.tokenizer, self.whole = tokenizer, whole
        pattern = _pre_token_pattern(tokenizer)
        self.split = regex.compile(pattern).findall if pattern else None
        self.marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.letters = bool(pattern) and _keeps_letters(tokenizer)
        self.known: dict[str, int] = {}

    def _merge(self, strings: list[str]) -> dict[str, int]:
        letters = self.letters
        merge = self.tokenizer.model.tokenize
        merged = {s: len(merge(s)) for s in strings if letters and s.isascii() and s.isalpha() and s.islower()}
        rest = [s for s in strings if s not in merged]
        encoded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        merged.update((s, len(e.ids)) for s, e in zip(rest, encoded, strict=True))
        return merged

    def learn(self, new: list[str]) -> None:
        """Counts of new words; all that needs merging goes to the library in one call, each string once."""
        mixed: list[tuple[str, int, list[str]]] = []
        for word in new:
            # Plain ASCII is lower-cased as the tokenizer does it; anything else, and special strings, go to the library whole.
            if self.split and word.isascii() and not any(mark in word for mark in self.marks):
                parts = self.split(word.lower())
                hard = [p for p in parts if p not in self.whole]
                mixed.append((word, len(parts) - len(hard), hard))
            elif word in self.whole:
                self.known[word] = 1
            else:
                mixed.append((word, 0, [word]))
        strings = list({part for _, _, hard in mixed for part in hard})
        merged = self._merge(strings)
        for word, easy, hard in mixed:
            self.known[word] = easy + sum(merged[part] for part in hard)

    def counts(self, texts: list[str | None]) -> Iterator[int]:
        """Tokens of each text, whole texts of about ``CHUNK_CHARS`` together (a longer one by itself)."""
        first = 0
        while first < len(texts):
            chunk, size = [], 0
            while first < len(texts) and (not chunk or size + len(texts[first] or "") <= CHUNK_CHARS):
                text = texts[first] or ""
                size += len(text)
                chunk.append([w for w in text.replace("\n", " ").split(" ") if w])
                first += 1
            if len(self.known) > REMEMBERED:
                self.known.clear()
            known = self.known
            self.learn(list({w for words in chunk for w in words if w not in known}))
            for words in chunk:
                yield sum(map(known.__getitem__, words))


def token_counts(documents: DataFrame, tokenizer_file: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``documents(doc_id, text)``.

    Whole texts, without begin or end tokens; special strings inside a text are handled as the library does by
    default. ``over_limit``: more than ``limit`` tokens. Null and empty texts: 0 bytes, 0 tokens. Null ids and repeated
    rows are kept as they are, other columns are ignored, no rows give no rows. ``tokenizer_file`` is a ``.json`` of the
    ``tokenizers`` library, at the same path on every machine, that splits at white space and drops it. What is sent
    to the tasks is bounded by its vocabulary.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    for probe in (" \n", "a b", "a\nb"):
        alone = sum(len(tokenizer.encode(w, add_special_tokens=False).ids) for w in probe.split())
        if len(tokenizer.encode(probe, add_special_tokens=False).ids) != alone:
            raise ValueError("this tokenizer keeps white space; its texts can't be counted word by word")
    whole = documents.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(Tokenizer.from_file(tokenizer_file), whole.value)
        for batch in batches:
            counts = list(counter.counts(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
