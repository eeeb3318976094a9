"""The training-data operators against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawlwork.llm import components, decontamination, lm_scoring, minhash, mixing, quality, repeats, sharding, toxicity, vector_dedup
from trawlwork.plans.lineage import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, shard string, label int"
WORDS = [f"w{i}" for i in range(60)]


def documents(spark, rows):
    """Rows of (id, text[, source]) with further columns whose names clash with those of the operators."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "y", 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


def some_rows(seed=1, n=60):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(WORDS, int(rng.integers(1, 60)))) for _ in range(n)]
    rows = list(enumerate(texts))
    for i in range(12):  # near copies, exact copies
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        rows.append((100 + i, " ".join(words)))
        rows.append((200 + i, texts[i]))
    return [*rows, (300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "ONE"), (None, "one"), (305, "x " * 30_000), (305, "another text of the id"), (0, texts[0])]


def split_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def shingle_set(text, n):
    w = split_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def roots(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def jump(key, n):
    key, b, j = (key or 0) & (2**64 - 1), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), None, *range(50, 250)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 300):
        assert [r[0] for r in df.select(sharding.jump_shard(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_shard(F.col("k"), 0)


def test_shard_manifest(spark):
    rows = some_rows()
    out = sharding.shard_manifest(documents(spark, rows), 4).collect()
    assert len(out) == len(rows)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 4) and r.law == "key" for r in out)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert sharding.shard_manifest(documents(spark, []), 4).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = some_rows()
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    links = [(a, b) for a, s in sets for b, t in sets if None not in (a, b) and a != b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    label = roots({d for d, _ in rows}, links)
    out = minhash.near_duplicates(documents(spark, rows), size).collect()
    want = Counter((d, len(s), label[d], d is None or label[d] == d) for d, s in sets)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == want
    kept = minhash.drop_near_duplicates(documents(spark, rows), size)
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c, k in want if k}
    assert minhash.near_duplicates(documents(spark, []), size).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for d in range(60):  # a large group in which many are just too far from the first one
        w = list(base)
        for i in rng.choice(80, int(rng.integers(0, 12)), replace=False):
            w[i] = f"n{rng.integers(0, 40)}"
        rows.append((d, " ".join(w)))
    sets = [(d, shingle_set(t, 2)) for d, t in rows]
    links = [(a, b) for a, s in sets for b, t in sets if a < b and 100 * len(s & t) >= 80 * len(s | t)]
    label = roots(range(60), links)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), 2).collect()} == label


def test_near_duplicates_in_blocks_of_few_shingles(spark, monkeypatch):
    """A family of long documents is cut by what they hold, not by their number."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 3000)
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(1000)]
    rows = []
    for d in range(30):
        w = list(base)
        for i in rng.choice(1000, int(rng.integers(0, 80)), replace=False):
            w[i] = f"n{d}-{i}"
        rows.append((d, " ".join(w)))
    sets = [(d, shingle_set(t, 2)) for d, t in rows]
    label = roots(range(30), [(a, b) for a, s in sets for b, t in sets if a < b and 100 * len(s & t) >= 80 * len(s | t)])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), 2).collect()} == label


def test_short_items_in_long_documents(spark):
    items = [(1, "secret short item"), (2, "One"), (3, "a b c d e f g"), (4, "two words")]
    rows = [(1, "x " * 50 + "Secret  short ITEM" + " y" * 50), (2, "secret short"), (3, "one"), (4, "z one z"), (5, "secret short item"), (6, "a b c d e f g two  words"), (7, "short item secret"), (8, None)]
    items = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated_pairs(documents(spark, rows), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (5, 1), (3, 2), (4, 2), (6, 3), (6, 4)}
    assert [r.doc_id for r in decontamination.clean_documents(documents(spark, rows), items).collect()] == [2, 7, 8]


def test_clashing_names(spark):
    rows = some_rows(7, 30)
    clashing = documents(spark, rows).selectExpr("*", "77 AS _n", "78 AS _again", "79 AS _text_mark", "80 AS _id", "81 AS _mark", "82 AS _times", "83 AS row", "84 AS id", "85 AS times", "86 AS _good")
    plain = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(documents(spark, rows)).collect())
    out = mixing.mixed_documents(clashing).collect()
    assert Counter((r.doc_id, r.text) for r in out) == plain
    assert {tuple(r)[8:] for r in out} == {(77, 78, 79, 80, 81, 82, 83, 84, 85, 86)}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert lm_scoring.score_against_labels(clashing, labels).count() == len(rows)


def plain_subword_model(rows, epochs):
    """The same model, one text and one word at a time."""
    bags = [(toxicity.words_of(t), y) for t, y in rows if toxicity.words_of(t)]
    rng = np.random.default_rng(20260102)
    vectors, output, bias = rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.DIMENSIONS)), rng.normal(0, 0.5, (toxicity.DIMENSIONS, 2)), np.zeros(2)
    n = [sum(y == k for _, y in bags) for k in (0, 1)]
    holding = np.zeros((2, toxicity.BUCKETS))
    for words, y in bags:
        holding[y, sorted({p for w in words for p in toxicity.subwords(w)})] += 1
    share = holding.sum(axis=0) / sum(n)
    error = np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    strength = (np.abs(holding[1] / n[1] - holding[0] / n[0]) / (toxicity.HALF * error)) ** 4
    shrunk = strength / (strength + 1)
    shrunk[shrunk < toxicity.LEAST] = 0
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, output, bias)]
    for step in range(1, epochs + 1):
        slopes = [np.zeros_like(p) for p in (vectors, output, bias)]
        for words, y in bags:
            mean = np.mean([np.mean([shrunk[p] * vectors[p] for p in toxicity.subwords(w)], axis=0) for w in words], axis=0)
            scores = mean @ output + bias
            delta = np.exp(scores) / np.exp(scores).sum() - np.eye(2)[y]
            delta *= 0.5 / n[y]
            slopes[1] += np.outer(mean, delta)
            slopes[2] += delta
            for w in words:
                pieces = toxicity.subwords(w)
                for p in pieces:
                    slopes[0][p] += shrunk[p] * (output @ delta) / len(words) / len(pieces)
        for values, slope, (first, second) in zip((vectors, output, bias), slopes, state, strict=True):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            values -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)

    def margin(text):
        words = toxicity.words_of(text)
        return bias[1] - bias[0] + (np.mean([np.mean([shrunk[p] * vectors[p] @ (output[:, 1] - output[:, 0]) for p in toxicity.subwords(w)]) for w in words]) if words else 0)

    return margin


def test_toxicity_training_equals_plain_loops(monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(" ".join(rng.choice(WORDS, int(rng.integers(3, 15)))) + (" vile rotten filth" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(40)] + [("", 1), (" ,", 0)]
    want = plain_subword_model(rows, 6)
    texts = ["vile words", "w1 w2", "", "filthy rotting w3"]
    for at_once in (1 << 19, 7):
        monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
        margin = toxicity.SubwordModel.train(rows, epochs=6).margins()
        assert [margin(t) for t in texts] == pytest.approx([want(t) for t in texts], abs=1e-5)


def test_labelled_sample_is_the_same_again(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(5, "another"), (5, "text 5"), (7, None), (8, "x" * 999)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, 1), (None, 1)], "doc_id long, toxic int")
    one = toxicity.labelled_sample(documents(spark, rows), labels, "toxic", 40, 100)
    two = toxicity.labelled_sample(documents(spark, rows[::-1]).repartition(7), labels, "toxic", 40, 100)
    assert one == two and Counter(y for _, y in one) == {0: 40, 1: 40}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(500, 540)] + [(7, 7)]
    label = roots({x for e in edges for x in e}, edges)
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in label} == label


def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(data) else 0
        out[d] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_remove_repeats(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(rng.choice(WORDS, 60))
    rows = [(d, " ".join([*rng.choice(WORDS, 30), passage, *rng.choice(WORDS, 30)])) for d in range(12)]
    rows += [(20 + d, rows[d][1]) for d in range(3)] + [(30, "ab" * 300), (31, "é" * 120), (32, "é" * 49), (33, "é" * 50 + "x"), (34, None), (35, "")]
    rows += [(40, rows[0][1].replace("w1", "W1")), (41, "x" * 99), (42, "x" * 100), (43, "x" * 101)]
    out = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(documents(spark, rows)).collect()}
    assert out == brute_repeats(rows, 100)
    twice = documents(spark, [(1, "y" * 150), (1, "z" * 150), (1, "y" * 150), (None, "z" * 150)])
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(twice).collect())
    # The null id comes first; the two equal rows count as one document, whose later windows repeat its first one.
    assert [g[2] for g in got if g[0]] == [got[-1][2]] and len(got) == 4 and got[0][2] == got[1][2]
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    kept = repeats.remove_repeats(documents(spark, [(1, "x" * 250)]), with_text=True).first()
    assert kept.kept == b"" or hashlib.sha256(kept.kept).hexdigest() == kept.kept_sha256


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from trawlwork.llm.token_counts import token_counts, whole_tokens

    rows = [(1, "The CAT's  naïve idea <|endoftext|>x 12 ÀÉ İstanbul ΣΑΣ İ é \x1c !!! 日本"), (2, None), (3, ""), (None, "a b"), (4, "hello " * 3000), (2, "a<|startoftext|>")]
    rows += [(9, " x y\x85z\x0bq")]
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter((d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in rows)
    assert Counter(map(tuple, token_counts(documents(spark, rows), P.path("word_bpe_49k.json")).collect())) == want
    for s in list(whole_tokens(tokenizer))[:200]:
        assert len(tokenizer.encode(s, add_special_tokens=False).ids) == 1


def test_mixing(spark):
    rows = [(d, t, None if (d or 0) % 7 == 0 else f"s{(d or 0) % 4}") for d, t in some_rows(4, 120)]
    docs = documents(spark, rows)
    out = mixing.mix_documents(docs, block=4).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d, len(split_words(t))) for d, t, _ in rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(split_words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:  # hand out by weight, stop at the limit, again
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in full} if full else {s: level * weight[s] for s in free}
        left -= sum(3 * size[s] for s in full)
        free = free - full if full else set()
    got = {r.source: r for r in mixing.source_targets(docs.select("source", F.lit(1).alias("size")).limit(0)).collect()}
    assert got == {}
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 8 for s in order)
    again = mixing.mix_documents(docs.repartition(7), block=4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    mixed = mixing.mixed_documents(docs, block=4)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {d for d, _, _ in rows}
    assert mixing.mix_documents(documents(spark, [])).count() == 0


def test_mixing_small_sources(spark):
    """With the production block, next to one hot source, sources at their limit give all of it and none is left out."""
    sizes = [1, 2, 10, 31, 32, 40, 63, 64, 65, 127, 128, 129, 130, 200, 320, 641, 700]
    rows = [(1000 * k + i, " ".join(["w"] * min(7, n - 7 * i)), f"t{k:02}") for k, n in enumerate(sizes) for i in range(-(-n // 7))]
    rows += [(10**6 + i, "w " * 500, "s") for i in range(40)] + [(2 * 10**6, None, "u"), (2 * 10**6 + 1, " ", "u")]
    docs = documents(spark, rows)
    out = mixing.mix_documents(docs).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        taken[r.doc_id // 1000 if r.doc_id < 10**6 else "s"] += r.taken
        assert r.taken <= 3 * r.size
    assert {k: taken[k] for k in range(len(sizes))} == {k: 3 * n for k, n in enumerate(sizes)}
    assert abs(taken["s"] - next(r.target for r in out if r.doc_id == 10**6)) <= 64
    # A target below half a block is one slot, and documents of every source stay in the mix.
    tiny = documents(spark, [(0, "w " * 30, "a"), (1, "w " * 30, "b"), (2, "w " * 6400, "c")])
    found = {r.doc_id: (r.target, r.taken) for r in mixing.mix_documents(tiny, weights=(1, 1, 1000)).collect()}
    assert 0 < found[0][0] < 15 and found[0][1] == found[1][1] == 30
    sources, slots, pieces = mixing.mix_plan(docs)
    held = pieces.filter("size > 0").groupBy("source_no", "block").agg(F.sum("n_words").alias("n")).groupBy("source_no").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    assert all(r.high - r.low <= 1 and r.high <= 64 for r in held.collect())
    assert {r.doc_id // 1000 for r in mixing.mixed_documents(docs).collect() if r.doc_id < 10**6} == set(range(len(sizes)))


def plan_lines(df, words):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if all(w in line for w in words)]


def test_mixing_sends_no_blocks_to_the_driver(spark):
    """A few sources make any number of blocks, which the planner does not see: their join sorts, and rows without blocks spread."""
    docs = documents(spark, [(i, "w " * 3000, f"s{i % 2}") for i in range(20)] + [(100 + i, " ", "s0") for i in range(200)])
    out = mixing.mix_documents(docs)
    assert plan_lines(out, ["SortMergeJoin", "LeftOuter"]) and not plan_lines(out, ["BroadcastHashJoin", "LeftOuter"])
    assert Counter(r.taken > 0 for r in out.collect()) == {True: 20, False: 200}
    keys = re.findall(r"Join \[source_no#\d+, (\w+)#", plan_lines(out, ["SortMergeJoin", "LeftOuter"])[0])
    assert keys == ["_at"]  # not the block, which is null for all rows without words


def test_pipeline_mix_sends_no_blocks_to_the_driver(spark):
    docs = documents(spark, [(i, "w " * 3000, f"s{i % 2}") for i in range(20)] + [(100 + i, " ", "s0") for i in range(20)])
    import corpus_pipeline

    mixed = corpus_pipeline.mix(spark, docs, "")
    assert not plan_lines(mixed, ["BroadcastHashJoin", "block#"]) and plan_lines(mixed, ["SortMergeJoin", "_at#"])
    assert Counter(r.doc_id for r in mixed.collect() if r.doc_id >= 100) == Counter(range(100, 120))


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        out = mixing._permuted(np.arange(n), np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(out.tolist()) == list(range(n))


def test_decontamination(spark):
    rng = np.random.default_rng(6)
    items = [(i, " ".join(rng.choice(WORDS, n))) for i, n in enumerate((3, 5, 9, 14, 40, 90))] + [(50, None), (51, ""), (None, "a b c d e f")]
    rows = [r for r in some_rows(7) if r[0] != 305]
    for d, (i, text) in enumerate(items[:6]):
        words = text.split()
        rows.append((400 + d, "start " + text.upper() + " end"))
        words[-1] = "other"
        rows.append((500 + d, " ".join([*rng.choice(WORDS, 300), *words, "tail"])))
        rows.append((600 + d, text))
    sets = {i: (shingle_set(t, 5), max(1, min(5, len(split_words(t))))) for i, t in items if i is not None}  # short items by shingles of their own length
    held = ((d, i, s, s & shingle_set(text, n)) for d, text in rows if d is not None for i, (s, n) in sets.items())
    want = {(d, i, len(s), len(both)) for d, i, s, both in held if s and len(both) * 100 >= 80 * len(s)}
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontamination.contaminated_pairs(documents(spark, rows), benchmark).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    clean = decontamination.clean_documents(documents(spark, rows), benchmark).collect()
    hit = {w[0] for w in want}
    assert Counter(r.doc_id for r in clean) == Counter(d for d, _ in rows if d not in hit)
    assert decontamination.contaminated_pairs(documents(spark, rows), benchmark.limit(0)).count() == 0


def brute_losses(text, docs, target, word_share, pair_share):
    def ids(t, kept):
        return [w if w in kept else lm_scoring.word_shape(w) for w in (t or "").split()]

    counts = Counter(w for t in docs for w in (t or "").split())
    total = sum(counts.values())
    kept = {w for w, n in counts.items() if n >= word_share * total}
    size = len(kept) + len(lm_scoring.SHAPES) + 1
    pairs = [Counter(), Counter()]
    for t, good in zip(docs, target, strict=True):
        w = ids(t, kept)
        for pair in zip(["^", *w], w, strict=False):
            pairs[1][pair] += 1
            pairs[0][pair] += good
    out = []
    for k in (0, 1):
        scale = sum(pairs[0].values()) / max(1, sum(pairs[k].values())) if sum(pairs[k].values()) else 1.0
        word, before = Counter(), Counter()
        for (a, b), n in pairs[k].items():
            word[b] += n * scale
            before[a] += n * scale
        everything, loss, w = sum(word.values()), 0.0, ids(text, kept)
        for a, b in zip(["^", *w], w, strict=False):
            unigram = (word[b] + 1) / (everything + size)
            known = pairs[1][a, b] >= pair_share * total and pairs[1][a, b]
            n = pairs[k][a, b] * scale if known else 0
            loss -= np.log((n + lm_scoring.BACKOFF * unigram) / (before[a] + lm_scoring.BACKOFF))
        out.append(loss / len(w))
    return out


def test_lm_scores(spark):
    rows = some_rows(8)
    good = [bool(d is not None and d % 3 == 0) for d, _ in rows]
    docs = documents(spark, rows)
    models = lm_scoring.train_models(docs, F.col("doc_id") % 3 == 0, 1 / 50, 1 / 2000)
    out = lm_scoring.cross_entropy_difference(docs, models).collect()
    assert len(out) == len(rows)
    for d, text in rows[5:20:5]:
        want = brute_losses(text, [t for _, t in rows], good, 1 / 50, 1 / 2000)
        r = next(x for x in out if x.doc_id == d)
        assert (r.target_loss, r.background_loss) == pytest.approx(want, abs=1e-6) and r.score == pytest.approx(want[0] - want[1], abs=1e-6)
    assert {(r.n_words, r.score) for r in out if r.doc_id in (300, 301, 302)} == {(0, 0.0)}
    empty = lm_scoring.train_models(documents(spark, []), F.lit(True))
    assert lm_scoring.cross_entropy_difference(documents(spark, [(1, "a b")]), empty).first().n_words == 2


def test_lm_scores_of_every_word(spark, monkeypatch):
    """Without shares every word and bigram has its counts, whether it is looked up or joined; new bigrams are backed off."""
    rows = [*some_rows(8), (700, "rare0 rare1 rare0 rare2"), (701, "rare1 rare0")]
    good = [bool(d is not None and d % 3 == 0) for d, _ in rows]
    texts = [t for _, t in rows]
    docs = documents(spark, rows)
    found = {}
    for hot in (0.0, 1 / 300, 2.0):
        monkeypatch.setattr(lm_scoring, "HOT_SHARE", hot)
        models = lm_scoring.train_models(docs, F.col("doc_id") % 3 == 0)
        assert models.units.filter("key <> 0").count() == len({w for t in texts for w in (t or "").split()})
        out = lm_scoring.cross_entropy_difference(docs.unionByName(documents(spark, [(800, "w1 unseen rare2 w3 w3"), (801, "rare2")])), models).collect()
        assert len(out) == len(rows) + 2
        found[hot] = Counter(map(tuple, out))
        for d, text in [*rows[5:20:5], *rows[-2:], (800, "w1 unseen rare2 w3 w3"), (801, "rare2")]:
            r = next(x for x in out if x.doc_id == d)
            assert (r.target_loss, r.background_loss) == pytest.approx(brute_losses(text, texts, good, 0, 0), abs=1e-6)
    assert found[0.0] == found[1 / 300] == found[2.0]


def test_lm_bigrams_are_not_stored(spark, monkeypatch):
    """Tables are written for words only; scores do not depend on the number of buckets; a long text is taken alone."""
    rng = np.random.default_rng(4)
    rows = [(d, " ".join(f"w{w}" for w in rng.integers(0, 400, 2000))) for d in range(20)]
    docs = documents(spark, rows)
    written, found = [], []
    cut = lm_scoring.cut
    monkeypatch.setattr(lm_scoring, "cut", lambda df, name: written.append(cut(df, name)) or written[-1])
    for size in (1 << 30, 1000):
        monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", size)
        for hot in (1 / 500_000, 1 / 400):
            monkeypatch.setattr(lm_scoring, "HOT_SHARE", hot)
            models = lm_scoring.train_models(docs, F.col("doc_id") < 10)
            out = lm_scoring.cross_entropy_difference(docs, models).collect()
            found.append(Counter(map(tuple, out)))
            assert models.total == 40_000 and len(out) == len(rows)
        foreign = lm_scoring.cross_entropy_difference(docs.select("*"), models).collect()
        assert Counter(map(tuple, foreign)) == found[0]
    assert found[0] == found[1] == found[2] == found[3]
    assert all(t.count() <= 401 for t in written)


def test_lm_orders():
    values = np.random.default_rng(5).integers(0, 50, 1000)
    for size in (50, 1 << 62):
        assert (lm_scoring._order(values, size) == np.argsort(values, kind="stable")).all()
    counts = np.array([[1, 0], [127, 128], [1 << 40, 2]])
    lists = lm_scoring._packed(np.array([0, 1, 3]), counts)
    assert lists["large"].to_pylist() == [[], [128, 1 << 40]]
    assert (lm_scoring._unpacked(pa.table(lists), 2) == counts).all()
    for word in (np.array([], dtype=np.int64), np.array([0, 255, 256, 70_000, 1 << 24])):
        assert (lm_scoring._unpack(lm_scoring._pack(word), len(word)) == word).all()


def test_lm_bigrams_travel_in_few_bytes(spark):
    """Bigrams of frequent words are told apart exactly and take under 5 of the 8 bytes that a key has; nothing is lost on the way."""
    rng = np.random.default_rng(6)
    rows = [(d, " ".join(f"w{w}" for w in rng.integers(0, 3000, 2000))) for d in range(100)]
    docs = documents(spark, rows)
    context = spark.sparkContext
    hot = lm_scoring.train_models(docs, F.lit(False)).hot()
    sent = docs.coalesce(1).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.lit(False).alias("target"))
    table = lm_scoring._entries(sent, context.broadcast(hot), context.broadcast(None), 7, True, False).toArrow()
    distinct = len({p for _, t in rows for p in zip(["^", *t.split()], t.split(), strict=False)})
    assert sum(table.column(c).nbytes for c in table.column_names if c in ("asked", "sizes")) < 5 * distinct
    pairs = table.filter(pa.compute.equal(table.column("width"), 2))
    entries, lengths = lm_scoring._unsqueezed(pairs)
    assert len(set(entries.tolist())) == distinct == lengths.sum() and entries.min() >= 0


def test_lm_entries_come_back():
    top = (1 << 62) - 1
    number = np.array([0, 1, 300, -1, -1, 5, top, -1, 7])
    keys = np.array([0, 0, 0, -(1 << 63), -1, 0, 0, -5, 0])
    entries, lengths = lm_scoring._unsqueezed(pa.table(lm_scoring._squeezed(np.array([0, 5, 7, 8, 9]), number, keys)))
    assert lengths.tolist() == [5, 2, 1, 1] and entries.tolist() == [0, 1, 300, -(1 << 63), -1, 5, top, -5, 7]
    for words in (0, 1, 2, 40):
        hot = lm_scoring.HotWords(*np.arange(5 * words).reshape(5, words))
        first, second = (x.ravel() for x in np.indices((words + 1, words + 1)))
        refs = np.r_[np.arange(words), lm_scoring.RARE + 9]
        number = hot.pairs(refs[first], refs[second])
        assert ((number < 0) == ((first == words) | (second == words))).all() and number.max() < 1 << hot.width
        assert len(set(number[number >= 0].tolist())) == words * words
        (order, bucket, _), _ = lm_scoring._deal(hot, refs, first, second, 3)
        assert sorted(order) == list(range(len(first))) and (np.diff(bucket[order]) >= 0).all() and set(bucket) <= {0, 1, 2}


def test_lm_buckets_grow_before_they_are_too_many():
    count = lm_scoring._bucket_count
    assert [count(n) for n in (0, lm_scoring.BUCKET_BYTES, 800 << 20)] == [1, 2, 201]
    assert count(50 << 30) <= 3201 and all((n << 20) / count(n << 20) <= 16 << 20 for n in range(1, 60_000, 997))


def labelled(seed=9, n=300):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for d in range(n):
        words = list(rng.choice(WORDS, int(rng.integers(20, 60))))
        bad = d % 3 == 0
        if bad:
            for i in rng.choice(len(words), 4, replace=False):
                words[i] = "horrible" + "".join(rng.choice(list("abcdef"), 2))
        rows.append((d, " ".join(words)))
        labels.append((d, int(not bad), int(bad)))
    return rows, labels


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers(spark, kind):
    rows, labels = labelled()
    truth = {d: (t if kind == "toxic" else q) for d, q, t in labels}
    if kind == "quality":
        rows = [(d, t if truth[d] else t.upper().replace(" ", "!! ")) for d, t in rows]
    rows += [(900, None), (901, ""), (None, "x y"), (902, "word " * 30_000)]
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    score = toxicity.toxicity_scores if kind == "toxic" else quality.quality_scores
    out = score(documents(spark, rows), table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= (0.7 if kind == "toxic" else 0.5))
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    none = score(documents(spark, rows[:5]), table.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    if kind == "toxic":
        left = toxicity.drop_toxic(documents(spark, rows), documents(spark, rows), table)
        assert {r.doc_id for r in left.collect()} == {r.doc_id for r in out if r.score < 0.7}


@pytest.mark.parametrize("size, caught", [("sf0.001", 2), ("sf0.01", 13)])
def test_toxic_rows_of_small_tables(spark, size, caught):
    """With 51 and 279 rows to learn from, held-out toxic rows are told apart and some pass the threshold."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_scores(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic, other = ([r for r in out if r.toxic == k] for k in (1, 0))
    assert sum(r.predicted for r in toxic) >= caught and sum(r.predicted for r in other) <= 0.05 * len(other)
    assert np.mean([a.score > b.score for a in toxic for b in other]) > 0.85


@pytest.mark.parametrize("shard", [768, 12])
def test_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr(vector_dedup, "SHARD", shard)
    rng = np.random.default_rng(10)
    rows = []
    for g in range(8):
        base = rng.normal(size=16)
        for k in range(40 if g == 0 else 6):
            rows.append([len(rows), (base + 0.08 * rng.normal(size=16)).tolist(), g % 2])
    rows += [[len(rows) + i, rng.normal(size=16).tolist(), i % 2] for i in range(60)]
    rows += [[500, rows[0][1], 0], [501, rows[0][1], 1], [502, [2 * x for x in rows[0][1]], 0], [503, rows[0][1], None], [504, None, 0], [505, [0.0] * 16, 0]]
    rows += [[506, [float("nan")] * 16, 0], [507, [None] * 16, 0], [508, [1.0, 0.0], 0], [509, [], 0], [510, [float("inf")] * 16, 1]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, component string")
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((a[0], b[0]))
    label, n_links = roots({r[0] for r in rows}, links), Counter(a for a, _ in links)
    found = vector_dedup.near_duplicate_vectors(df)
    out = {r.vec_id: r for r in found.collect()}
    assert len(out) == len(rows)
    assert all(r.n_links <= n_links[v] for v, r in out.items())
    assert sum(r.n_links for r in out.values()) >= 0.9 * len(links)
    if shard > len(rows):
        assert {v: r.component_id for v, r in out.items()} == label and {v: r.n_links for v, r in out.items()} == {v: n_links[v] for v in out}
    have, there = vector_dedup.audit_recall(df, found, every=2)
    assert there == sum(n for v, n in n_links.items() if v % 2 == 0) and have >= 0.9 * there
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def subgroups(groups, size=60, dimensions=64, seed=11):
    """One family in which every pair is above 0.99, of tight subgroups larger than the pool of neighbours."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dimensions)
    base /= np.linalg.norm(base)
    centers = base + 0.06 * (c := rng.normal(size=(groups, dimensions))) / np.linalg.norm(c, axis=1, keepdims=True)
    noise = rng.normal(size=(groups, size, dimensions))
    return (centers[:, None] + 0.002 * noise / np.linalg.norm(noise, axis=2, keepdims=True)).reshape(-1, dimensions)


def test_vectors_are_written_once(spark, monkeypatch):
    """Rounds, shards and links are tables without vectors, floats stay floats, and shards are dealt out in waves with the same result."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[i % 60] + rng.normal(0, 0.02, 8)).tolist(), i % 2) for i in range(600)] + [(i, base[0].tolist(), 0) for i in range(600, 640)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(vector_dedup, "SHARD", 60)
    whole = Counter(map(tuple, vector_dedup.near_duplicate_vectors(table).collect()))
    vectors = {r.vec_id: (r.label, np.array(r.embedding, dtype=float)) for r in table.collect()}
    unit = {i: v / np.linalg.norm(v) for i, (_, v) in vectors.items()}
    links = Counter(i for i in unit for j in unit if i != j and vectors[i][0] == vectors[j][0] and unit[i] @ unit[j] >= 0.98)
    assert {r[0]: r[1] for r in whole} == {i: links[i] for i in unit} and sum(links.values()) > 1000
    written = []
    monkeypatch.setattr(vector_dedup, "cut", lambda df, name: written.append((name, dict(df.dtypes))) or cut(df, name))
    monkeypatch.setattr(vector_dedup, "WAVE_ROWS", 300, raising=False)
    monkeypatch.setattr(vector_dedup, "WAVE_TIMES", 0.5, raising=False)
    assert Counter(map(tuple, vector_dedup.near_duplicate_vectors(table).collect())) == whole
    assert [(name, kinds["v"]) for name, kinds in written if "v" in kinds] == [("nodes", "array<float>")]
    assert sum(name == "links" for name, _ in written) > 2


@pytest.mark.parametrize("groups", [2, 3, 5, 10])
def test_vector_graph_of_tight_subgroups(groups):
    assert 60 > vector_dedup.POOL
    rows = subgroups(groups)
    # The medoid lies among unlike vectors: it leads no query into the family.
    rows = np.concatenate([rows, np.random.default_rng(12).normal(size=(100, 64))])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    a, b = vector_dedup.range_search(rows, vector_dedup._both_ways(vector_dedup.build_graph(rows)), np.arange(len(rows)), 0.98)
    want = (rows @ rows.T >= 0.98) & ~np.eye(len(rows), dtype=bool)
    assert want.sum() == 60 * groups * (60 * groups - 1) and set(zip(a, b, strict=True)) == set(zip(*np.nonzero(want), strict=True))


def test_vectors_of_tight_subgroups(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD", 300)
    rows = subgroups(5)
    rows = np.concatenate([rows, subgroups(16, seed=13)])  # the second family is compared in pairs of blocks
    table = spark.createDataFrame([(i, v.tolist(), int(i >= 300)) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicate_vectors(table).collect()}
    assert out == {i: (299, 0, i == 0) if i < 300 else (959, 300, i == 300) for i in range(len(rows))}


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.columns == (columns if name != "shard" else [*columns, "shard"])
    rows = docs.collect()
    assert rows and all(r.shard == jump(r.doc_id, 16) for r in rows)
