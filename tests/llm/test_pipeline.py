"""Every stage of the pipeline against brute force, on documents with planted toxic texts, copies, test items and small sources."""

import re
from collections import Counter

import numpy as np
import pytest

WORDS = [f"w{i}" for i in range(300)]
VILE = "vile rotten filth idiot scum".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]


def shingles(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jump(key, n):
    key, b, j = (key or 0) & (2**64 - 1), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rng = np.random.default_rng(17)
    rows, labels = [], []

    def add(text, source="hot"):
        rows.append((len(rows), text, "en", source, len(text or "")))

    for i in range(150):  # plain ones, most of them of one source
        add(" ".join(rng.choice(WORDS, int(rng.integers(20, 60)))), "hot" if i % 3 else f"s{i % 5}")
    for _ in range(40):
        w = list(rng.choice(WORDS, 30))
        for k in rng.choice(30, 8, replace=False):
            w[k] = VILE[int(rng.integers(0, len(VILE)))]
        add(" ".join(w))
    for i in range(10):  # exact and near copies
        add(rows[i][1], "copies")
        w = rows[i][1].split()
        add(" ".join([*w, "more"]), "copies")
    items = [(0, " ".join(rng.choice(WORDS, 15))), (1, "short secret words"), (2, None)]
    for item in items[:2]:
        add(" ".join([*rng.choice(WORDS, 40), item[1].upper(), *rng.choice(WORDS, 40)]))
    for text in (None, "", " \n", "one", "one"):
        add(text, None if text == "one" else "odd")
    rows += [(None, rows[20][1], "en", "hot", 1), (3, rows[3][1], "en", "hot", 1), (None, None, None, None, None)]
    labels = [(r[0], 1, int(any(v in (r[1] or "") for v in VILE))) for r in rows[:190] if r[0] % 3]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def key(row):
    return tuple(row)


def test_stages_equal_brute_force(spark, folder):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.collect()

    def run(name):
        nonlocal docs
        docs = stages[name](spark, docs, folder)
        assert docs.columns == (columns if name != "shard" else [*columns, "shard"])
        return docs.collect()

    # Toxic documents go, whether their labels were learned from or not; nothing else does.
    after = run("toxicity")
    assert Counter(map(key, after)) == Counter(key(r) for r in before if not any(v in (r.text or "") for v in VILE))
    # Of each group of near duplicates the smallest id stays, with all rows of that id.
    before, after = after, run("near_dedup")
    ids = sorted({r.doc_id for r in before if r.doc_id is not None})
    sets = [(r.doc_id, shingles(r.text)) for r in before if r.doc_id is not None and shingles(r.text)]
    label, changed = {i: i for i in ids}, True
    links = [(a, b) for a, s in sets for b, t in sets if a < b and 100 * len(s & t) >= 80 * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert len(links) >= 30
    assert Counter(map(key, after)) == Counter(key(r) for r in before if r.doc_id is None or label[r.doc_id] == r.doc_id)
    # Documents that hold a test item go, short items too.
    before, after = after, run("decontaminate")
    items = [words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]

    def holds(text):
        found = ((shingles(" ".join(w), min(5, len(w))), shingles(text, min(5, len(w)))) for w in items)
        return any(len(s & t) * 100 >= 80 * len(s) for s, t in found)

    clean = [r for r in before if r.doc_id is None or not holds(r.text)]
    assert len(clean) == len(before) - 2 and Counter(map(key, after)) == Counter(map(key, clean))
    # Every row as often as the mix takes its words, to one; words near the targets; rows without words stay.
    before, after = after, run("mix")
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(words_of(r.text))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, float(sum(sizes.values()))
    open_ = [s for s in order]
    while open_:  # shares by weight, sources at three times their size fixed, the rest dealt anew
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    taken, times = Counter(), Counter(map(key, after))
    for r in after:
        taken[r.source] += len(words_of(r.text))
    assert set(times) <= set(map(key, before))
    for r in before:
        if not words_of(r.text):
            assert times[key(r)] == Counter(map(key, before))[key(r)]
        else:
            assert times[key(r)] <= 3 * Counter(map(key, before))[key(r)]
    assert abs(taken["hot"] - target["hot"]) < 0.2 * target["hot"] + 100
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.15)
    again = corpus_pipeline.mix(spark, spark.createDataFrame(before, SCHEMA), folder).collect()
    assert Counter(map(key, again)) == times
    # Shards by jump hashing.
    before, after = after, run("shard")
    assert Counter(map(key, after)) == Counter((*r, jump(r.doc_id, 16)) for r in before)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
