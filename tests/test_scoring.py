import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlwork import queries
from trawlwork.functions import text as X
from trawlwork.functions import vectors as V
from trawlwork.operators import relevance as R
from trawlwork.operators import scoring as S
from trawlwork.operators import vectors as W
from trawlwork.sources.profile import collect_profile, load_profile

PLANE = {"soup": [1, 0], "borsch": [1, 1], "beet": [0, 2], "red beet": [0, 1], "salt": [-1, 0], "zero": [0, 0], "short": [1]}


def embedding_from(table):
    # A nested function travels to the workers by value; this module is not on their path.
    return lambda phrases: [table.get(p) for p in phrases]


plane = embedding_from(PLANE)


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, item string, ingredients array<string>")


PROFILE = {"name": [" Soup", ""], "main": ["beet"], "side": ["salt"], "none": []}


def scores(spark, rows, profile=PROFILE, weights=None, **kw):
    out = S.match_items(items(spark, *rows), load_profile(spark, profile, weights), ["id"], embed=plane, **kw)
    return {r.id: (r.combined_score, r.attribute_scores) for r in out.collect()}


def test_hybrid_by_hand(spark):
    got = scores(
        spark,
        [
            (1, "Borsch ", ["red beet", "soup"]),
            (2, "soup", []),
            (3, "soup", [""]),
            (4, "", ["salt"]),
            (5, "unknown", ["unknown", "short", "zero"]),
            (6, "salt", []),
        ],
    )
    half = math.sqrt(0.5)
    assert got[1][0] == pytest.approx(0.5 * half + 0.5 * (1 / 3))
    assert got[1][1] == pytest.approx({"name": 1.0, "main": 1.0, "side": 0.0, "none": 0.0})
    assert got[2] == (1.0, {"name": 0.0, "main": 0.0, "side": 0.0, "none": 0.0})
    assert got[3][0] == 0 and got[5][0] == 0
    assert got[4][0] == pytest.approx(0.5 / 3)  # no name, one of three attributes
    assert got[6][0] == 0  # only negative similarity


def test_threshold_and_weights(spark):
    rows = [(1, "soup", ["borsch"])]
    half = math.sqrt(0.5)
    assert scores(spark, rows)[1][0] == pytest.approx(0.5 + 0.5 * half / 3)
    assert scores(spark, rows, threshold=0.8)[1][0] == 0.0
    heavy = {"main": 3, "side": 1, "none": 0, "elsewhere": 4}
    assert scores(spark, rows, weights=heavy)[1][0] == pytest.approx(0.5 + 0.5 * 3 * half / 8)


def test_items_without_a_mean_are_dropped_unless_gated(spark):
    rows = [(1, "soup", ["beet"]), (2, "soup", []), (3, "soup", ["unknown"])]
    for weights in ({"main": 0}, {"main": 1}):  # zero total; missing weights
        assert scores(spark, rows, weights=weights) == {3: (0.0, {"name": 0.0, "main": 0.0, "side": 0.0, "none": 0.0})}
    # No attribute but the name: nothing to weigh; beet is orthogonal to soup, so item 1 is gated too.
    assert set(scores(spark, rows, profile={"name": ["soup"]})) == {1, 3}


def test_vector_table_gives_the_same_scores(spark):
    rows = items(spark, (1, "Borsch", ["red beet", "soup"]), (2, "soup", []), (3, "x", ["zero", "short", "unknown"]))
    profile = load_profile(spark, PROFILE)
    table = spark.createDataFrame([(p, [float(x) for x in v]) for p, v in PLANE.items()], "phrase string, embedding array<float>")
    a = S.score_items(rows, profile, ["id"], embed=plane).select("id", "combined_score", "attribute_scores")
    b = S.score_items(rows, profile, ["id"], vectors=table).select("id", "combined_score", "attribute_scores")
    for x, y in zip(a.orderBy("id").collect(), b.orderBy("id").collect(), strict=True):
        assert x.combined_score == pytest.approx(y.combined_score)
        assert [s.score for s in x.attribute_scores] == pytest.approx([s.score for s in y.attribute_scores])


def test_ngrams(column):
    got = column(lambda a: X.word_ngrams(a), [(["A b  c d", " ", "x"],), ([],)], "v array<string>")
    assert got == [["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d", "x"], []]


def test_cosine(column):
    pairs = [([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])]
    kind = "a array<double>, b array<double>"
    got = column(V.cosine_similarity, pairs, kind)
    assert got == pytest.approx([1, -1, 0, 0])
    assert column(V.cosine_similarity, [(b, a) for a, b in pairs], kind) == pytest.approx(got)
    assert all(-1 - 1e-9 <= x <= 1 + 1e-9 for x in got)


def test_embedding_counts_trigrams():
    vectors = V.trigram_embedding(["ab", "a", "ü€"])
    assert vectors.shape == (3, V.DIMENSIONS) and list(vectors.sum(axis=1)) == [2, 1, 2]
    cell = (ord(" ") * 961 + ord("a") * 31 + ord("b")) % V.DIMENSIONS
    assert vectors[0][cell] == 1
    assert V.trigram_embedding([]).shape == (0, V.DIMENSIONS)


def test_embed_phrases_leaves_out_failures(spark):
    phrases = W.normalize_phrases(spark.createDataFrame([(" Soup ",), ("soup",), ("nope",), (" ",)], "phrase string"))
    got = {r.phrase: r.embedding for r in W.embed_phrases(phrases, plane).collect()}
    assert got == {"soup": [1.0, 0.0]}


def test_max_similarity_small_and_large(spark):
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(40, 5)), rng.normal(size=(23, 5))
    right[5] = right[6]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    matrix = unit(left) @ unit(right).T
    rows = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id int, embedding array<double>")
    for limit in (4096, 7):  # carried along; block by block
        got = {r.id: r.score for r in W.max_similarity(rows(left), rows(right), "id", limit).collect()}
        assert got == pytest.approx(dict(enumerate(matrix.max(axis=1))))
    pairs = W.pairwise_similarity(rows(left), rows(right).withColumnRenamed("id", "r"), "id", "r").collect()
    assert np.allclose([r.scores for r in sorted(pairs, key=lambda r: r.id)], matrix)


@pytest.mark.parametrize("limit", [4096, 2])
def test_max_similarity_edges(spark, limit):
    schema = "id int, embedding array<double>"
    left = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, 2.0, 2.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0])], schema)
    right = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [3.0]), (5, [2.0, 0.0]), (6, [4.0, 0.0])], schema)
    got = sorted(((r.id, r.score) for r in W.max_similarity(left, right, "id", limit).collect()), key=str)
    assert got == [(1, 0.0), (1, 1.0), (1, 1.0), (2, None), (3, 0.0), (4, 0.0), (5, 0.0)]
    none = W.max_similarity(left, right.filter("id = 2"), "id", limit).collect()
    assert len(none) == 7 and all(r.score is None for r in none)


def test_similarity_tiles(spark):
    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(30, 4)), rng.normal(size=(23, 4))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    matrix = unit(left) @ unit(right).T
    rows = lambda m, name: spark.createDataFrame([(i // 2 if name == "id" else i, r.tolist()) for i, r in enumerate(m)], f"{name} int, embedding array<double>")
    lefts, rights = rows(left, "id"), rows(right, "r")
    tiles = W.similarity_tiles(lefts, rights, "id", "r", tile_rows=7, block_rows=9).collect()
    assert len(tiles) == 30 * 4 and {(t.tile, len(t.scores)) for t in tiles} == {(0, 7), (1, 7), (2, 7), (3, 2)}
    for t in tiles:
        own = matrix[2 * t.id : 2 * t.id + 2, 7 * t.tile : 7 * t.tile + 7]
        assert np.abs(own - np.array(t.scores)).max(axis=1).min() < 1e-12
    whole = W.pairwise_similarity(lefts, rights, "id", "r", limit=7).collect()  # repeated keys keep rows of their own
    assert np.allclose(sorted(r.scores for r in whole), sorted(matrix.tolist()))


def test_similarity_tiles_as_text(spark):
    """The text of the scores is made where they are, with the digits that the JVM would write, halves and nulls too."""
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(40, 5)).round(2)
    rows = [(i, r.tolist()) for i, r in enumerate(matrix)] + [(40, None), (41, [0.0] * 5), (42, [1.0]), (43, [None, 1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "id int, embedding array<double>")
    rights = table.withColumnRenamed("id", "r")
    tiles = W.similarity_tiles(table, rights, "id", "r", tile_rows=7, block_rows=9)
    shown = F.array_join(F.transform("scores", lambda s: F.format_string("%.4f", s)), " ")
    wanted = tiles.select("id", "tile", shown.alias("scores")).collect()
    written = W.similarity_tiles(table, rights, "id", "r", tile_rows=7, block_rows=9, decimals=4)
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, wanted)) and any("null" in t.scores for t in wanted)
    values = [0.12345, -0.12345, -0.00004, 0.00005, -0.0, 0.0, 1.0000000000000002, -1.0, 0.99995, 0.00015, None, 0.5, 0.99994999]
    for some in (values, [*values, 1.5, -12.00005, float("inf")]):
        wanted = spark.createDataFrame([(some,)], "s array<double>").select(F.array_join(F.transform("s", lambda s: F.format_string("%.4f", s)), " ")).first()[0]
        assert W.written_scores(np.array([some] * 3, dtype=float), 4).to_pylist() == [wanted] * 3
    assert W.written_scores(np.zeros((2, 0)), 4).to_pylist() == ["", ""] and len(W.written_scores(np.zeros((0, 3)), 4)) == 0


def test_tiles_query_writes_no_numbers_one_by_one(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "vec_id long, embedding array<float>")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.pairwise_similarity_tiles(spark, str(tmp_path))
    assert "format_string" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(r.tile for r in out.collect()) == {0: 300, 1: 300, 2: 300}


def test_tiles_copy_no_vectors_in_shuffles(spark):
    """Every block meets every tile in a cross join; the vectors are shuffled once, not once a tile."""
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "id int, embedding array<double>")
    tiles = W.similarity_tiles(rows, rows.withColumnRenamed("id", "r"), "id", "r", tile_rows=3, block_rows=5)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroups" not in plan
    assert tiles.count() == 40 * 14


def test_profiles_of_any_size(spark):
    """Profiles and keyword lists too large to carry score as carried ones do, with a function and with a table of vectors."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    wanted = {"name": [word() for _ in range(30)], "main": [word() for _ in range(40)], "side": ["beet"], "none": []}
    some = items(spark, *[(i, word(), [f"{word()} {word()}" for _ in range(i % 4)]) for i in range(40)], (40, "", []), (41, "beet", ["beet"]))
    profile = load_profile(spark, wanted, {"main": 2.0, "side": 1.0, "none": 0.5})
    large = collect_profile(profile, limit=10)
    assert large.table is not None and set(large.phrases) == set(wanted) and large.total_weight == 3.5
    show = lambda df: {r.id: (round(r.combined_score, 9), {k: round(v, 9) for k, v in r.attribute_scores.items()}) for r in df.collect()}
    carried = show(S.match_items(some, profile, ["id", "item"]))
    assert len(carried) == 42 and show(S.match_items(some, large, ["id", "item"])) == carried
    table = W.embed_phrases(W.phrase_universe(some).unionByName(profile.select("phrase").filter("phrase <> ''")).distinct())
    assert show(S.match_items(some, large, ["id", "item"], vectors=table)) == carried
    many = load_profile(spark, {"name": [f"p{i}" for i in range(4097)]})
    assert S.name_similarity(items(spark, (1, "p77", [])), many, ["id"]).first().name_score == pytest.approx(1)
    urls = spark.createDataFrame([(u,) for u in URLS], "url string")
    few = {r.url: round(r.score, 9) for r in R.url_relevance(urls).collect()}
    assert {r.url: round(r.score, 9) for r in R.url_relevance(urls, limit=3).collect()} == few


URLS = ["http://h/menu", "http://h/x/y", "http://h", "http://h/zzz?menu&q", "http://h/menu"]


def test_url_relevance_paths_agree(spark):
    urls = spark.createDataFrame([(u,) for u in URLS], "url string")
    inline = {r.url: r.score for r in R.url_relevance(urls).collect()}
    vocabulary = R.segment_vocabulary(urls).select(F.col("segment").alias("phrase"))
    joined = {r.url: r.score for r in R.url_relevance(urls, vectors=W.embed_phrases(vocabulary)).collect()}
    assert inline == pytest.approx(joined)
    assert inline["http://h/menu"] == pytest.approx(1) and inline["http://h"] == 0 and len(inline) == 4


def test_relevance_threshold_is_strict_and_cached_scores_count(spark):
    urls = spark.createDataFrame([("HTTP://H/menu#x",), ("http://h/x/y",), ("mailto:x",)], "url string")
    got = {r.url for r in R.filter_relevant_urls(urls, threshold=0.99999).collect()}
    assert got == {"http://h/menu"}
    cache = spark.createDataFrame([("http://h/x/y", 0.6), ("http://h/menu", 0.55)], "key string, value double")
    cache = cache.withColumn("key_hash", F.md5("key")).select("key_hash", "value")
    assert {r.url for r in R.filter_relevant_urls(urls, threshold=0.55, cache=cache).collect()} == {"http://h/x/y"}


def test_phrase_universe(spark):
    got = W.phrase_universe(items(spark, (1, " Soup ", ["Red beet"]), (2, "", [" "])))
    assert {r.phrase for r in got.collect()} == {"soup", "red", "beet", "red beet"}
