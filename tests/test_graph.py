import random
from collections import deque

from trawlwork import queries as Q
from trawlwork.operators import graph as G
from trawlwork.plans.skew import bounded_broadcast, lookup_join

BASE = "http://h"


def repeated(url):
    segs = url.strip("/").split("/")
    return len(set(segs)) < len(segs)


def crawl_by_queue(root, links, limit):
    """The definition: a queue, a visited set, children in link order."""
    seen, out, queue = {root}, [(root, root, None, 0)], deque([(root, 0)])
    while queue:
        url, depth = queue.popleft()
        if url.lower().endswith(".pdf"):
            continue
        for link in links.get(url, []):
            if depth + 1 > limit or link in seen:
                continue
            seen.add(link)
            if not repeated(link):
                out.append((root, link, url, depth + 1))
                queue.append((link, depth + 1))
    return out


def test_crawl_equals_a_queue(spark):
    rng = random.Random(7)
    names = [f"{BASE}/n{i}" for i in range(60)] + [f"{BASE}/d{i}.pdf" for i in range(5)] + [f"{BASE}/r/r", f"{BASE}//x"]
    links = {n: list(dict.fromkeys(rng.choices(names, k=rng.randint(0, 4)))) for n in names[:55] + names[60:63]}
    links[names[0]] = names[1:50]  # a hub
    roots = names[:8] + [f"{BASE}/unlinked"]
    table = spark.createDataFrame(
        [(u, link, i) for u, ls in links.items() for i, link in enumerate(ls)], "url string, link string, position int"
    )
    start = spark.createDataFrame([(r,) for r in roots], "root string")
    for limit in (0, 1, 3):
        want = {row for r in roots for row in crawl_by_queue(r, links, limit)}
        for hub_rows in (10, 10**6):  # with and without shared-out hub links
            nodes = G.crawl_bfs(start, table, limit, hub_rows).collect()
            assert {(n.root, n.url, n.parent_url, n.depth) for n in nodes} == want
            assert len(nodes) == len(want)


def crawl_with_redirects(root, links, targets, limit):
    """The definition: every request is mapped once, links come from the page it ends at, visited are requests."""
    seen, out, queue = {root}, [], deque([(root, None, 0)])
    while queue:
        url, parent, depth = queue.popleft()
        final, expands = targets.get(url, (url, False))
        out.append((root, url, final, parent, depth))
        for link in links.get(final, []) if expands else []:
            if depth + 1 > limit or link in seen:
                continue
            seen.add(link)
            if not repeated(link):
                queue.append((link, final, depth + 1))
    return out


def test_crawl_with_redirects(spark):
    rng = random.Random(11)
    names = [f"{BASE}/n{i}" for i in range(40)]
    links = {n: list(dict.fromkeys(rng.choices(names, k=rng.randint(0, 5)))) for n in names[:35]}
    targets = {n: (n, True) for n in names[:30]} | {names[31]: (names[31], False)}
    targets |= {names[0]: (names[5], True), names[6]: (names[7], True), names[8]: (names[7], True)}  # a root, two to one
    targets |= {names[1]: (names[2], True), names[2]: (names[1], True), names[3]: (names[3], True)}  # a cycle
    links[names[5]] = [names[5], names[6], names[8], names[0], names[1], names[2]]
    table = spark.createDataFrame([(u, x, i) for u, ls in links.items() for i, x in enumerate(ls)], "url string, link string, position int")
    aims = spark.createDataFrame([(u, f, e) for u, (f, e) in targets.items()], "url string, final_url string, expands boolean")
    start = spark.createDataFrame([(r,) for r in names[:4] + names[36:]], "root string")
    want = [row for r in names[:4] + names[36:] for row in crawl_with_redirects(r, links, targets, 3)]
    for hot, share in ((10**6, 10**6), (3, 2)):
        nodes = G.crawl_bfs(start, table, 3, hot, aims, share).collect()
        assert sorted((n.root, n.url, n.final_url, n.parent_url or "", n.depth) for n in nodes) == sorted((r, u, f, p or "", d) for r, u, f, p, d in want)
    # The redirected root comes again under its final address; only what has no children goes.
    all_nodes = G.crawl_bfs(start, table, 3, targets=aims)
    kept = G.dedupe_visited_nodes(all_nodes, url="final_url").collect()
    assert len(kept) < len(nodes) and len({(n.root, n.final_url) for n in kept}) == len(kept)
    paths = {(n.root, tuple(n.path)) for n in kept}
    assert all(not n.path or (n.root, tuple(n.path[:-1])) in paths for n in nodes)
    assert [n.url for n in kept if n.root == names[0] and n.final_url == names[5]] == [names[0]]


def test_one_page_under_many_roots_and_many_hubs(spark):
    """A page that all roots link to, and more pages with many links than any broadcast of names would take."""
    roots = [f"{BASE}/root{i}" for i in range(300)]
    links = {r: [f"{BASE}/home"] for r in roots} | {f"{BASE}/home": [f"{BASE}/hub{i}" for i in range(40)]}
    links |= {f"{BASE}/hub{i}": [f"{BASE}/leaf{i}-{k}" for k in range(30)] for i in range(40)}
    table = spark.createDataFrame([(u, x, i) for u, ls in links.items() for i, x in enumerate(ls)], "url string, link string, position int")
    start = spark.createDataFrame([(r,) for r in roots[:50]], "root string")
    nodes = G.crawl_bfs(start, table, 3, hub_rows=20, share_links=8)
    counts = {(r.depth): r["count"] for r in nodes.groupBy("depth").count().collect()}
    assert counts == {0: 50, 1: 50, 2: 2000, 3: 60_000}
    want = {row for row in crawl_by_queue(roots[0], links, 3)}
    assert {(n.root, n.url, n.parent_url, n.depth) for n in nodes.filter(nodes.root == roots[0]).collect()} == want


def test_links_are_shuffled_once(spark):
    """With the broadcast of small sides off, a level shuffles its frontier to the links' buckets and leaves the links where they are."""
    table = spark.createDataFrame([(f"{BASE}/{i}", f"{BASE}/{3 * i + k}", k) for i in range(50) for k in range(3)], "url string, link string, position int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    store = G.LinkStore(table, None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = spark.createDataFrame([("r", f"{BASE}/{i}", [0], 1) for i in range(20)], "root string, next string, path array<int>, next_shares int")
        plan = store.follow(frontier)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(url") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        store.drop()


def test_relevant_crawl(spark):
    links = spark.createDataFrame(
        [(BASE, f"{BASE}/menu?b=2&a=1", 0), (BASE, f"{BASE}/about", 1), (f"{BASE}/menu", f"{BASE}/menu/soup#x", 0)],
        "url string, link string, position int",
    )
    relevant = spark.createDataFrame([(f"{BASE}/menu?a=1&b=2",), (f"{BASE}/menu/soup",)], "url string")
    start = spark.createDataFrame([(BASE,)], "root string")
    nodes = G.crawl_bfs_relevant(start, G.canonical_links(links), relevant).collect()
    assert {n.url for n in nodes} == {BASE, f"{BASE}/menu", f"{BASE}/menu/soup"}


NODES = "root string, path array<int>, url string, depth int, has_content boolean, scraped_items map<string,array<string>>"


def tree(spark):
    return spark.createDataFrame(
        [
            ("t", [], "r", 0, True, {"soup": ["salt"], "tea": []}),
            ("t", [0], "a", 1, True, {"soup": ["beet", "salt"]}),
            ("t", [1], "b", 1, False, {}),
            ("t", [1, 0], "c", 2, True, {"cake": ["egg"]}),
            ("t", [0, 3], "d", 2, True, {"tea": []}),
        ],
        NODES,
    )


def test_rollup_and_cut_off(spark):
    whole = {r["item"]: r.ingredients for r in G.subtree_rollup(tree(spark)).collect()}
    assert whole == {"soup": ["beet", "salt"], "tea": [], "cake": ["egg"]}
    reached = G.reachable_nodes(tree(spark))
    assert {r.url for r in reached.collect()} == {"r", "a", "d"}
    books = {(tuple(r.node_path), r["item"]): r.ingredients for r in G.subtree_rollup(reached, every_node=True).collect()}
    assert books == {
        ((), "soup"): ["beet", "salt"],
        ((), "tea"): [],
        ((0,), "soup"): ["beet", "salt"],
        ((0,), "tea"): [],
        ((0, 3), "tea"): [],
    }


def test_rollup_ignores_row_order(spark):
    rows = tree(spark).collect()
    books = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        books.append(sorted(map(str, G.subtree_rollup(spark.createDataFrame(rows, NODES)).collect())))
    assert books[0] == books[1] == books[2]


def test_dedupe(spark):
    rows = [("t", [0], "x", 1, True, {}), ("t", [1], "x", 1, True, {"a": []}), ("t", [0, 0], "x", 2, True, {}), ("u", [], "x", 0, True, {})]
    kept = G.dedupe_visited_nodes(spark.createDataFrame(rows, NODES)).collect()
    assert {(r.root, tuple(r.path)) for r in kept} == {("t", (0,)), ("u", ())}


def test_one_step_orders_discoverers(spark):
    rows = [("t", "n", "p2", 0, [1, 0]), ("t", "n", "p1", 5, [0, 5]), ("t", "old", "p1", 1, [0, 1]), ("t", "http://a/a", "p1", 2, [0, 2])]
    candidates = spark.createDataFrame(rows, "root string, url string, parent_url string, position int, path array<int>")
    visited = spark.createDataFrame([("t", "old")], "root string, url string")
    got = {r.url: (r.parent_url, r.admitted) for r in G.frontier_step(candidates, visited, 2).collect()}
    assert got == {"n": ("p1", True), "http://a/a": ("p1", False)}  # the host counts as a segment
    assert G.frontier_step(candidates, visited, 4).count() == 0


def test_growing_sides_are_not_broadcast(spark):
    """However small its files are, a table that grows with the crawl never goes through the driver."""
    rows = [("t", f"u{i}", "p", i, [i]) for i in range(9)]
    candidates = spark.createDataFrame(rows, "root string, url string, parent_url string, position int, path array<int>")
    known = candidates.select("root", "url").filter("position < 4")
    frames = {
        "step": G.frontier_step(candidates, known, 1),
        "lookup": lookup_join(candidates, known.select("url"), ["url"], "inner"),
        "bound": candidates.join(bounded_broadcast(known.select("url"), rows=2), "url"),
        "reached": G.reachable_nodes(tree(spark)),
    }
    for name, frame in frames.items():
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString(), name
    assert {name: frame.count() for name, frame in frames.items()} == {"step": 5, "lookup": 4, "bound": 4, "reached": 3}


def test_links_of_one_small_file_are_made_in_all_tasks(spark, tmp_path):
    part = spark.createDataFrame([(k, 30) for k in range(200)], "p_partkey long, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    links = Q._part_links(spark, str(tmp_path))
    assert links.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and links.count() == 1000
