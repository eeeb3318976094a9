import json

import pytest

from trawlwork.sources import trees

FOREST = {
    "p1": {
        "url": "http://a/",
        "descriptor": None,
        "scraped_items": {"a \"quoted\" item": ["x", "é\n"]},
        "menu_book": {"soup": ["beet"]},
        "children": [
            {"url": "http://a/1", "descriptor": "one", "scraped_items": {}, "menu_book": {}, "children": []},
            {
                "url": "http://a/2",
                "descriptor": "two",
                "scraped_items": {"tea": []},
                "menu_book": {},
                "children": [{"url": "http://a/2/3", "descriptor": "x"}],
            },
        ],
    },
    "p2": {"url": "http://b/", "descriptor": "b", "scraped_items": {}, "menu_book": {}, "children": []},
}


def filled(node):
    out = {"descriptor": None, "scraped_items": {}, "menu_book": {}, **node}
    out["children"] = [filled(c) for c in node.get("children", [])]
    return out


def nested(frame):
    return {r.place_id: json.loads(r.json) for r in trees.nest_site_trees(frame).collect()}


def test_read_and_nest_back(spark, tmp_path):
    path = tmp_path / "forest.json"
    path.write_text(json.dumps(FOREST, indent=4))
    nodes = trees.read_site_trees(spark, str(path))
    rows = {r.url: r for r in nodes.collect()}
    assert len(rows) == 5
    assert rows["http://a/2/3"].path == [1, 0] and rows["http://a/2/3"].parent_url == "http://a/2"
    assert nested(nodes) == {k: filled(v) for k, v in FOREST.items()}


def test_write_round_trip(spark, tmp_path):
    path = tmp_path / "forest.json"
    path.write_text(json.dumps(FOREST))
    nodes = trees.read_site_trees(spark, str(path))
    out, lines = str(tmp_path / "out"), str(tmp_path / "lines")
    trees.write_site_trees(nodes, out)
    trees.export_nested_trees(nodes, lines)
    for stored in (out, lines):
        assert nested(trees.read_site_trees(spark, stored)) == {k: filled(v) for k, v in FOREST.items()}
    assert spark.read.text(f"{out}/nodes").count() == 5


def test_stored_rows_are_checked(spark, tmp_path):
    row = {"place_id": "p", "path": [], "depth": 0, "position": 0}
    for name, line in (("no-url", json.dumps(row)), ("broken", '{"place_id": ')):
        (tmp_path / name / "nodes").mkdir(parents=True)
        (tmp_path / name / "nodes" / "part.json").write_text(line + "\n")
        with pytest.raises(Exception, match="without url|MALFORMED"):
            trees.read_site_trees(spark, str(tmp_path / name)).collect()
    trees.write_site_trees(spark.createDataFrame([], trees.NODE_SCHEMA), str(tmp_path / "none"))
    assert trees.read_site_trees(spark, str(tmp_path / "none")).count() == 0


def test_missing_and_broken_files_are_empty(spark, tmp_path):
    assert trees.read_site_trees(spark, str(tmp_path / "nothing.json")).count() == 0
    (tmp_path / "broken.json").write_text('{"p": {"url": ')
    assert trees.read_site_trees(spark, str(tmp_path / "broken.json")).count() == 0


def test_node_without_url_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"p": {"url": "u", "children": [{"descriptor": "x"}]}}')
    with pytest.raises(Exception, match="without url"):
        trees.read_site_trees(spark, str(tmp_path / "bad.json")).count()


def test_merge_replaces_whole_places(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "place_id string, n int")
    new = spark.createDataFrame([("a", 9), ("c", 4)], "place_id string, n int")
    assert sorted(tuple(r) for r in trees.merge_site_trees(old, new).collect()) == [("a", 9), ("b", 3), ("c", 4)]


def test_deep_and_broken_trees(spark, tmp_path):
    import json
    import time

    def deep(levels):
        node = {"url": f"u{levels}", "children": None}
        for i in range(levels - 1, -1, -1):
            node = {"url": f"u{i}", "descriptor": None, "scraped_items": {"i": ["a", 1, None]}, "menu_book": None, "children": [node, {"url": f"leaf{i}"}]}
        return node

    (tmp_path / "deep.json").write_text(json.dumps({"p": deep(200), "q": "no tree"}))
    start = time.time()
    nodes = trees.read_site_trees(spark, str(tmp_path / "deep.json")).collect()
    assert time.time() - start < 30
    assert len(nodes) == 401 and max(n.depth for n in nodes) == 200
    by_url = {n.url: n for n in nodes}
    assert by_url["leaf7"].path == [0] * 7 + [1] and by_url["leaf7"].parent_path == [0] * 7 and by_url["leaf7"].parent_url == "u7"
    assert by_url["u0"].scraped_items == {"i": ["a", "1", None]} and by_url["u0"].menu_book == {} and by_url["u0"].parent_path is None
    assert list(trees.flat_trees("[1]")) == list(trees.flat_trees("{")) == list(trees.flat_trees(None)) == []
    with pytest.raises(ValueError, match="without url"):
        list(trees.flat_trees('{"p": {"url": ""}}'))
