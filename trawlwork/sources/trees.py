"""Site trees as JSON and as flat node tables.

A forest file is ``{place_id: node}`` with ``node = {url, descriptor, scraped_items, menu_book, children}``.
Trees nest without limit and Spark has no recursive type, so a forest is held as flat rows
``(place_id, path, parent_path, depth, position, url, parent_url, descriptor, scraped_items, menu_book)``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlwork.plans.lineage import cut

BOOK = "map<string,array<string>>"
NODE_SCHEMA = (
    "place_id string, path array<int>, parent_path array<int>, depth int, position int, url string, "
    f"parent_url string, descriptor string, scraped_items {BOOK}, menu_book {BOOK}"
)
NODE_COLUMNS = [
    "place_id", "path", "parent_path", "depth", "position", "url", "parent_url", "descriptor",
    "scraped_items", "menu_book",
]


def _named(url: Column) -> Column:
    """The url of a node; a node without one is an error."""
    return F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(
        F.raise_error(F.concat(F.lit("a node without url in tree "), F.coalesce("place_id", F.lit("null")))).cast("string")
    )


def _given(book: Column) -> Column:
    return F.coalesce(book, F.create_map().cast(BOOK))


def _strings(value) -> list[str] | None:
    """A JSON list as strings; what is no list gives null."""
    return [v if v is None or isinstance(v, str) else json.dumps(v) for v in value] if isinstance(value, list) else None


def _book(value) -> list[tuple]:
    return [(k, _strings(v)) for k, v in value.items()] if isinstance(value, dict) else []


def flat_trees(document: str | None) -> Iterator[tuple]:
    """The nodes of a JSON object of trees as rows of ``NODE_COLUMNS``, each after its parent: one pass, of any depth.

    A document that is no JSON object has none, and neither has a tree that is no object.
    """
    try:
        trees = json.loads(document or "")
    except (ValueError, RecursionError):
        return
    open_ = [(place, (), 0, None, tree) for place, tree in reversed(trees.items())] if isinstance(trees, dict) else []
    while open_:
        place, path, position, above, node = open_.pop()
        if not isinstance(node, dict):
            continue
        url, descriptor = node.get("url"), node.get("descriptor")
        if not url:
            raise ValueError(f"a node without url in tree {place}")
        yield place, list(path), list(path[:-1]) if path else None, len(path), position, url, above, descriptor, _book(node.get("scraped_items")), _book(node.get("menu_book"))
        children = node.get("children")
        if isinstance(children, list):
            open_ += [(place, (*path, i), i, url, children[i]) for i in range(len(children) - 1, -1, -1)]


def _read_nested(documents: DataFrame) -> DataFrame:
    """Flatten ``documents(value)``, each a JSON object of trees, in the task that reads it."""
    kinds = pa.schema(
        [("place_id", pa.string()), ("path", pa.list_(pa.int32())), ("parent_path", pa.list_(pa.int32())), ("depth", pa.int32()), ("position", pa.int32())]
        + [(c, pa.string()) for c in ("url", "parent_url", "descriptor")]
        + [(c, pa.map_(pa.string(), pa.list_(pa.string()))) for c in ("scraped_items", "menu_book")]
    )

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document in batch.column(0):
                rows = flat_trees(document.as_py())
                while part := list(islice(rows, 1000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds.types, strict=True)], schema=kinds)

    return cut(documents.select("value").mapInArrow(flatten, NODE_SCHEMA), "trees")


def _only_missing(error: AnalysisException) -> None:
    """A path that does not exist is an empty forest; any other error is one."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


def _node_rows(spark: SparkSession, path: str) -> DataFrame:
    """Nodes as :func:`write_site_trees` stores them; a line that is no JSON is an error, and so is a node without ``url``."""
    rows = spark.read.schema(NODE_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.select(*[_given(F.col(c)).alias(c) if c in ("scraped_items", "menu_book") else _named(F.col(c)).alias(c) if c == "url" else c for c in NODE_COLUMNS])


def read_site_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the forest at ``path``: a folder made by :func:`write_site_trees`, or nested JSON to import.

    Nested JSON is a forest file, a folder of them, or the lines of :func:`export_nested_trees`. A missing file or broken
    nested JSON gives an empty forest; a node without ``url`` is an error.
    """
    for place, read in (
        (f"{path}/nodes", lambda p: _node_rows(spark, p)),
        (f"{path}/nested", lambda p: _read_nested(spark.read.text(p))),
        (path, lambda p: _read_nested(spark.read.text(p, wholetext=True))),
    ):
        try:
            return read(place).select(*NODE_COLUMNS)
        except AnalysisException as error:
            _only_missing(error)
    return spark.createDataFrame([], NODE_SCHEMA)


def _node_json(children: Column) -> Column:
    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    def text(value: Column) -> Column:
        quoted = F.to_json(F.array(value))
        return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(quoted, 2, F.length(quoted) - 2))

    return F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            field("url", text(F.col("url"))),
            field("descriptor", text(F.col("descriptor"))),
            field("scraped_items", F.to_json("scraped_items")),
            field("menu_book", F.to_json("menu_book")),
            field("children", F.concat(F.lit("["), children, F.lit("]"))),
        ),
        F.lit("}"),
    )


def nest_site_trees(nodes: DataFrame) -> DataFrame:
    """``(place_id, json)``: each tree as one nested JSON value, children in order, built bottom-up."""
    nodes = cut(nodes, "nodes")
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    none = F.lit(None).cast("string")
    below = None
    for level in range(depth, -1, -1):
        here = nodes.filter(F.col("depth") == level)
        if below is None:
            here = here.withColumn("_children", none)
        else:
            joined = F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("position", "json"))), lambda c: c["json"]), ","
            )
            grouped = below.groupBy("place_id", F.col("parent_path").alias("path")).agg(joined.alias("_children"))
            here = here.join(grouped, ["place_id", "path"], "left")
        below = here.select(
            "place_id", "parent_path", "position", _node_json(F.coalesce("_children", F.lit(""))).alias("json")
        )
    return below.select("place_id", "json")


def write_site_trees(nodes: DataFrame, path: str) -> None:
    """Write a forest as node rows, one JSON line each, under ``nodes``: one format for trees of every size."""
    nodes.select(*NODE_COLUMNS).write.mode("overwrite").json(f"{path}/nodes")


def export_nested_trees(nodes: DataFrame, path: str) -> None:
    """One line ``{place_id: tree}`` per place under ``nested``, for readers of that format.

    A tree is one value there by its nature; :func:`write_site_trees` is what a run stores.
    """
    key = F.to_json(F.array("place_id"))
    line = F.concat(F.lit("{"), F.substring(key, 2, F.length(key) - 2), F.lit(":"), F.col("json"), F.lit("}"))
    nest_site_trees(nodes.select(*NODE_COLUMNS)).select(line.alias("value")).write.mode("overwrite").text(f"{path}/nested")


def merge_site_trees(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old forest with every place of the new one replaced whole."""
    kept = old.join(new.select("place_id").distinct(), "place_id", "left_anti")
    return kept.unionByName(new)
