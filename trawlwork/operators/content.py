"""From pages and responses to links, texts, prompts and items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlwork.functions import text as X
from trawlwork.functions import urls as U
from trawlwork.plans.lineage import cut
from trawlwork.plans.skew import lookup_join
from trawlwork.settings import (
    PACKING_ROWS,
    PROMPT_HTML_EXTRACT,
    PROMPT_PDF_EXTRACT,
    ROBOTS_ARRAY_RULES,
    TOKEN_LIMIT,
)

#: Stands for a null shard, which is a run of its own, while pandas has the rows.
_NO_SHARD = -(1 << 63)


def extract_links(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, link, position)`` for ``pages(keys, url, html)``: same-site links of every page.

    Links are resolved against the page; a repeated link keeps its first place. All of it happens within
    the page's row, so nothing is shuffled; the explode comes last, so no step is computed twice.
    """
    hrefs = F.transform(X.anchor_attributes(F.col("html")), lambda a: X.attribute_value(a, "href"))
    present = F.filter(hrefs, lambda h: h.isNotNull())
    links = U.same_site(F.col("url"), U.resolve_links(F.col("url"), F.array_distinct(present)))
    return pages.select(*(keys or ["url"]), F.posexplode(F.array_distinct(links)).alias("position", "link"))


def find_menu_link(html: Column) -> Column:
    """The menu link of a listing page, else its website link, else null.

    Only the first tag of each kind counts; an empty address falls through to the next kind.
    """

    def first_href(tags: Column, item: str, tooltip: str) -> Column:
        mine = F.filter(
            tags,
            lambda t: (X.raw_attribute(t, "data-item-id") == item) & (X.raw_attribute(t, "data-tooltip") == tooltip),
        )
        return F.nullif(X.raw_attribute(F.try_element_at(mine, F.lit(1)), "href"), F.lit(""))

    href = U.let(
        X.anchor_attributes(html),
        lambda tags: F.coalesce(
            first_href(tags, "menu", "Open menu link"), first_href(tags, "authority", "Open website")
        ),
    )
    return X.decode_entities(href, attribute=True)


def pages_to_document_text(
    pages: DataFrame, key: str, page_no: str, text: str = "text", pages_per_part: int | None = None
) -> DataFrame:
    """``(key, part_no, text)``: page texts joined in page order without separator, blank pages skipped.

    A document is one row with part 0, whatever its length. With ``pages_per_part`` it is consecutive rows, whole
    when put together; whoever asks for parts carries ``part_no`` on.
    """
    filled = pages.filter(F.coalesce(F.col(text) != "", F.lit(False)))
    number = F.lit(0).cast("bigint") if pages_per_part is None else F.floor(F.col(page_no) / pages_per_part)
    part = number.alias("part_no")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(page_no), F.col(text).alias("text"))))
    joined = F.array_join(F.transform(ordered, lambda p: p["text"]), "")
    return filled.groupBy(key, part).agg(joined.alias("text"))


def dispatch_content(content_type: Column, html: Column, pdf_text: Column) -> Column:
    """Text of a page by its type; null for another type or absent content."""
    return F.when(content_type == "html", X.html_to_text(html)).when(content_type == "pdf", pdf_text)


def extraction_prompts(
    pages: DataFrame, html_template: str = PROMPT_HTML_EXTRACT, pdf_template: str = PROMPT_PDF_EXTRACT
) -> DataFrame:
    """``pages(..., content_type, text)`` plus ``prompt``, ready for a batch job."""
    prompt = F.when(F.col("content_type") == "pdf", X.fill_prompt(pdf_template, F.col("text"))).otherwise(
        X.fill_prompt(html_template, F.col("text"))
    )
    return pages.withColumn("prompt", prompt)


def chunk_by_tokens(texts: DataFrame, key: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``(key, chunk_no, chunk)``: consecutive chunks of at most ``limit`` tokens."""
    return texts.select(key, F.posexplode(X.chunk_tokens(F.col("text"), limit)).alias("chunk_no", "chunk"))


def token_budget_batches(
    texts: DataFrame, key: str, limit: int = TOKEN_LIMIT, shard: Column | None = None, tokens: Column | None = None, part_rows: int = PACKING_ROWS
) -> DataFrame:
    """Greedy ordered packing into batches of at most ``limit`` tokens: ``(shard, batch_no, key, chunk_no)``.

    A new batch opens when the next text would exceed the limit; a longer text is cut into chunks that are
    packed alike. Order is ``key``, over all texts: one run, shard 0. With ``shard`` every shard is a run of its own. Only token
    counts reach the scan. ``tokens`` replaces the token count of a text by that of another tokenizer.

    Packing is sequential, but what came before a part of the order matters by one number, how full the open batch is. So every
    range of about ``part_rows`` entries says, side by side, how full it leaves the batch and how many it opens for each fill it may
    meet; these few rows are chained in order, and then every range packs with its own start.
    """
    counted = texts.select(
        key,
        F.coalesce((F.lit(0) if shard is None else shard).cast("bigint"), F.lit(_NO_SHARD)).alias("shard"),
        (X.token_counts(F.col("text")) if tokens is None else tokens).alias("n"),
    )
    # Chunk sizes follow from the count: full chunks, then the rest. A blank text is one empty entry.
    last = F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / limit)
    sized = counted.select(
        "shard", key, "n", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_no")
    ).withColumn("n", F.least(F.col("n") - F.col("chunk_no") * limit, F.lit(limit)))
    # The last order column only keeps equal rows apart, so that a key with very many rows is cut into ranges too.
    entries = cut(sized.withColumn("row", F.monotonically_increasing_id()), "packing-entries")
    parts = max(1, -(-entries.count() // part_rows))
    order = ["shard", key, "chunk_no", "row"]
    key_type = texts.schema[key].dataType.simpleString()
    schema = f"shard bigint, batch_no bigint, {key} {key_type}, chunk_no int"

    def packed_range(group: pd.DataFrame, fill: int, opened: int) -> pd.DataFrame:
        group = group.sort_values(order, na_position="first")
        numbers = pack_range(group["n"].to_numpy(), group["shard"].to_numpy(), limit, fill, opened)
        return group.assign(batch_no=numbers)[["shard", "batch_no", key, "chunk_no"]]

    if parts == 1:
        whole = entries.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(lambda group: packed_range(group, limit + 1, 0), schema)
        return whole.withColumn("shard", F.nullif("shard", F.lit(_NO_SHARD)))
    placed = cut(entries.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "packing-ranges")
    steps = placed.groupBy("part").applyInPandas(
        lambda group: range_steps(group.sort_values(order, na_position="first"), limit),
        "part int, first_shard bigint, last_shard bigint, least bigint, fill bigint, opened bigint",
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where every range starts; one range's few rows are held at a time."""
        now, fill, opened = None, limit + 1, 0  # fuller than full: the first entry opens a batch
        for steps_of in _by_part(batches):
            first, last_shard = steps_of[0][1:3]
            if first != now:
                fill, opened = limit + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array([steps_of[0][0]], pa.int32()), pa.array([fill], pa.int64()), pa.array([opened], pa.int64())], names=["part", "fill", "opened"])
            step = next(s for s in reversed(steps_of) if s[3] <= fill)
            opened = step[5] + (opened if first == last_shard else 0)
            now, fill = last_shard, step[4]

    starts = cut(steps.repartition(1).sortWithinPartitions("part", "least").mapInArrow(chain, "part int, fill bigint, opened bigint"), "packing-starts")

    def pack(group: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        return packed_range(group, *(int(start[c].iloc[0]) for c in ("fill", "opened")))

    packed = placed.groupBy("part").cogroup(starts.groupBy("part")).applyInPandas(pack, schema)
    return packed.withColumn("shard", F.nullif("shard", F.lit(_NO_SHARD)))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _next_starts(sizes: np.ndarray, shards: np.ndarray, limit: int) -> np.ndarray:
    """For every entry where the batch after one that starts with it starts: what no longer fits, or another shard."""
    ends = np.cumsum(sizes)
    full = np.searchsorted(ends, ends - sizes + limit, side="right")
    runs = np.flatnonzero(np.r_[shards[1:] != shards[:-1], True]) + 1
    return np.minimum(np.maximum(full, np.arange(1, len(sizes) + 1)), runs[np.searchsorted(runs, np.arange(len(sizes)), side="right")])


def pack_range(sizes: np.ndarray, shards: np.ndarray, limit: int, fill: int, opened: int) -> np.ndarray:
    """Batch numbers of consecutive entries, after a range that left ``opened`` batches, the last one with ``fill`` tokens."""
    n, following = len(sizes), _next_starts(sizes, shards, limit)
    first_run = int(np.flatnonzero(np.r_[shards[1:] != shards[:-1], True])[0]) + 1
    start = min(int(np.searchsorted(np.cumsum(sizes), limit - fill, side="right")), first_run) if fill <= limit else 0
    numbers = np.full(n, opened - 1, dtype=np.int64)
    batch = opened
    while start < n:
        if start and shards[start] != shards[start - 1]:
            batch = 0
        stop = int(following[start])
        numbers[start:stop] = batch
        start, batch = stop, batch + 1
    return numbers


def range_steps(group: pd.DataFrame, limit: int) -> pd.DataFrame:
    """What a range does to the open batch: rows ``(part, first_shard, last_shard, least, fill, opened)``.

    From a fill of ``least`` on, up to the next row's, the range leaves a batch with ``fill`` tokens and has opened ``opened`` more,
    those of its last shard if it has several. A fill above ``limit`` stands for no open batch.
    """
    sizes, shards = group["n"].to_numpy(), group["shard"].to_numpy()
    n, ends, following = len(sizes), np.cumsum(sizes), _next_starts(sizes, shards, limit)
    last_run = int(np.r_[0, np.flatnonzero(shards[1:] != shards[:-1]) + 1][-1])
    left, opened = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    after = following.tolist()
    for i in range(n - 1, -1, -1):  # where a batch that starts here leads
        j = after[i]
        if j >= n:
            left[i], opened[i] = ends[-1] - ends[i] + sizes[i], 1
        else:
            left[i], opened[i] = left[j], opened[j] + (i >= last_run)
    if last_run:
        rows = [(0, left[last_run], opened[last_run])]
    else:
        fits = int(np.searchsorted(ends, limit, side="right"))
        # With a fill above limit - ends[i], entry i opens a batch; below the least of these all entries fit.
        rows = [] if fits < n else [(0, None, 0)]
        for i in range(min(fits, n - 1), -1, -1):
            rows.append((max(0, limit - int(ends[i]) + 1), int(left[i]), int(opened[i])))
    total = int(ends[-1])
    spread: list[tuple] = []
    for least, fill, count in rows:
        if fill is None:  # nothing is opened: the fill grows by all of it, a step for every fill
            spread += [(f, f + total, 0) for f in range(limit - total + 1)]
        elif spread and spread[-1][0] == least:
            spread[-1] = (least, fill, count)
        elif not spread or spread[-1][1:] != (fill, count):
            spread.append((least, fill, count))
    part, first, last = (int(group[c].iloc[k]) for c, k in (("part", 0), ("shard", 0), ("shard", -1)))
    return pd.DataFrame([(part, first, last, *s) for s in spread], columns=["part", "first_shard", "last_shard", "least", "fill", "opened"])


def pick_response(responses: DataFrame, key: str, n: str = "n", text: str = "text") -> DataFrame:
    """``(key, response)``: the last response of each page, lower-cased; '' when the list was empty."""
    return responses.groupBy(key).agg(F.lower(F.coalesce(F.max_by(text, n), F.lit(""))).alias("response"))


def parse_items(response: Column) -> Column:
    """``array<struct<item, ingredients>>`` of a cleaned response; the last line of an item wins.

    Lines read ``item:ingredient|ingredient``; ``n/a`` gives no ingredients, a line without a colon nothing.
    """
    line = r"^([^\n]+?):([^\n]*)"

    def parse_line(text: Column, number: Column) -> Column:
        ingredients = U.strip(F.regexp_extract(text, line, 2))
        return F.struct(
            U.strip(F.regexp_extract(text, line, 1)).alias("item"),
            number.alias("number"),
            F.when(ingredients == "n/a", F.array().cast("array<string>"))
            .otherwise(F.transform(F.split(ingredients, r"\|"), U.strip))
            .alias("ingredients"),
        )

    lines = F.filter(F.split(response, "\n"), lambda t: t.rlike(line))
    # Sorted by item and line, an entry is its item's last one when the next entry has another item.
    return U.let(
        F.array_sort(F.transform(lines, parse_line)),
        lambda entries: F.transform(
            F.filter(
                entries,
                lambda e, i: F.coalesce(F.get(entries, i + 1)["item"] != e["item"], F.lit(True)),
            ),
            lambda e: F.struct(e["item"].alias("item"), e["ingredients"].alias("ingredients")),
        ),
    )


def parse_item_lines(responses: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """``(keys, item, ingredients)``, one row per item of a response."""
    items = parse_items(X.clean_response(F.col(column)))
    return responses.select(*keys, F.inline(items))


def items_with_fallback(pages: DataFrame, html_items: DataFrame, pdf_items: DataFrame) -> DataFrame:
    """``(url, items)``: items of the html, or of the pdf where the html gave none or the route is pdf.

    ``pages(url, has_html, has_pdf)``; a page with neither content is absent. Items are
    ``array<struct<item, ingredients>>``, one row per URL on either side.
    """
    both = (
        pages.filter(F.col("has_html") | F.col("has_pdf"))
        .join(html_items.withColumnRenamed("items", "_html"), "url", "left")
        .join(pdf_items.withColumnRenamed("items", "_pdf"), "url", "left")
    )
    from_html = F.when((U.content_route(F.col("url")) == "html") & (F.size("_html") > 0), F.col("_html"))
    empty = F.array().cast(html_items.schema["items"].dataType)
    return both.select("url", F.coalesce(from_html, F.col("_pdf"), empty).alias("items"))


def resolve_redirects(requests: DataFrame, redirects: DataFrame, content: DataFrame) -> DataFrame:
    """``(url, final_url, hit)`` for each requested URL, looked up by its canonical form.

    ``redirects(url, final_url)`` and ``content(url, has_content)`` hold canonical URLs. A mapping to a URL
    without content is a miss. Only flags move: the content itself joins later, by ``final_url``.
    """
    wanted = requests.select("url", U.canonical_url(F.col("url")).alias("_key"))
    mapped = cut(
        lookup_join(cut(wanted, "wanted"), redirects.select(F.col("url").alias("_key"), "final_url"), ["_key"]), "mapped"
    )
    stored = content.filter("has_content").select(F.col("url").alias("final_url"), F.lit(True).alias("_stored"))
    return lookup_join(mapped, stored, ["final_url"]).select(
        "url",
        F.when(F.col("_stored"), F.col("final_url")).alias("final_url"),
        F.coalesce(F.col("_stored"), F.lit(False)).alias("hit"),
    )


def robots_filter(pages: DataFrame, rules: DataFrame, agent: str, array_rules: int = ROBOTS_ARRAY_RULES) -> DataFrame:
    """``pages(url, ...)`` plus ``allowed``, from ``rules(domain, agent, rule_no, allow, prefix)``.

    The agent's product token (before ``/``) is compared. The first group in file order whose name is part of it
    applies, else the ``*`` group; a group's first matching rule decides, no rule allows. An empty disallow rule allows
    everything. Map service addresses are always allowed. The rules of a domain travel as one array up to ``array_rules``; pages of
    domains with more meet them by the prefixes of their paths, of the lengths that occur there.
    """
    mine = F.lit(agent.split("/")[0].lower()).contains(F.lower(F.col("agent")))
    group = F.struct(F.when(F.col("agent") == "*", 1).otherwise(0).alias("general"), F.col("rule_no"), F.lower("agent").alias("name"))
    asked = rules.filter(mine | (F.col("agent") == "*")).select("domain", F.lower("agent").alias("name"), "rule_no", "allow", "prefix", group.alias("group"))
    chosen = asked.groupBy("domain").agg(F.min("group").alias("first")).select("domain", F.col("first.name").alias("name"))
    # Of equal prefixes only the first rule ever decides; a rule for everything is one with an empty prefix.
    every = F.when(F.col("prefix") == "*", "").otherwise(F.coalesce("prefix", F.lit("")))
    decides = F.struct("rule_no", (F.col("allow") | (F.col("prefix") == "")).alias("allow"))
    kept = cut(asked.join(chosen, ["domain", "name"]).groupBy("domain", every.alias("prefix")).agg(F.min(decides).alias("rule")), "robots-rules")
    sizes = kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("prefix")).alias("lengths"))
    large = cut(sizes.filter(F.col("n") > array_rules).select("domain", F.sort_array("lengths").alias("_lengths")), "large-robots")
    small = kept.join(large.select("domain"), "domain", "left_anti") if not large.isEmpty() else kept
    by_domain = small.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("rule.rule_no", "rule.allow", "prefix"))).alias("_rules"))
    keyed = (
        pages.withColumn("_parts", U.url_parts(F.col("url")))
        .withColumn("domain", F.col("_parts.netloc"))
        .withColumn("_path", F.when(F.col("_parts.path") == "", F.lit("/")).otherwise(F.col("_parts.path")))
        .drop("_parts")
    )
    always = F.col("url").contains("google.com") | F.col("url").contains("/maps.")
    matching = F.filter("_rules", lambda r: F.col("_path").startswith(r["prefix"]))
    first = F.try_element_at(matching, F.lit(1))["allow"]
    joined = lookup_join(keyed, by_domain, ["domain"]).withColumn("_first", first).drop("_rules")
    if not large.isEmpty():
        numbered = cut(joined.withColumn("_row", F.monotonically_increasing_id()), "robots-pages")
        of_large = lookup_join(numbered.select("_row", "domain", "_path"), large, ["domain"], "inner")
        fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
        starts = of_large.select("_row", "domain", F.explode(F.transform(fitting, lambda n: F.col("_path").substr(F.lit(1), n))).alias("prefix"))
        met = lookup_join(cut(starts, "path-prefixes"), kept, ["domain", "prefix"], "inner")
        found = met.groupBy("_row").agg(F.min("rule").alias("_rule")).select("_row", F.col("_rule.allow").alias("_large"))
        joined = numbered.join(found, "_row", "left").withColumn("_first", F.coalesce("_large", "_first")).drop("_row", "_large")
    return joined.withColumn("allowed", always | F.coalesce("_first", F.lit(True))).drop("_first", "_path", "domain")
