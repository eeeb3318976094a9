"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from trawlwork.queries import (
    CACHE_SPLIT,
    CENTER,
    CHUNK_LIMIT,
    PART_PROFILE,
    SHARD_DOCS,
    TILE_ROWS,
)
from trawlwork.settings import (
    PROMPT_HTML_EXTRACT,
    TARGET_URL_KEYWORDS,
    TOKEN_LIMIT,
)

_ORACLES: dict[str, str] = {}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


# ---- URLs -----------------------------------------------------------------------------------------

_URL = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"((?:[^?#]*/)?[^/?#;]*)(?:;([^/?#]*))?(?:\?([^#]*))?(?:#([\s\S]*))?$"
)


def _part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{_URL}', {group})"


_VARIANTS = """
variants AS (
  SELECT page_id, 0 AS variant, url FROM pages
  UNION ALL
  SELECT page_id, 1,
         'HTTP://User:pw@' || upper(regexp_extract(url, '^https?://([^/?#]*)', 1)) || ':8080'
         || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) || ';v=1?b=2&a=x+y&e=&c=%7E*%20z#f_1&g'
  FROM pages)"""

_PARTS = f"""
parts AS (
  SELECT page_id, variant, url, lower({_part("url", 1)}) AS scheme, {_part("url", 2)} AS netloc,
         {_part("url", 3)} AS path, {_part("url", 4)} AS params, {_part("url", 5)} AS query,
         {_part("url", 6)} AS fragment,
         lower(regexp_extract(regexp_extract({_part("url", 2)}, '([^@]*)$', 1), '^([^:]*)', 1)) AS host,
         try_cast(regexp_extract({_part("url", 2)}, ':([0-9]+)$', 1) AS INT) AS port
  FROM variants)"""

_ORACLES["url_parts"] = f"""
WITH {_VARIANTS}, {_PARTS}
SELECT page_id, variant, scheme, netloc, host, port, path, params, query, fragment FROM parts"""


def _canonical(query: str) -> str:
    """SQL for the sorted, re-encoded query; blank values go."""
    pairs = (
        f"[struct_pack(n := url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')),"
        f" v := url_decode(replace(regexp_extract(p, '^[^=]*=([\\s\\S]*)$', 1), '+', ' ')))"
        f" for p in string_split({query}, '&') if regexp_matches(p, '^[^=]*=[\\s\\S]')]"
    )
    return (
        f"array_to_string([replace(url_encode(x.n), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')"
        f" for x in list_sort({pairs})], '&')"
    )


_CANONICAL = f"""
canonicals AS (
  SELECT page_id, variant, url, scheme || '://' || host || CASE WHEN port > 0 THEN ':' || port ELSE '' END
         || CASE WHEN path = '' THEN '/' ELSE path END
         || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical
  FROM (SELECT *, coalesce({_canonical("query")}, '') AS q FROM parts))"""

_ORACLES["canonical_url"] = f"""
WITH {_VARIANTS}, {_PARTS}, {_CANONICAL}
SELECT page_id, variant, canonical FROM canonicals"""

_ORACLES["crawl_key_url"] = f"""
WITH {_VARIANTS}, {_PARTS}
SELECT page_id, variant, regexp_replace(scheme || '://' || netloc || path, '/+$', '') AS crawl_key FROM parts"""

_VISIBLE = r"regexp_replace(html, '<!--[\s\S]*?-->|<script[\s\S]*?</script>|<style[\s\S]*?</style>', ' ', 'g')"


def _entities(sql: str) -> str:
    for name, text in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("am", "&am"), ("amp", "&")):
        sql = rf"regexp_replace({sql}, '&{name}(;|\b)', {_text(text)}, 'g')"
        # '&am' is no entity: it stays as it is; '&amp' is handled last.
    return sql


_HREFS = f"""
hrefs AS (
  SELECT page_id, url, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS position
  FROM (SELECT page_id, url, regexp_extract_all({_VISIBLE}, '<a href="([^"]*)"', 1) AS l FROM pages))"""

_ORACLES["resolve_link"] = f"""
WITH {_HREFS}, refs AS (
  SELECT page_id, url, replace(raw, '&amp;', '&') AS href FROM hrefs
  UNION ALL
  SELECT page_id, url, unnest(['/abs/x', 'rel', './y', '../z', '?q=1', '#f', '//other.example/p',
                               'https://o.example/k', 'mailto:a@b', '']) FROM pages),
split AS (
  SELECT *, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(url, '#.*$', '') AS bare
  FROM refs),
dirs AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM split)
SELECT DISTINCT page_id, href, CASE
    WHEN href = '' THEN url
    WHEN href LIKE 'mailto:%' OR href LIKE 'https://%' THEN href
    WHEN href LIKE '//%' THEN scheme || ':' || href
    WHEN href LIKE '/%' THEN site || href
    WHEN href LIKE '?%' THEN site || path || href
    WHEN href LIKE '#%' THEN bare || href
    WHEN href LIKE '../%' THEN site || CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END || href[4:]
    WHEN href LIKE './%' THEN site || dir || href[3:]
    ELSE site || dir || href END AS link
FROM dirs"""

_KEY = f"regexp_replace(lower({_part('url', 1)}) || '://' || {_part('url', 2)} || {_part('url', 3)}, '/+$', '')"

_ORACLES["path_has_repeat"] = f"""
WITH keys AS (SELECT page_id, {_KEY} AS k FROM pages),
keyed AS (
  SELECT page_id, 0 AS variant, k AS crawl_key FROM keys
  UNION ALL
  SELECT page_id, 1, k || regexp_extract(k, '^https?://[^/]*(/[^/]*)', 1) FROM keys),
segs AS (SELECT *, string_split(trim(crawl_key, '/'), '/') AS s FROM keyed)
SELECT page_id, variant, crawl_key,
       EXISTS (SELECT 1 FROM (SELECT unnest(s) AS x) GROUP BY x HAVING count(*) > 1) AS repeats
FROM segs"""

_ORACLES["valid_url_filter"] = """
WITH forms AS (
  SELECT page_id, 0 AS variant, url FROM pages
  UNION ALL SELECT page_id, 1, regexp_replace(url, '^https?://', '') FROM pages
  UNION ALL SELECT page_id, 2, regexp_replace(url, '^https?:', '') FROM pages
  UNION ALL SELECT page_id, 3, regexp_replace(url, '^https?://', 'mailto:') FROM pages)
SELECT page_id, variant, url FROM forms WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]')"""

_ORACLES["content_route"] = """
WITH forms AS (
  SELECT page_id, 0 AS variant, url FROM pages
  UNION ALL SELECT page_id, 1, url || '.PDF' FROM pages
  UNION ALL SELECT page_id, 2, url || '.pdf?x=1' FROM pages)
SELECT page_id, variant, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS route FROM forms"""

_SEGMENTS = """
segments AS (
  SELECT page_id, variant, url,
         flatten([[lower(trim(x)) for x in string_split_regex(c, '[._-]') if x <> '']
                  for c in list_concat(string_split(path, '/'), string_split(query, '&'), string_split(fragment, '&'))]) AS s
  FROM parts)"""

_ORACLES["url_segments"] = f"""
WITH {_VARIANTS}, {_PARTS}, {_SEGMENTS}
SELECT page_id, variant, array_to_string(s, '|') AS segments FROM segments"""

_KEYWORDS = "keywords AS (SELECT unnest([" + ", ".join(_text(k) for k in TARGET_URL_KEYWORDS) + "]) AS keyword)"

_ORACLES["segment_vocabulary"] = f"""
WITH {_VARIANTS}, {_PARTS}, {_SEGMENTS}, {_KEYWORDS}
SELECT unnest(s) AS segment FROM segments UNION SELECT keyword FROM keywords"""

# ---- page content ---------------------------------------------------------------------------------

_LINKS = """
links AS (
  SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY min(position)) - 1 AS position
  FROM (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(raw, '&amp;', '&') AS link
        FROM hrefs WHERE raw LIKE '/%')
  GROUP BY page_id, url, link)"""

_ORACLES["extract_links"] = f"WITH {_HREFS}, {_LINKS} SELECT page_id, link, CAST(position AS INT) AS position FROM links"

_SITE = """CASE c_custkey % 5
    WHEN 0 THEN 'https://c' || c_custkey || '.example.com/menu?a=1&b=2'
    WHEN 1 THEN 'https://c' || c_custkey || '.example.com/'
    WHEN 2 THEN 'https://c' || c_custkey || '.example.com/'
    WHEN 3 THEN 'https://c' || c_custkey || '.example.com/menu?a=1&b=2' END"""

_ORACLES["find_menu_link"] = f"SELECT c_custkey, {_SITE} AS site FROM customer"

_MARKUP = r"<!--[\s\S]*?-->|<script[\s\S]*?</script>|<style[\s\S]*?</style>|<[!?][^>]*>|</?[A-Za-z][^>]*>"
_PAGE_TEXT = (
    f"array_to_string([{_strip('x')} for x in string_split("
    + _entities(f"regexp_replace(html, '{_MARKUP}', chr(1), 'g')")
    + f", chr(1)) if {_strip('x')} <> ''], ' ')"
)

_ORACLES["html_to_text"] = f"SELECT page_id, {_PAGE_TEXT} AS text FROM pages"

_ORACLES["pages_to_document_text"] = """
SELECT conv_id, CAST(0 AS BIGINT) AS part_no, string_agg(text, '' ORDER BY turn) AS text
FROM conversations WHERE text <> '' GROUP BY conv_id"""

_ORACLES["dispatch_content"] = f"""
SELECT 'page-' || page_id AS id,
       CASE WHEN page_id % 10 = 9 THEN 'image' ELSE 'html' END AS content_type,
       CASE WHEN page_id % 10 <> 9 THEN {_PAGE_TEXT} END AS text
FROM pages
UNION ALL
SELECT 'conv-' || conv_id, 'pdf', string_agg(text, '' ORDER BY turn) FROM conversations WHERE text <> '' GROUP BY conv_id"""

_HEAD, _TAIL = (_text(t) for t in PROMPT_HTML_EXTRACT.split("{}"))

_ORACLES["extraction_prompts"] = f"""
SELECT doc_id, CAST(length(prompt) AS INT) AS n_chars, md5(prompt) AS prompt_md5
FROM (SELECT doc_id, {_HEAD} || text || {_TAIL} AS prompt FROM documents)"""

_TOKENS = f"tokens AS (SELECT doc_id, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS t FROM documents)"

_ORACLES["token_counts"] = f"WITH {_TOKENS} SELECT doc_id, CAST(len(t) AS INT) AS n_tokens FROM tokens"

_ORACLES["chunk_by_tokens"] = f"""
WITH {_TOKENS}, starts AS (
  SELECT doc_id, t, unnest(range(0, len(t), {CHUNK_LIMIT})) AS i FROM tokens)
SELECT doc_id, CAST(i // {CHUNK_LIMIT} AS INT) AS chunk_no,
       array_to_string(t[i + 1 : i + {CHUNK_LIMIT}], ' ') AS chunk
FROM starts"""

_ORACLES["token_budget_batches"] = f"""
WITH RECURSIVE {_TOKENS}, sized AS (
  SELECT doc_id, len(t) AS n, unnest(range(0, greatest(len(t), 1), {TOKEN_LIMIT})) AS i FROM tokens),
entries AS (
  SELECT doc_id // {SHARD_DOCS} AS shard, doc_id, CAST(i // {TOKEN_LIMIT} AS INT) AS chunk_no,
         least(n - i, {TOKEN_LIMIT}) AS size,
         row_number() OVER (PARTITION BY doc_id // {SHARD_DOCS} ORDER BY doc_id, i) AS r
  FROM sized),
packed AS (
  SELECT shard, r, doc_id, chunk_no, CAST(0 AS BIGINT) AS batch_no, size AS used FROM entries WHERE r = 1
  UNION ALL
  SELECT e.shard, e.r, e.doc_id, e.chunk_no,
         CASE WHEN p.used + e.size > {TOKEN_LIMIT} THEN p.batch_no + 1 ELSE p.batch_no END,
         CASE WHEN p.used + e.size > {TOKEN_LIMIT} THEN e.size ELSE p.used + e.size END
  FROM packed p JOIN entries e ON e.shard = p.shard AND e.r = p.r + 1)
SELECT shard, batch_no, doc_id, chunk_no FROM packed"""

_ORACLES["token_budget_batches_in_order"] = _ORACLES["token_budget_batches"].replace(f"doc_id // {SHARD_DOCS}", "CAST(0 AS BIGINT)")

_ORACLES["pick_response"] = """
SELECT conv_id, lower(arg_max(text, turn)) AS response FROM conversations GROUP BY conv_id"""

_FENCED = """CASE turn % 4 WHEN 0 THEN '```output' || chr(10) || text || chr(10) || '```'
    WHEN 1 THEN '```output' || text || '```' WHEN 2 THEN ' ' || chr(9) || text || chr(10) || '```' || chr(10) ELSE text END"""
_UNFENCED = "replace(replace(replace(replace(f, '```output' || chr(10), ''), '```output', ''), chr(10) || '```', ''), '```', '')"

_ORACLES["clean_response"] = f"""
SELECT conv_id, turn, {_strip(_UNFENCED)} AS response FROM (SELECT conv_id, turn, {_FENCED} AS f FROM conversations)"""

_ORACLES["parse_item_lines"] = """
WITH lines AS (
  SELECT p_partkey // 20 AS response_id, p_partkey, CASE p_partkey % 5
           WHEN 2 THEN ':' || lower(p_name) ELSE lower(p_name) END AS item,
         CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN lower(p_type) || '|' || lower(p_brand)
           WHEN 2 THEN lower(p_type) ELSE '' END AS ingredients,
         CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n
  FROM part WHERE p_partkey % 5 <> 3)
SELECT response_id, item, arg_max(ingredients, p_partkey) AS ingredients, CAST(arg_max(n, p_partkey) AS INT) AS n
FROM lines GROUP BY ALL"""

_ORACLES["items_with_fallback"] = """
SELECT 'https://shop.example/p/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.pdf' ELSE '' END AS url,
       CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 = 0 THEN p_name || '=' || p_type
            WHEN p_partkey % 5 <> 0 THEN p_name || ' (pdf)=' || p_brand ELSE '' END AS items
FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 <> 0"""

_PAGE_CANONICAL = f"""
{_VARIANTS}, {_PARTS}, {_CANONICAL},
pc AS (SELECT page_id, url, canonical FROM canonicals WHERE variant = 0)"""

_ORACLES["resolve_redirects"] = f"""
WITH {_PAGE_CANONICAL},
firsts AS (SELECT canonical, min(page_id) AS first_id FROM pc GROUP BY canonical),
requests AS (SELECT page_id, url, canonical FROM pc UNION ALL SELECT page_id, url || '#x', canonical FROM pc),
found AS (
  SELECT r.url, CASE WHEN f.first_id % 2 = 0 AND (f.first_id % 50) % 10 <> 4
                     THEN 'https://final.example/' || (f.first_id % 50) END AS final_url
  FROM requests r JOIN firsts f USING (canonical))
SELECT url, final_url, final_url IS NOT NULL AS hit FROM found"""

_ORACLES["robots_filter"] = """
WITH p AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain,
         regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, url, CASE
    WHEN domain LIKE 'm.%' THEN true
    WHEN domain LIKE 'blog.%' THEN path NOT LIKE '/es%'
    WHEN path LIKE '/fr%' THEN false WHEN path LIKE '/en/1%' THEN true WHEN path LIKE '/en%' THEN false
    ELSE true END AS allowed
FROM p"""

# ---- crawl graph ----------------------------------------------------------------------------------

_EDGES = """
edges AS (
  SELECT 'https://shop.example/p/' || p_partkey AS url, unnest([
           'https://shop.example/p/' || (p_partkey * 3 + 1), 'https://shop.example/p/' || (p_partkey * 3 + 2),
           'https://shop.example/p/' || (p_partkey * 3 + 3), 'https://shop.example/p/' || (p_partkey // 2),
           'https://shop.example/p/' || p_partkey || '/p']) AS link, unnest([0, 1, 2, 3, 4]) AS position
  FROM part),
roots AS (SELECT DISTINCT 'https://shop.example/p/' || p_partkey AS root FROM part)"""


def _levels(depth: int) -> str:
    """One CTE per crawl level: discover, keep the first discoverer, skip what any earlier level saw."""
    ctes = [
        "l0 AS (SELECT root, root AS url, CAST(NULL AS VARCHAR) AS parent_url, 0 AS depth, 0 AS position,"
        " CAST([] AS BIGINT[]) AS path, true AS ok FROM roots)"
    ]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT root, url FROM l{i}" for i in range(d))
        ctes.append(f"""
l{d} AS (
  SELECT root, url, parent_url, {d} AS depth, position, path,
         len(list_distinct(string_split(trim(url, '/'), '/'))) = len(string_split(trim(url, '/'), '/')) AS ok
  FROM (SELECT f.root, e.link AS url, f.url AS parent_url, e.position, list_append(f.path, e.position) AS path,
               row_number() OVER (PARTITION BY f.root, e.link ORDER BY list_append(f.path, e.position)) AS rn
        FROM l{d - 1} f JOIN edges e ON e.url = f.url WHERE f.ok)
  WHERE rn = 1 AND (root, url) NOT IN ({seen}))""")
    return ", ".join(ctes)


def _crawl(depth: int) -> str:
    return " UNION ALL ".join(
        f"SELECT root, url, parent_url, depth, position FROM l{d} WHERE ok" for d in range(depth + 1)
    )


_ORACLES["frontier_step"] = f"""
WITH {_EDGES}, {_levels(1)}
SELECT root, url, parent_url, depth, position, ok AS admitted FROM l1"""

_ORACLES["crawl_bfs"] = f"WITH {_EDGES}, {_levels(3)} {_crawl(3)}"

_ORACLES["crawl_bfs_relevant"] = f"""
WITH {_EDGES.replace("edges AS", "all_edges AS")}, edges AS (
  SELECT * FROM all_edges
  WHERE link IN (SELECT 'https://shop.example/p/' || p_partkey FROM part WHERE p_size > 20)), {_levels(3)} {_crawl(3)}"""

_ORACLES["crawl_pages"] = f"""
WITH {_HREFS}, {_LINKS}, edges AS (
  SELECT regexp_replace(regexp_replace(url, '[?#;].*$', ''), '/+$', '') AS url,
         regexp_replace(regexp_replace(link, '[?#].*$', ''), '/+$', '') AS link, CAST(min(position) AS INT) AS position
  FROM links GROUP BY ALL),
roots AS (SELECT DISTINCT {_KEY} AS root FROM pages), {_levels(3)} {_crawl(3)}"""

_KINDS = "['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']"
_FOREST = f"""
site AS (
  SELECT lower(replace(p_brand, '#', '-')) AS place_id,
         'https://' || lower(replace(p_brand, '#', '-')) || '.example.com' AS root_url, lower(p_type) AS kind,
         list_position({_KINDS}, p_type) - 1 AS n, p_partkey AS k, p_name, p_size
  FROM part)"""

_ORACLES["read_site_trees"] = f"""
WITH {_FOREST}
SELECT DISTINCT place_id, root_url AS url, CAST(NULL AS VARCHAR) AS parent_url, 0 AS depth, root_url AS descriptor,
       '' AS items FROM site
UNION ALL
SELECT DISTINCT place_id, root_url || '/' || kind, root_url, 1, root_url || '/' || kind, '' FROM site
UNION ALL
SELECT place_id, root_url || '/' || kind || '/' || k, root_url || '/' || kind, 2, root_url || '/' || kind || '/' || k,
       p_name || '=' || kind || ',size ' || p_size FROM site"""

_ORACLES["write_site_trees"] = f"""
WITH {_FOREST}, nodes AS (
  SELECT DISTINCT place_id, '' AS path, CAST(NULL AS VARCHAR) AS parent_path, 0 AS depth, 0 AS position, root_url AS url,
         CAST(NULL AS VARCHAR) AS parent_url, '' AS book FROM site
  UNION ALL
  SELECT DISTINCT place_id, CAST(n AS VARCHAR), '', 1, CAST(n AS INT), root_url || '/' || kind, root_url, '' FROM site
  UNION ALL
  SELECT place_id, n || '/' || k, CAST(n AS VARCHAR), 2, CAST(k AS INT), root_url || '/' || kind || '/' || k,
         root_url || '/' || kind, p_name || '=' || kind || ',size ' || p_size FROM site)
SELECT place_id, path, parent_path, depth, position, url, parent_url, url AS descriptor,
       book AS scraped_items, book AS menu_book FROM nodes"""

_ORACLES["nest_site_trees"] = f"""
WITH {_FOREST}, nodes AS (
  SELECT DISTINCT place_id, '' AS u, -1 AS n, -1 AS k FROM site
  UNION ALL SELECT DISTINCT place_id, '/' || kind, n, -1 FROM site
  UNION ALL SELECT place_id, '/' || kind || '/' || k, n, k FROM site)
SELECT place_id, string_agg(u, ' ' ORDER BY n, k) AS urls FROM nodes GROUP BY place_id"""

_ORACLES["merge_site_trees"] = """
WITH new AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')
SELECT o_custkey AS place_id, o_orderkey AS node, o_totalprice, 'new' AS version FROM new
UNION ALL
SELECT o_custkey, o_orderkey, o_totalprice, 'old' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM new)"""

_ORACLES["subtree_rollup"] = f"""
WITH {_FOREST}, at_node AS (
  SELECT place_id, '' AS node_path, p_name, kind, p_size FROM site
  UNION ALL SELECT place_id, CAST(n AS VARCHAR), p_name, kind, p_size FROM site
  UNION ALL SELECT place_id, n || '/' || k, p_name, kind, p_size FROM site),
entries AS (
  SELECT place_id, node_path, p_name AS item, kind AS ingredient FROM at_node
  UNION SELECT place_id, node_path, p_name, 'size ' || p_size FROM at_node)
SELECT place_id, node_path, item, string_agg(ingredient, ',' ORDER BY ingredient) AS ingredients
FROM entries GROUP BY ALL"""

_ORACLES["reachable_nodes"] = f"""
WITH {_FOREST}
SELECT DISTINCT place_id, root_url AS url, 0 AS depth FROM site
UNION ALL SELECT DISTINCT place_id, root_url || '/' || kind, 1 FROM site WHERE kind <> 'promo'
UNION ALL SELECT place_id, root_url || '/' || kind || '/' || k, 2 FROM site WHERE kind <> 'promo'"""

_ORACLES["dedupe_visited_nodes"] = """
SELECT p_brand AS root, p_name AS url, CAST(p_size % 4 AS INT) AS depth, p_partkey FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size % 4, p_partkey) = 1"""

# ---- sources and sinks ----------------------------------------------------------------------------

_ORACLES["read_page_archive"] = "SELECT page_id, url, html FROM pages WHERE html IS NOT NULL"

_ORACLES["read_places"] = """
SELECT 'type' || ((c_custkey // 20) % 3) AS searched_type, CAST(c_custkey AS VARCHAR) AS place_id, c_name AS name,
       round(29.76 + (c_custkey % 41 - 20) * 0.01::DOUBLE, 6) AS lat,
       round(-95.37 + ((c_custkey * 7) % 43 - 21) * 0.01::DOUBLE, 6) AS lon,
       lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ',shop' ELSE ',store' END AS types
FROM customer WHERE (c_custkey // 20) % 7 <> 3"""

_PROFILE_ROWS = ", ".join(
    f"({_text(a)}, {_text(p.strip().lower()) if p else 'NULL'})"
    for a, phrases in PART_PROFILE.items()
    for p in (phrases or [None])
)
_PROFILE = f"profile(attribute, phrase) AS (VALUES {_PROFILE_ROWS})"

_ORACLES["load_profile"] = f"""
WITH {_PROFILE}, phrases AS (
  SELECT lower(p_name) AS phrase FROM part UNION ALL SELECT lower(p_type) FROM part
  UNION ALL SELECT lower(p_brand) FROM part),
counts AS (SELECT phrase, count(*) AS n FROM phrases GROUP BY phrase)
SELECT attribute, phrase, CASE WHEN attribute <> 'name' THEN 1.0::DOUBLE END AS weight, coalesce(n, 0) AS parts
FROM profile LEFT JOIN counts USING (phrase)"""

# ---- phrases and vectors --------------------------------------------------------------------------

_LINES = "lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"

_ORACLES["normalize_phrases"] = f"""
WITH {_LINES}
SELECT DISTINCT phrase FROM (SELECT {_strip("lower(unnest(l))")} AS phrase FROM lines) WHERE phrase <> ''"""


def _grams(tokens: str, n: int) -> str:
    return f"[array_to_string({tokens}[i : i + {n - 1}], ' ') for i in range(1, len({tokens}) - {n - 2})]"


_ORACLES["word_ngrams"] = f"""
WITH {_LINES}, tokenized AS (
  SELECT doc_id, list_filter(string_split_regex(lower(unnest(l)), '{_SPACE}+'), lambda x: x <> '') AS t,
         generate_subscripts(l, 1) AS line FROM lines),
grams AS (
  SELECT doc_id, line, list_concat({_grams("t", 1)}, {_grams("t", 2)}, {_grams("t", 3)}) AS g FROM tokenized),
whole AS (SELECT doc_id, flatten(list(g ORDER BY line)) AS g FROM grams GROUP BY doc_id)
SELECT doc_id, CAST(len(g) AS INT) AS n_grams, md5(array_to_string(g, '|')) AS grams_md5 FROM whole"""


def _vectors(source: str, name: str) -> str:
    """CTEs with the filled cells and the norm of each phrase of ``source(phrase)``."""
    return f"""
{name}_padded AS (SELECT DISTINCT phrase, ' ' || phrase || ' ' AS s FROM {source}),
{name}_at AS (SELECT phrase, s, unnest(range(1, length(s) - 1)) AS i FROM {name}_padded),
{name}_cells AS (
  SELECT phrase, (unicode(s[i]) * 961 + unicode(s[i + 1]) * 31 + unicode(s[i + 2])) % 256 AS cell,
         CAST(count(*) AS DOUBLE) AS c FROM {name}_at GROUP BY ALL),
{name}_norm AS (SELECT phrase, sqrt(sum(c * c)) AS norm FROM {name}_cells GROUP BY phrase)"""


_WORDS = f"""
words AS (
  SELECT DISTINCT lower(w) AS phrase
  FROM (SELECT unnest(string_split_regex(text, '{_SPACE}+')) AS w FROM documents) WHERE w <> '')"""

_ORACLES["embed_phrases"] = f"""
WITH {_WORDS}, {_vectors("words", "w")}
SELECT phrase, md5(array_to_string([coalesce(m[i], 0) for i in range(0, 256)], ' ')) AS cells_md5
FROM (SELECT phrase, map(list(cell), list(CAST(c AS INT))) AS m FROM w_cells GROUP BY phrase)"""

_ITEMS = """
items AS (
  SELECT p_partkey, p_name AS item,
         CASE p_size % 10 WHEN 0 THEN [] WHEN 1 THEN [''] ELSE [p_type, p_brand] END AS ingredients FROM part)"""

_ITEM_GRAMS = f"""
item_words AS (
  SELECT p_partkey, list_filter(string_split_regex(lower(unnest(ingredients)), '{_SPACE}+'), lambda x: x <> '') AS t
  FROM items),
item_grams AS (
  SELECT p_partkey, unnest(list_concat({_grams("t", 1)}, {_grams("t", 2)}, {_grams("t", 3)})) AS phrase FROM item_words)"""

_ORACLES["phrase_universe"] = f"""
WITH {_ITEMS}, {_ITEM_GRAMS}
SELECT lower(trim(item)) AS phrase FROM items UNION SELECT phrase FROM item_grams"""

_ORACLES["cosine_similarity"] = """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""

_MEANS = """
cells AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (
  SELECT label, list(v ORDER BY i) AS m FROM (SELECT label, i, avg(v) AS v FROM cells GROUP BY label, i) GROUP BY label)"""

_ORACLES["pairwise_similarity"] = f"""
WITH {_MEANS}
SELECT vec_id, string_agg(printf('%.4f', list_cosine_similarity(embedding::DOUBLE[], m)), ' ' ORDER BY means.label) AS scores
FROM embeddings, means GROUP BY vec_id"""

_ORACLES["pairwise_similarity_tiles"] = f"""
WITH numbered AS (SELECT vec_id AS right_id, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings)
SELECT vec_id, (n // {TILE_ROWS})::INT AS tile,
       string_agg(printf('%.4f', list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[])), ' ' ORDER BY n) AS scores
FROM embeddings, numbered GROUP BY vec_id, n // {TILE_ROWS}"""

_ORACLES["max_similarity"] = f"""
WITH {_MEANS}
SELECT vec_id, round(max(list_cosine_similarity(embedding::DOUBLE[], m)), 6) AS score
FROM embeddings, means GROUP BY vec_id"""


def _relevance(urls: str, parts: str = _PARTS) -> str:
    """CTEs ending in ``relevance(url, score)`` for ``variants(page_id, variant, url)``."""
    return f"""{urls}, {parts}, {_SEGMENTS}, {_KEYWORDS},
url_words AS (SELECT DISTINCT url, unnest(s) AS phrase FROM segments),
targets AS (SELECT keyword AS phrase FROM keywords),
vocabulary AS (SELECT DISTINCT phrase FROM url_words WHERE phrase <> ''),
{_vectors("vocabulary", "v")}, {_vectors("targets", "k")},
dots AS (
  SELECT a.phrase, b.phrase AS keyword, sum(a.c * b.c) AS dot
  FROM v_cells a JOIN k_cells b ON a.cell = b.cell GROUP BY ALL),
word_scores AS (
  SELECT d.phrase, max(dot / (x.norm * y.norm)) AS score
  FROM dots d JOIN v_norm x ON x.phrase = d.phrase JOIN k_norm y ON y.phrase = d.keyword GROUP BY d.phrase),
relevance AS (
  SELECT u.url, coalesce(max(w.score), 0.0) AS score
  FROM (SELECT DISTINCT url FROM segments) u LEFT JOIN url_words USING (url) LEFT JOIN word_scores w USING (phrase)
  GROUP BY u.url)"""


_ORACLES["url_relevance"] = f"WITH {_relevance(_VARIANTS)} SELECT url, round(score, 6) AS score FROM relevance"
_ORACLES["url_relevance_from_vectors"] = _ORACLES["url_relevance"]

_ORACLES["filter_relevant_urls"] = f"""
WITH {_HREFS}, {_LINKS}, raw AS (
  SELECT url FROM pages UNION SELECT link FROM links),
noted AS (
  SELECT regexp_replace(url, '#.*$', '') AS u FROM raw),
canon AS (
  SELECT DISTINCT lower(regexp_extract(u, '^([a-z]+://[^/?]*)', 1)) || regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1)
         || CASE WHEN {_canonical("regexp_extract(u, '[?](.*)$', 1)")} = '' THEN ''
                 ELSE '?' || {_canonical("regexp_extract(u, '[?](.*)$', 1)")} END AS url FROM noted),
{_relevance("variants AS (SELECT 0 AS page_id, 0 AS variant, url FROM canon)")}
SELECT url, round(score, 6) AS score FROM relevance WHERE score > 0.3"""


def _attribute_scores() -> str:
    """CTEs ending in ``scores(p_partkey, attribute, score)`` and ``names(p_partkey, score)``."""
    return f"""{_ITEMS}, {_ITEM_GRAMS}, {_PROFILE},
item_names AS (SELECT p_partkey, lower(trim(item)) AS phrase FROM items),
phrases AS (SELECT phrase FROM item_grams UNION SELECT phrase FROM item_names),
targets AS (SELECT DISTINCT phrase FROM profile WHERE phrase <> ''),
{_vectors("phrases", "v")}, {_vectors("targets", "k")},
dots AS (
  SELECT a.phrase, b.phrase AS target, sum(a.c * b.c) AS dot
  FROM v_cells a JOIN k_cells b ON a.cell = b.cell GROUP BY ALL),
cosines AS (
  SELECT d.phrase, p.attribute, max(dot / (x.norm * y.norm)) AS score
  FROM dots d JOIN v_norm x ON x.phrase = d.phrase JOIN k_norm y ON y.phrase = d.target
  JOIN profile p ON p.phrase = d.target GROUP BY ALL),
best AS (
  SELECT p_partkey, attribute, max(score) AS score FROM item_grams JOIN cosines USING (phrase) GROUP BY ALL),
scores AS (
  SELECT i.p_partkey, a.attribute, coalesce(b.score, 0.0) AS score
  FROM items i CROSS JOIN (SELECT DISTINCT attribute FROM profile) a LEFT JOIN best b USING (p_partkey, attribute)),
names AS (
  SELECT n.p_partkey, coalesce(max(c.score), 0.0) AS score
  FROM item_names n LEFT JOIN cosines c ON c.phrase = n.phrase AND c.attribute = 'name' GROUP BY n.p_partkey)"""


def _combined(name_weight: float) -> str:
    return f"""{_attribute_scores()},
weighted AS (
  SELECT p_partkey, sum(score) FILTER (attribute <> 'name') / 3 AS mean, max(score) AS top FROM scores GROUP BY p_partkey),
combined AS (
  SELECT i.p_partkey, i.item, i.ingredients, CASE WHEN len(i.ingredients) > 0 AND w.top = 0 THEN 0.0
           WHEN len(i.ingredients) > 0 THEN n.score * {name_weight}::DOUBLE + w.mean * (1 - {name_weight}::DOUBLE)
           ELSE n.score END AS combined
  FROM items i JOIN weighted w USING (p_partkey) JOIN names n USING (p_partkey))"""


_ORACLES["attribute_similarity"] = f"""
WITH {_attribute_scores()} SELECT p_partkey, attribute, round(score, 6) AS score FROM scores"""
_ORACLES["attribute_similarity_from_vectors"] = _ORACLES["attribute_similarity"]

_ORACLES["name_similarity"] = f"""
WITH {_attribute_scores()} SELECT p_partkey, round(score, 6) AS name_score FROM names"""

_LARGE = _attribute_scores().replace(
    _ITEMS, "items AS (SELECT s_suppkey AS p_partkey, lower(s_name) AS item, ['promo', lower(s_name)] AS ingredients FROM supplier)"
).replace(_PROFILE, "profile AS (SELECT 'name' AS attribute, lower(p_name) AS phrase FROM part UNION SELECT 'kind', lower(p_type) FROM part)")
_ORACLES["match_items_large_profile"] = f"""
WITH {_LARGE}
SELECT n.p_partkey AS s_suppkey, round(n.score, 6) AS name_score, round(k.score, 6) AS kind_score, round(i.score, 6) AS name_on_ingredients
FROM names n JOIN scores k ON k.p_partkey = n.p_partkey AND k.attribute = 'kind' JOIN scores i ON i.p_partkey = n.p_partkey AND i.attribute = 'name'"""

_ORACLES["threshold_gate"] = f"""
WITH {_attribute_scores()}
SELECT p_partkey, any_value(len(ingredients)) > 0 AND count(*) FILTER (score >= 0.9) = 0 AS gated,
       CAST(count(*) FILTER (score >= 0.9) AS INT) AS passed
FROM scores JOIN items USING (p_partkey) GROUP BY p_partkey"""

_ORACLES["weighted_attribute_score"] = f"""
WITH {_attribute_scores()}
SELECT p_partkey, round(sum(score * CASE attribute WHEN 'name' THEN 0 WHEN 'ingredient_1' THEN 2 ELSE 1 END) / 4, 6)
         AS attribute_score
FROM scores GROUP BY p_partkey"""

_ORACLES["hybrid_score"] = f"""
WITH {_combined(0.7)} SELECT p_partkey, round(combined, 6) AS combined_score FROM combined"""

_PIVOT = ", ".join(
    f"round(max(score) FILTER (attribute = {_text(a)}), 6) AS score_{a}" for a in PART_PROFILE
)

_ORACLES["match_items"] = f"""
WITH {_combined(0.5)}, wide AS (SELECT p_partkey, {_PIVOT} FROM scores GROUP BY p_partkey)
SELECT p_partkey, item AS scraped_item, array_to_string(ingredients, ', ') AS ingredients,
       round(combined, 6) AS combined_score, {", ".join(f"score_{a}" for a in PART_PROFILE)}
FROM combined JOIN wide USING (p_partkey)"""

_ORACLES["write_ranked_results"] = f"""
WITH {_combined(0.5)}, wide AS (SELECT p_partkey, {_PIVOT} FROM scores GROUP BY p_partkey)
SELECT row_number() OVER (ORDER BY round(combined, 6) DESC, p_partkey) AS place,
       p_partkey, item AS scraped_item, array_to_string(ingredients, ', ') AS ingredients,
       round(combined, 6) AS combined_score, score_ingredient_1 AS ingredient_1
FROM combined JOIN wide USING (p_partkey)"""

# ---- caches ---------------------------------------------------------------------------------------

_ORACLES["cache_key"] = """
SELECT event_id, md5(event_type) AS single, md5(user_id || chr(31) || event_type) AS composite FROM events"""

_CACHE = f"""
rows AS (SELECT event_id, user_id || ':' || event_type AS key, value, ts FROM events),
late AS (SELECT * FROM rows WHERE ts >= TIMESTAMP '{CACHE_SPLIT}'),
cache AS (
  SELECT key, arg_max(value, (ts, event_id)) AS value FROM rows WHERE ts < TIMESTAMP '{CACHE_SPLIT}' GROUP BY key)"""

_ORACLES["cache_lookup"] = f"""
WITH {_CACHE} SELECT event_id, key, cache.value FROM late LEFT JOIN cache USING (key)"""

_ORACLES["cache_upsert"] = f"""
WITH {_CACHE} SELECT md5(key) AS key_hash, key, arg_max(value, (ts, event_id)) AS value FROM rows GROUP BY key"""
_ORACLES["cache_table_batches"] = _ORACLES["cache_upsert"]

_ORACLES["cache_overwrite_report"] = f"""
WITH {_CACHE}
SELECT key, count(*) - CASE WHEN any_value(cache.key) IS NULL THEN 1 ELSE 0 END AS overwrites
FROM late LEFT JOIN cache USING (key) GROUP BY key HAVING overwrites > 0"""

_ORACLES["cache_read_through"] = f"""
WITH {_CACHE}
SELECT DISTINCT key, coalesce(cache.value, length(key)::DOUBLE) AS value,
       CASE WHEN cache.key IS NULL THEN 'computed' ELSE 'cache' END AS source
FROM late LEFT JOIN cache USING (key)"""

_ORACLES["cache_hit_report"] = f"""
WITH {_CACHE}
SELECT split_part(key, ':', 2) AS namespace, CAST(count(cache.value) AS BIGINT) AS hits,
       CAST(count(*) - count(cache.value) AS BIGINT) AS misses, count(DISTINCT key) AS distinct_keys
FROM late LEFT JOIN cache USING (key) GROUP BY ALL"""

# ---- places and the whole run ---------------------------------------------------------------------

_NEAR = f"""
places AS (
  SELECT c_custkey, c_name, 29.76::DOUBLE + (c_custkey % 41 - 20) * 0.01::DOUBLE AS lat,
         -95.37::DOUBLE + ((c_custkey * 7) % 43 - 21) * 0.01::DOUBLE AS lon,
         [lower(c_mktsegment), CASE WHEN c_custkey % 2 = 0 THEN 'shop' ELSE 'store' END] AS types FROM customer),
measured AS (
  SELECT *, 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(lat - {CENTER[0]}::DOUBLE) / 2), 2)
           + cos(radians(lat)) * cos(radians({CENTER[0]}::DOUBLE)) * pow(sin(radians(lon - ({CENTER[1]})::DOUBLE) / 2), 2))) AS d
  FROM places)"""

_ORACLES["places_nearby"] = f"""
WITH {_NEAR}, found AS (
  SELECT c_custkey, d, types, unnest(['shop', 'building', 'store']) AS searched_type FROM measured WHERE d <= 12000)
SELECT CAST(c_custkey AS VARCHAR) AS place_id, searched_type, round(d, 2) AS distance_m
FROM found WHERE list_contains(types, searched_type)"""

_ORACLES["places_nearby_keyword"] = f"""
WITH {_NEAR}
SELECT CAST(c_custkey AS VARCHAR) AS place_id,
       CASE WHEN list_contains(types, 'building') THEN 'building' ELSE 'shop' END AS searched_type,
       round(d, 2) AS distance_m
FROM measured
WHERE d <= 20000 AND contains(lower(c_name), 'customer#0000000')
  AND (list_contains(types, 'building') OR list_contains(types, 'shop'))"""

_ORACLES["place_sites"] = f"""
SELECT c_custkey AS place_id,
       CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 4 THEN 'https://maps.example/?cid=' || c_custkey END AS google_url,
       CASE WHEN c_custkey % 7 <> 0 THEN {_SITE} END AS establishment_url
FROM customer"""

_ORACLES["rank_establishments"] = f"""
WITH RECURSIVE tree AS (
  SELECT s_suppkey AS root, s_suppkey AS k, 0 AS depth FROM supplier
  UNION ALL
  SELECT root, unnest([k * 3 + 1, k * 3 + 2]), depth + 1
  FROM tree WHERE depth < 3 AND k IN (SELECT p_partkey FROM part WHERE p_size <> 13)),
visited AS (SELECT DISTINCT root, k FROM tree),
entries AS (
  SELECT DISTINCT root, lower(p_name) AS item, unnest([lower(p_type), lower(p_brand)]) AS ingredient
  FROM visited JOIN part ON p_partkey = k WHERE p_size <> 13),
books AS (SELECT root, item, list(ingredient ORDER BY ingredient) AS ingredients FROM entries GROUP BY ALL),
items AS (SELECT row_number() OVER () AS p_partkey, root, item, ingredients FROM books),
{_combined(0.5).replace(_ITEMS + ",", "", 1).replace("i.item, i.ingredients", "i.root, i.item, i.ingredients")}
SELECT '''https://maps.example/?cid=' || root || '''' AS google_url,
       '''https://shop.example/menu/item-' || root || '/?utm=maps''' AS establishment_url,
       item AS scraped_item, array_to_string(ingredients, ', ') AS ingredients, round(combined, 6) AS combined_score
FROM combined"""

_GOES = "CASE WHEN {0} % 50 = 6 THEN {0} + 1 WHEN {0} % 50 = 7 THEN {0} - 1 WHEN {0} % 10 = 4 THEN {0} // 2 END"


def _redirected_levels(depth: int, children: str, admitted: str = "true") -> str:
    """Levels over page numbers; ``aim(k, f, expands)`` says where a request ends, ``children`` lists ``(position, link)`` of page f."""
    ctes = ["l0 AS (SELECT root, root AS k, NULL::BIGINT AS parent, 0 AS depth, 0 AS position, CAST([] AS BIGINT[]) AS path FROM roots)"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT root, k FROM l{i}" for i in range(d))
        ctes.append(f"""
l{d} AS (
  SELECT root, k, parent, {d} AS depth, position, path
  FROM (SELECT l.root, c.link AS k, a.f AS parent, c.position, list_append(l.path, c.position) AS path,
               row_number() OVER (PARTITION BY l.root, c.link ORDER BY list_append(l.path, c.position)) AS rn
        FROM l{d - 1} l JOIN aim a ON a.k = l.k AND a.expands, LATERAL (SELECT unnest({children}, recursive := true)) c)
  WHERE rn = 1 AND (root, k) NOT IN ({seen}))""")
    return ", ".join(ctes) + ", met AS (" + " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1)) + ")"


_RUN = f"""
page AS (SELECT p_partkey AS k, p_partkey % 7 <> 3 AS has_html, p_size <> 13 AS answered, p_name, p_type, p_brand FROM part),
aim AS (
  SELECT p.k, f.k AS f, f.has_html AS expands, f.answered FROM page p
  JOIN page f ON f.k = CASE WHEN {_GOES.format("p.k")} IN (SELECT k FROM page) THEN {_GOES.format("p.k")} WHEN NOT starts_with(p.k::VARCHAR, '9') THEN p.k END),
roots AS (SELECT s_suppkey AS root FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0),
{_redirected_levels(3, "[{'position': 0, 'link': a.f * 3 + 1}, {'position': 1, 'link': a.f * 3 + 2}]")},
nodes AS (SELECT m.*, a.f, coalesce(a.f, m.k) AS final, coalesce(a.answered, false) AS has_content FROM met m LEFT JOIN aim a ON a.k = m.k),
lost AS (SELECT DISTINCT n.root, n.path FROM nodes n JOIN nodes x ON x.root = n.root AND NOT x.has_content AND n.path[1:len(x.path)] = x.path),
read AS (SELECT * FROM nodes n WHERE NOT EXISTS (FROM lost x WHERE x.root = n.root AND x.path = n.path)
         QUALIFY row_number() OVER (PARTITION BY root, f ORDER BY depth, path) = 1),
own AS (
  SELECT r.root, r.path, lower(p_name) || CASE WHEN has_html AND p.k % 9 <> 2 THEN '' ELSE ' sheet' END AS item,
         CASE WHEN has_html AND p.k % 9 <> 2 THEN [lower(p_type), lower(p_brand)] ELSE [lower(p_brand)] END AS ingredients
  FROM read r JOIN page p ON p.k = r.f)"""

_ORACLES["run_establishments"] = f"""
WITH {_RUN},
entries AS (SELECT DISTINCT root, item, unnest(ingredients) AS ingredient FROM own),
books AS (SELECT root, item, list(ingredient ORDER BY ingredient) AS ingredients FROM entries GROUP BY ALL),
items AS (SELECT row_number() OVER () AS p_partkey, root, item, ingredients FROM books),
{_combined(0.5).replace(_ITEMS + ",", "", 1).replace("i.item, i.ingredients", "i.root, i.item, i.ingredients")}
SELECT '''https://maps.example/?cid=' || root || '''' AS google_url,
       '''https://shop.example/menu/item-' || root || '?utm=maps''' AS establishment_url,
       item AS scraped_item, array_to_string(ingredients, ', ') AS ingredients, round(combined, 6) AS combined_score
FROM combined"""

_ORACLES["run_forest"] = f"""
WITH {_RUN},
counted AS (SELECT root, path, count(DISTINCT item) AS n FROM own GROUP BY ALL),
below AS (SELECT n.root, n.path, count(DISTINCT o.item) AS n FROM nodes n JOIN own o ON o.root = n.root AND o.path[1:len(n.path)] = n.path GROUP BY ALL)
SELECT n.root::VARCHAR AS place_id, array_to_string(n.path, '/') AS path, n.depth, 'https://shop.example/menu/item-' || n.final AS url,
       coalesce(c.n, 0)::INT AS n_items, coalesce(b.n, 0)::INT AS n_book
FROM nodes n LEFT JOIN counted c ON c.root = n.root AND c.path = n.path LEFT JOIN below b ON b.root = n.root AND b.path = n.path"""

_ORACLES["crawl_redirected"] = f"""
WITH roots AS (SELECT p_partkey AS root FROM part),
aim AS (SELECT p_partkey AS k, coalesce({_GOES.format("p_partkey")}, p_partkey) AS f, p_partkey % 7 <> 3 AS expands FROM part),
has_links AS (SELECT p_partkey AS k FROM part),
{_redirected_levels(3, "CASE WHEN a.f IN (SELECT k FROM has_links) THEN [{'position': 0, 'link': a.f * 3 + 1}, {'position': 1, 'link': a.f * 3 + 2}, {'position': 2, 'link': a.f * 3 + 3}, {'position': 3, 'link': a.f // 2}] ELSE [] END")},
first AS (SELECT m.*, coalesce(a.f, m.k) AS f FROM met m LEFT JOIN aim a ON a.k = m.k
          QUALIFY row_number() OVER (PARTITION BY root, coalesce(a.f, m.k) ORDER BY depth, path) = 1)
SELECT 'https://shop.example/p/' || root AS root, 'https://shop.example/p/' || k AS url, 'https://shop.example/p/' || parent AS parent_url, depth, position,
       'https://shop.example/p/' || f AS final_url
FROM first"""

# ---- streams --------------------------------------------------------------------------------------

_ORACLES["stream_visited_dedup"] = "SELECT DISTINCT user_id FROM events"

_ORACLES["stream_visited_by_crawl"] = """
WITH numbered AS (
  SELECT user_id, event_type, ts, count_if(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts) AS ended FROM events)
SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS admitted_at
FROM numbered WHERE event_type <> 'purchase' GROUP BY user_id, event_type, ended"""

_ORACLES["stream_cache_upsert"] = """
SELECT md5(CAST(user_id AS VARCHAR)) AS key_hash, CAST(user_id AS VARCHAR) AS key,
       arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id"""

