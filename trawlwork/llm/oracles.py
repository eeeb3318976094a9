"""DuckDB SQL with the same rows as the registered query of the same name."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: A-Z only; SQL's lower() would change other letters too.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _jump(shards: int) -> str:
    return f"""
jump{shards}(doc_id, key, b, j) AS (
  SELECT doc_id, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END), -1::BIGINT, 0::BIGINT
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, next, j, floor((j + 1) * (2147483648.0::DOUBLE / (next // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, j, (((key // 4294967296) * 2862933555777941757 % 4294967296) * 4294967296
                           + (key % 4294967296) * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jump{shards} WHERE j < {shards})
)"""


_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::UINTEGER], [x::UINTEGER FOR x IN range(8)]),
                          lambda c, x: (CASE WHEN c & 1 = 1 THEN xor(3988292384::UINTEGER, c >> 1) ELSE c >> 1 END)) AS c
    FROM range(256) r(i))
)"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text, with ``crc_table`` in the FROM clause."""
    return f"""xor(4294967295::UINTEGER, list_reduce(list_concat([4294967295::UINTEGER], list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UINTEGER)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INTEGER + 1])))::BIGINT"""


def _longer(value: str, cost: str, letters: str) -> str:
    """A path's cost and audit with one edit more; null stays null."""
    return f"CASE WHEN {value} IS NOT NULL THEN {{'c': {value}.c + {cost}, 'a': {value}.a || '{letters}'}} END"


def _least(*values: str) -> str:
    return f"list_min(list_filter([{', '.join(values)}], lambda v: v IS NOT NULL))"


#: The states of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. ``b*``: an insertion may come before the row.
_REPAIR_STEP = f"""
  SELECT k, i, {_least("b0d")} AS s0,
         {_least("b1d", f"CASE WHEN NOT must AND initial = 's' THEN {_longer('b0', 'fault', 'K')} END")} AS s1,
         {_least("b2d", *(f"CASE WHEN NOT must AND initial = 'u' THEN {_longer(b, 'fault', 'K')} END" for b in ("b0", "b1", "b3")),
                 *(f"CASE WHEN NOT must THEN {_longer(b, '1 + fault', 'R')} END" for b in ("b0", "b1", "b3")))} AS s2,
         {_least("b3d", f"CASE WHEN NOT must AND initial = 'a' THEN {_longer('b2', 'fault', 'K')} END", f"CASE WHEN NOT must THEN {_longer('b2', '1 + fault', 'R')} END")} AS s3
  FROM (SELECT *, {", ".join(f"{_longer(b, '2', 'D')} AS {b}d" for b in ("b0", "b1", "b2", "b3"))} FROM (
    SELECT r.k, r.i, r.initial, r.must, r.fault, p.s0 AS b0, p.s1 AS b1,
           {_least("p.s2", _longer("p.s0", "5", "I"), _longer("p.s1", "5", "I"), _longer("p.s3", "5", "I"))} AS b2,
           {_least("p.s3", _longer("p.s2", "5", "I"))} AS b3
    FROM paths p JOIN coded r ON r.k = p.k AND r.i = p.i + 1))
"""

SQL: dict[str, str] = {
    "op1_jump_sharding": f"""
WITH RECURSIVE {_CRC_TABLE},
{_jump(16)},
{_jump(17)},
digest AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         {_crc32("coalesce(text, '')")} AS text_crc32
  FROM documents, crc_table
),
placed AS (
  SELECT d.*, 'key' AS law, a.b::INTEGER AS shard, c.b::INTEGER AS grown_shard, (coalesce(d.doc_id, 0) % 1024 + d.text_crc32) % 1024 AS bucket
  FROM digest d JOIN jump16 a ON a.doc_id IS NOT DISTINCT FROM d.doc_id AND a.j >= 16 JOIN jump17 c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.j >= 17
)
SELECT doc_id, size, text_crc32, law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY (bucket + 1024) % 1024, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM placed
""",
    "op9_benchmark_decontamination": f"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL
  SELECT 'b', item_id, {_WORDS.format(_LOWER.format("text"))} FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
),
lengths AS (SELECT 5 AS n UNION SELECT len(w) FROM w WHERE kind = 'b' AND len(w) BETWEEN 1 AND 4),
s AS (
  SELECT DISTINCT kind, id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS s
  FROM w, lengths WHERE kind = 'd' OR n = least(len(w), 5)
),
n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 'b' GROUP BY 1)
SELECT d.id AS doc_id, n.item_id, n.n_shingles, count(*) AS n_found, count(*) / n.n_shingles AS containment
FROM s d JOIN s b ON d.s = b.s AND d.n = b.n AND d.kind = 'd' AND b.kind = 'b' JOIN n ON n.item_id = b.id
GROUP BY 1, 2, 3 HAVING count(*) * 100 >= 80 * n.n_shingles
""",
    "op12_conversation_repair": f"""
WITH RECURSIVE {_CRC_TABLE},
named AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
),
damage AS (SELECT named.*, {_crc32("name")} % 20 AS d FROM named, crc_table),
damaged AS (
  SELECT k, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM damage WHERE d <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again FROM placed),
faults AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS ended, role[1:1] AS initial FROM seen
),
coded AS (
  SELECT k, i, role, text, turn, initial, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND ended AS truncated,
         blank OR again AS must, CASE WHEN ended AND NOT blank AND NOT again THEN 5 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY k ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM faults
),
paths AS (
  SELECT DISTINCT k, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR) AS s1, NULL::STRUCT(c INTEGER, a VARCHAR) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR) AS s3 FROM named
  UNION ALL {_REPAIR_STEP}
),
summary AS (
  SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
         count_if(illegal) AS illegal, count(*) AS n
  FROM coded GROUP BY k
),
best AS (
  SELECT p.k, {_least("s0", _longer("s1", "10", "II"), _longer("s2", "5", "I"), "s3")} AS b
  FROM paths p LEFT JOIN summary s ON s.k = p.k WHERE p.i = coalesce(s.n, 0)
),
letters AS (
  SELECT k, l, j, count_if(l <> 'I') OVER w AS i, count_if(l <> 'D') OVER w AS place, count_if(l <> 'D') OVER (PARTITION BY k) % 2 AS lead
  FROM (SELECT k, unnest(string_split(b.a, '')) AS l, unnest(range(1, length(b.a) + 1)) AS j FROM best WHERE b.a <> '')
  WINDOW w AS (PARTITION BY k ORDER BY j)
),
repaired AS (
  SELECT e.k, string_agg(CASE WHEN l = 'K' THEN c.role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE c.text END, chr(10) ORDER BY j) AS text
  FROM letters e LEFT JOIN coded c ON c.k = e.k AND c.i = e.i WHERE l <> 'D' GROUP BY e.k
)
SELECT n.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
       coalesce(s.illegal, 0)::BIGINT AS illegal, b.b.c::BIGINT AS cost, b.b.a AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM named) n JOIN best b ON b.k = n.k LEFT JOIN summary s ON s.k = n.k LEFT JOIN repaired r ON r.k = n.k
""",
    # The given pages mark their articles; the model, which knows of no mark, has to find the same text.
    "op13_html_main_text": r"""
WITH marked AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|\z)', 1, 's') AS body FROM pages),
pieces AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(body, '<[^>]*\z', ''), '</?(?:p|div|h[1-6]|ul|ol|li)(?:\s[^>]*)?>') AS p FROM marked),
blocks AS (
  SELECT page_id, url, list_filter([trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
           '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '\s+', ' ', 'g')) FOR x IN p], lambda b: b <> '') AS b
  FROM pieces
),
texts AS (SELECT page_id, url, regexp_replace(array_to_string(b, chr(10) || chr(10)), '&amp;?', '&', 'g') AS text FROM blocks)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
""",
}
