"""DuckDB statements for the operators' queries that SQL can express."""

from __future__ import annotations

URL_VERDICTS = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, row_number() OVER () AS row_id,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT row_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM hosts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM hosts LEFT JOIN best USING (row_id)
"""

# The escape sign is doubled, every control string gets one; a turn is "### role\\n", its text and "</turn>\\n".
ESCAPED = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '###', chr(92) || '###'), '</turn>', chr(92) || '</turn>')"

CONVERSATIONS = f"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
marked AS (SELECT *, row_number() OVER () AS lone, '### ' || replace({ESCAPED.format('role')}, chr(10), chr(92) || chr(10)) || chr(10) || {ESCAPED.format('text')} || '</turn>' || chr(10) AS f FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(f)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN lone END
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT item_id, least(13, len(w)) AS n, unnest([w[i:i + least(13, len(w)) - 1] for i in range(1, len(w) - least(13, len(w)) + 2)]) AS ws
  FROM b WHERE len(w) > 0),
firsts AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS f FROM d),
occ AS (
  SELECT DISTINCT firsts.r, i, n, item_id FROM firsts JOIN win ON f = ws[1] JOIN d ON firsts.r = d.r WHERE w[i:i + n - 1] = ws),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM occ GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

SUBSTRINGS = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest([md5(array_to_string(w[i:i + 12], ' ')) for i in range(1, len(w) - 11)]) AS g
  FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
least_id AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN least_id USING (g) WHERE m < doc_id),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS t, count(*) AS i FROM one AS a JOIN one AS b
  ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n GROUP BY 1, 2, 3),
links AS (SELECT a, b FROM common WHERE 100 * i >= 80 * (t - i) UNION ALL SELECT b, a FROM common WHERE 100 * i >= 80 * (t - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum([x[1] * x[2] for x in list_zip(q.e, v.e)]) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

# A field is its bytes counted, or a sign for null; crc32 goes bit by bit.
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  [CAST((ascii(substr(CAST({0} AS VARCHAR), 1 + k // 8, 1)) >> CAST(k % 8 AS INT)) & 1 AS BIGINT) for k in range(8 * length(CAST({0} AS VARCHAR)))]),
  lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_PARENTS = "[sha256(array_to_string(nodes[8 * i + 1:8 * i + 8], '')) for i in range((len(nodes) + 7) // 8)]"

MANIFEST = f"""
WITH RECURSIVE plain AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF.format('text')} AS leaf,
         CASE WHEN {CRC32.format('doc_id')} % 3 = 0
              THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents),
d AS (
  SELECT r, doc_id, lang, leaf, coalesce(changed, leaf) AS claim,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM plain),
lower_trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM d GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_PARENTS} FROM lower_trees WHERE len(nodes) > 1),
subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM lower_trees WHERE len(nodes) = 1),
upper_tree AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_PARENTS} FROM upper_tree WHERE len(nodes) > 1),
nodes AS (
  SELECT false AS top, lang, level, nodes FROM lower_trees WHERE len(nodes) > 1
  UNION ALL SELECT true, subroots.lang, level, nodes FROM upper_tree CROSS JOIN subroots WHERE len(nodes) > 1),
walk AS (
  SELECT r, lang, false AS top, 0 AS level, pos, claim, '' AS beside FROM d
  UNION ALL
  SELECT walk.r, walk.lang, walk.top OR nodes IS NULL, CASE WHEN nodes IS NULL THEN 0 ELSE walk.level + 1 END,
         CASE WHEN nodes IS NULL THEN subroots.pos ELSE walk.pos // 8 END,
         CASE WHEN nodes IS NULL THEN claim ELSE sha256(array_to_string(nodes[walk.pos // 8 * 8 + 1:walk.pos], '') || claim
              || array_to_string(nodes[walk.pos + 2:walk.pos // 8 * 8 + 8], '')) END,
         CASE WHEN nodes IS NULL THEN beside ELSE beside || array_to_string(nodes[walk.pos // 8 * 8 + 1:walk.pos], '')
              || array_to_string(nodes[walk.pos + 2:walk.pos // 8 * 8 + 8], '') END
  FROM walk JOIN subroots ON walk.lang IS NOT DISTINCT FROM subroots.lang
  LEFT JOIN nodes ON nodes.lang IS NOT DISTINCT FROM walk.lang AND nodes.top = walk.top AND nodes.level = walk.level
  WHERE nodes IS NOT NULL OR NOT walk.top),
ends AS (SELECT r, arg_max(claim, (top, level)) AS folded_root, arg_max(beside, (top, level)) AS beside FROM walk GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN subroots ON d.lang IS NOT DISTINCT FROM subroots.lang JOIN ends USING (r)
CROSS JOIN (SELECT nodes[1] AS root FROM upper_tree WHERE len(nodes) = 1)
"""

TRIE = f"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, list({{'k': md5(strlen(role) || ':' || role || text), 'b': strlen(text)}}
                 ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS ts, {CRC32.format('c')} % 9 AS h FROM turns GROUP BY c),
built AS (
  SELECT a.c, coalesce(b.ts[1:a.h], []) || a.ts[a.h + 1:] AS ts FROM convs AS a LEFT JOIN convs AS b ON b.c = a.c - a.c % 5),
chains AS (
  SELECT c, ts, unnest(range(len(ts) + 1)) AS depth FROM built),
at_node AS (
  SELECT c, depth, len(ts) AS n, array_to_string([x['k'] for x in ts[1:depth]], '') AS node,
         array_to_string([x['k'] for x in ts[1:depth - 1]], '') AS parent, CASE WHEN depth > 0 THEN ts[depth]['b'] ELSE 0 END AS b FROM chains),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256
  FROM at_node GROUP BY node, depth),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
under AS (
  SELECT substr(x.node, 1, 32 * unnest(range(x.depth + 1))) AS node, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, (x.n_convs - 1) * x.b AS saved
  FROM nodes AS x LEFT JOIN kids USING (node)),
sums AS (SELECT node, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM under GROUP BY node)
SELECT nodes.conv_id, nodes.depth, p.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN kids USING (node)
LEFT JOIN nodes AS p ON nodes.depth > 0 AND p.node = nodes.parent
"""

ORACLES: dict[str, str] = {
    "op2_chat_format": CONVERSATIONS,
    "op3_decontamination": CONTAMINATION,
    "op5_url_filter": URL_VERDICTS,
    "op6_substring_dedup": SUBSTRINGS,
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op9_top_k_search": TOP_K,
    "op12_merkle_manifest": MANIFEST,
    "op13_prefix_trie": TRIE,
}
