"""DuckDB SQL of the training-text queries that SQL can express."""

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {UPPER}),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[s:s + 12] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s
        FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (
  SELECT r, p, n, w[p:p + n - 1] AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT r, p, n, item_id FROM places JOIN windows USING (g)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit
            FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
          FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

URLS = rf"""
WITH rest AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://')
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages),
parts AS (
  SELECT r, page_id, translate(regexp_extract(s, '^([^/?#]*)', 1), {UPPER}) AS host,
         regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules (rule_host, rule_path, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT parts.*, rule_host || rule_path AS rule, verdict FROM parts LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (
  SELECT r, page_id, host, path, arg_max(rule, length(rule)) AS rule,
         arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY r, page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN
  regexp_matches(host || path, '^([^/]*[.\-])?(cheap|discount|buy)-pills[.\-/]')
  OR regexp_matches(host || path, '^([^/]*[.\-])?(spam|link)-farm[.\-/]')
  OR regexp_matches(host || path, '^([^/]*[.\-])?free-bets[.\-/]')
  OR regexp_matches(host || path, '^([^/]*[.\-])?casino[.\-/]')
  OR regexp_matches(host || path, '^([^/]*[.\-])?(xxx|porn)[.\-/]')
  THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""
_HEAD = "'<|' || replace(coalesce({0}.role, 'unknown'), '<|', '< |') || '|>' || chr(10)"
_BODY = "replace(coalesce({0}.text, ''), '<|', '< |') || '<|end|>' || chr(10)"


def _render(turns: str) -> str:
    return (f"coalesce(array_to_string(list_transform({turns}, lambda x: "
            f"{_HEAD.format('x')} || {_BODY.format('x')}), ''), '')")


def _ranges(turns: str) -> str:
    before = (f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda x: "
              f"length({_HEAD.format('x')} || {_BODY.format('x')}))), 0)::BIGINT")
    own = f"{turns}[i]"
    begin = f"({before} + length({_HEAD.format(own)}))"
    return (f"coalesce(array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), "
            f"lambda i: {turns}[i].role = 'assistant'), lambda i: {begin}::VARCHAR || '-' || "
            f"({begin} + length({_BODY.format(own)}))::VARCHAR), ','), '')")


PREFERENCES = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST,
                               text NULLS FIRST) AS c FROM turns GROUP BY conv_id),
known AS (SELECT conv_id, c, coalesce(list_max(list_filter(range(1, len(c) + 1),
                 lambda i: c[i].role = 'assistant')), 0) AS l FROM lists),
pairs AS (
  SELECT k.conv_id, k.c, CASE WHEN k.l = 0 THEN k.c ELSE list_concat(k.c[1:k.l - 1],
         [{{'role': 'assistant', 'text': coalesce(o.c[o.l].text, '')}}]) END AS r
  FROM known k LEFT JOIN known o ON o.conv_id = xor(k.conv_id, 1) AND o.l > 0),
split AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1),
                     lambda i: c[i] IS DISTINCT FROM r[i])), least(len(c), len(r)) + 1) - 1 AS n FROM pairs),
parts AS (SELECT conv_id, n, c[1:n] AS p, c[n + 1:] AS cc, r[n + 1:] AS rr FROM split)
SELECT conv_id, n::INTEGER AS prompt_turns, {_render('p')} AS prompt, {_render('cc')} AS chosen,
       {_ranges('cc')} AS chosen_ranges, {_render('rr')} AS rejected, {_ranges('rr')} AS rejected_ranges
FROM parts
"""


def _similar(width: int, percent: int, kept: str = "") -> str:
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, w[p:p + {width - 1}] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes i ON i.doc_id = x JOIN sizes j ON j.doc_id = y
  WHERE 100 * shared.n >= {percent} * (i.n + j.n - shared.n)),
reach (x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id{kept}
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON x = d.doc_id
"""


NEAR_DUPLICATES = _similar(5, 85, ",\n       d.doc_id <= coalesce(y, d.doc_id) AS kept")
NGRAM_JOIN = _similar(3, 90)

# CRC-32 of the digits of an id, bit by bit.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), "
        "lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], "
        "lambda x, o: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
         coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
plan AS (SELECT conv_id, l, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM turns),
seqs AS (SELECT p.conv_id, list_concat(coalesce(b.l, [])[1:p.h], p.l[p.h + 1:]) AS s
         FROM plan p LEFT JOIN turns b ON b.conv_id = p.base),
rows AS (SELECT conv_id, d, s[1:d] AS prefix, len(s) AS n
         FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT d, prefix, min(conv_id) AS c, count(*) AS n_convs,
         coalesce(octet_length(encode(prefix[d].text)), 0) AS bytes,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends
  FROM rows GROUP BY d, prefix),
owners AS (SELECT rows.conv_id, rows.d, c FROM rows JOIN nodes USING (d, prefix)),
kids AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, prefix)),
below AS (
  SELECT o.c, o.d, sum((u.n_children = 0)::BIGINT) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved
  FROM full_nodes u JOIN owners o ON o.conv_id = u.c AND o.d <= u.d GROUP BY ALL)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_nodes n JOIN below ON below.c = n.c AND below.d = n.d
LEFT JOIN owners p ON p.conv_id = n.c AND p.d = n.d - 1
"""
