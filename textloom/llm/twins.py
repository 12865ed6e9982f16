"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def url_filter(rules: Sequence[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {values}),
urls AS (
  SELECT row_number() OVER () AS r, page_id,
         coalesce({_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM urls JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (r)
"""


def _located(kinds: Sequence[tuple[str, str]], table: str = "documents") -> str:
    """CTEs: texts(r, doc_id, t) and placed(r, t, rank, kind, start, stop, found)."""
    values = ", ".join(f"({i}, '{kind}', '{pattern.replace(chr(39), chr(39) * 2)}')" for i, (kind, pattern) in enumerate(kinds))
    return f"""
kinds(rank, kind, pattern) AS (VALUES {values}),
texts AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS t FROM {table}),
cut AS (
  SELECT r, t, rank, kind, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS g
  FROM texts, kinds),
listed AS (
  SELECT r, t, rank, kind, m, list_transform(m, lambda x: length(x)) AS ml, list_transform(g, lambda x: length(x)) AS gl,
         unnest(range(1, len(m) + 1)) AS i
  FROM cut WHERE len(m) > 0),
begun AS (
  SELECT r, t, rank, kind, m[i] AS found,
         CAST(list_sum(gl[1:i]) + coalesce(list_sum(ml[1:i - 1]), 0) AS BIGINT) AS start
  FROM listed),
placed AS (SELECT *, start + length(found) AS stop FROM begun)"""


_OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
_CHARS = "list_transform(range(1, length({0}) + 1), lambda i: {0}[i])"
# One digit more for each character of the number's letters-as-numbers form.
_MOD97 = """list_reduce(list_prepend(0, list_transform(
      range(1, length(bare) + 1),
      lambda i: CASE WHEN (bare[5:] || bare[1:4])[i] BETWEEN '0' AND '9' THEN ord((bare[5:] || bare[1:4])[i]) - 48
                     ELSE ord((bare[5:] || bare[1:4])[i]) - 55 END)),
    lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""

PII = f"""
WITH {_located([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
])},
seen AS (
  SELECT *, regexp_replace(found, '[^0-9]', '', 'g') AS digits, replace(found, ' ', '') AS bare,
         t[greatest(start - 40, 0) + 1:start] AS before,
         regexp_matches(CASE WHEN start > 0 THEN t[start] ELSE '' END || t[stop + 1], '[A-Za-z0-9]') AS stuck
  FROM placed),
spans AS (
  SELECT r, rank, kind, start, stop FROM seen WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_matches(found, '{_OCTETS}')
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(
      range(1, length(digits) + 1),
      lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INT)
                     WHEN CAST(reverse(digits)[i] AS INT) > 4 THEN CAST(reverse(digits)[i] AS INT) * 2 - 9
                     ELSE CAST(reverse(digits)[i] AS INT) * 2 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    WHEN 'iban' THEN NOT stuck AND length(bare) BETWEEN 15 AND 34 AND {_MOD97}
    ELSE NOT stuck AND NOT regexp_matches(found, '^(000|666|9)|-00-|-0000')
      AND regexp_matches(before, '(^|[^A-Za-z])([sS][sS][nN]|[sS][oO][cC][iI][aA][lL] [sS][eE][cC][uU][rR][iI][tT][yY])')
    END),
joined AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (rank < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (r)
"""

_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
)
_ASSIGN_SQL = _ASSIGN.replace("'", "''")


def secret_spans(table: str = "documents") -> str:
    """CTEs up to live(r, rank, kind, start, stop, live): every span, and whether its value stays with few owners."""
    return f"""{_located([
    ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+"),
    ("access", "AKIA[A-Z0-9]{16,}"),
    ("hex", "[0-9a-f]{24,}"),
    ("bearer", r"[bB]earer\x20[A-Za-z0-9._~+/-]{20,}"),
    ("issued", "gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("signed", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
], table)},
valued AS (
  SELECT r, rank, kind, start, stop, sha256(CASE kind
           WHEN 'assign' THEN regexp_extract(found, '{_ASSIGN_SQL}([A-Za-z0-9+/_.=-]+)$', 2)
           WHEN 'bearer' THEN found[8:] ELSE found END) AS digest
  FROM placed
  WHERE kind <> 'assign' OR length(regexp_extract(found, '{_ASSIGN_SQL}([A-Za-z0-9+/_.=-]+)$', 2)) >= 6),
owned AS (
  SELECT digest, count(DISTINCT coalesce(source, chr(0))) AS owners FROM valued JOIN texts USING (r) GROUP BY digest),
live AS (SELECT r, rank, kind, start, stop, owners <= 3 AS live FROM valued JOIN owned USING (digest))"""


SECRETS = f"""
WITH {secret_spans()},
joined AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (live) AS live_spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM live GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(live_spans, '') AS live_spans
FROM texts LEFT JOIN joined USING (r)
"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
known AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
         unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: w[i:i + least(len(w), 10) - 1])) AS gram
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM known),
places AS (
  SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM texts, sizes WHERE len(w) >= size),
hits AS (
  SELECT r, item, i, p.size FROM places p JOIN known k ON p.size = k.size AND array_to_string(w[i:i + p.size - 1], ' ') = array_to_string(gram, ' ')),
covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


# Fixed value: the reversed polynomial of CRC-32.
_CRC = """crc_steps AS (
  SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)),
                          lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS steps
  FROM range(256) AS bytes(b))"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, beside the one row of ``crc_steps``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ord(({text})[i])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR END"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
# Each level of the groups' trees and of the tree over their roots is a step of a recursion.
MERKLE = f"""
WITH RECURSIVE {_CRC},
leaves AS (
  SELECT coalesce('=' || source, '') AS grp, doc_id, sha256({_LEAF} || {_field('text')}) AS leaf,
         sha256({_LEAF} || CASE WHEN doc_id IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0
                           THEN {_field("replace(text, chr(10), '')")} ELSE {_field('text')} END) AS copy
  FROM documents, crc_steps),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY grp) AS n
  FROM leaves),
trees(grp, level, place, n, digest) AS (
  SELECT grp, 0, place, n, leaf FROM numbered
  UNION ALL
  SELECT grp, any_value(level) + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY place))
  FROM trees WHERE n > 1 GROUP BY grp, place // 3),
roots AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n
  FROM trees WHERE n = 1),
last(level, place, n, digest) AS (
  SELECT 0, place, n, subroot FROM roots
  UNION ALL
  SELECT any_value(level) + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY place))
  FROM last WHERE n > 1 GROUP BY place // 3),
way(own, grp, level, place, n, over) AS (
  SELECT place, grp, 0, place, n, false FROM numbered
  UNION ALL
  SELECT own, w.grp, CASE WHEN w.n > 1 THEN level + 1 ELSE 0 END,
         CASE WHEN w.n > 1 THEN w.place // 3 ELSE r.place END, CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE r.n END, over OR w.n = 1
  FROM way w JOIN roots r USING (grp) WHERE w.n > 1 OR NOT over),
stations AS (
  SELECT w.*, CASE WHEN over THEN 1000 ELSE 0 END + level AS station FROM way w WHERE n > 1),
steps_of AS (
  SELECT s.grp, s.own, s.station,
         coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place < s.place), '') AS before,
         coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place > s.place), '') AS after
  FROM stations s
  JOIN (SELECT grp, 0 AS base, level, place, digest FROM trees UNION ALL SELECT NULL, 1000, level, place, digest FROM last) t
    ON t.base + t.level = s.station AND t.place // 3 = s.place // 3 AND (t.base = 1000 OR t.grp = s.grp)
  GROUP BY ALL),
proofs AS (
  SELECT grp, own, list(before ORDER BY station) AS b, list(after ORDER BY station) AS a,
         string_agg(before || after, '' ORDER BY station) AS siblings
  FROM steps_of GROUP BY ALL)
SELECT n.doc_id, n.leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
       coalesce(list_reduce(list_prepend(n.copy, list_zip(b, a).list_transform(lambda z: z[1] || ' ' || z[2])),
                            lambda d, z: sha256(split_part(z, ' ', 1) || d || split_part(z, ' ', 2))), n.copy) AS folded_root,
       coalesce(list_reduce(list_prepend(n.copy, list_zip(b, a).list_transform(lambda z: z[1] || ' ' || z[2])),
                            lambda d, z: sha256(split_part(z, ' ', 1) || d || split_part(z, ' ', 2))), n.copy) = root AS verified
FROM numbered n JOIN roots USING (grp) CROSS JOIN (SELECT digest AS root FROM last WHERE n = 1)
LEFT JOIN proofs p ON p.grp = n.grp AND p.own = n.place
"""

PREFIX_TRIE = f"""
WITH {_CRC},
named AS (
  SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM named),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_steps),
rebuilt AS (
  SELECT c.conv_id, pos, id, words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, pos, id, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
rows_of AS (
  SELECT conv_id, coalesce(list(id ORDER BY pos) FILTER (id IS NOT NULL), []) AS ids, list(words ORDER BY pos) FILTER (id IS NOT NULL) AS words
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
starts AS (SELECT *, unnest(range(0, len(ids) + 1)) AS depth FROM rows_of),
nodes AS (
  SELECT depth, CASE WHEN depth > 0 THEN array_to_string(ids[1:depth], '') ELSE '' END AS key, min(conv_id) AS conv_id,
         count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ids) = depth), '')) AS ends_sha256
  FROM starts GROUP BY ALL),
family AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children
  FROM nodes n
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = left(n.key, 64 * (n.depth - 1))
  LEFT JOIN (SELECT depth - 1 AS depth, left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) c
    ON c.depth = n.depth AND c.key = n.key),
upward AS (
  SELECT unnest(range(0, depth + 1)) AS above, key, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * words AS saved FROM family),
subtrees AS (
  SELECT above AS depth, left(key, 64 * above) AS key, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM upward GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM family JOIN subtrees USING (depth, key)
"""
