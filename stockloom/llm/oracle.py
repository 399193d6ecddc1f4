"""SQL counterparts (DuckDB) of the operators on similarity classes and conversations."""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, byte by byte and bit by bit."""
    byte = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: {byte}), 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda p: array_to_string(words[p:p + 3], ' '))) END AS shingles FROM w),
t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reached(node, low) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.node)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, low.component_id
FROM s JOIN (SELECT node, min(low) AS component_id FROM reached GROUP BY node) low ON low.node = s.doc_id
"""

PREFIX_TRIE = rf"""
WITH c AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_hash,
                  len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h, list(turn_hash ORDER BY turn NULLS FIRST, turn_hash) AS turns,
               list(words ORDER BY turn NULLS FIRST, turn_hash) AS words FROM c GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns, list_concat(coalesce(b.words, [])[1:o.h], o.words[o.h + 1:]) AS words
      FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
n AS (SELECT conv_id, d, array_to_string(turns[1:d], '') AS path, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w, d = len(turns) AS ended
      FROM (SELECT conv_id, turns, words, unnest(range(0, len(turns) + 1)) AS d FROM r)),
g AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends FROM n GROUP BY path, d),
k AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
u AS (SELECT left(path, 64 * up) AS path, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
      FROM (SELECT g.path, n_convs, w, n_children IS NULL AS leaf, unnest(range(0, d + 1)) AS up FROM g LEFT JOIN k ON k.path = g.path) GROUP BY 1)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN u ON u.path = g.path LEFT JOIN k ON k.path = g.path LEFT JOIN g p ON g.d > 0 AND p.path = left(g.path, 64 * (g.d - 1))
"""


def _edit(state: str, kept: str, to: str) -> str:
    """The cheapest edit of a row in a state, ties by the audit; ``kept`` gives the state after Keep by initial."""
    def after(name: str, cost: str, edit: str) -> str:
        return f"{{'c': v.{name}.c + {cost}, 'a': '{edit}' || v.{name}.a}}"

    keeps = ", ".join(f"CASE WHEN NOT forced AND ini = '{ini}' THEN {after(name, 'cut', 'K')} END" for ini, name in (x.split(">") for x in kept.split()))
    return f"least({after(state, '4', 'D')}, {keeps}, CASE WHEN NOT forced THEN {after(to, '3 + cut', 'R')} END) AS {state}"


def _inserted(name: str, times: int) -> str:
    return f"{{'c': {name}.c + {3 * times}, 'a': '{'I' * times}' || {name}.a}}"


# States: q0 nothing yet, q1 after s, q2 after u, q3 after a. v holds the cheapest rest (cost, audit) from each.
TURN_REPAIR = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
             CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini,
             right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM e),
g AS (SELECT *, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
             lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS next_ini FROM f),
r AS (SELECT *, blank OR dup AS forced, CASE WHEN NOT blank AND NOT dup AND tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS cut FROM g),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
             count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut > 0) AS truncated,
             count(*) FILTER (WHERE next_ini IS NOT NULL AND ini || next_ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
v AS (SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS q0, {{'c': 6, 'a': 'II'}} AS q1, {{'c': 3, 'a': 'I'}} AS q2, {{'c': 0, 'a': ''}} AS q3 FROM s
      UNION ALL
      SELECT conv_id, i, least(q0, {_inserted('q2', 1)}, {_inserted('q3', 2)}), least(q1, {_inserted('q2', 1)}, {_inserted('q3', 2)}),
             least(q2, {_inserted('q3', 1)}), least(q3, {_inserted('q2', 1)})
      FROM (SELECT v.conv_id, v.i - 1 AS i, {_edit('q0', 's>q1 u>q2', 'q2')}, {_edit('q1', 'u>q2', 'q2')}, {_edit('q2', 'a>q3', 'q3')}, {_edit('q3', 'u>q2', 'q2')}
            FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i)),
a AS (SELECT conv_id, q0.c AS cost, q0.a AS audit FROM v WHERE i = 0),
p AS (SELECT conv_id, audit, k, audit[k] AS edit, len(replace(audit[1:k], 'I', '')) AS i, len(replace(audit[1:k], 'D', '')) AS place
      FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM a)),
o AS (SELECT p.*, r.role, r.text, bool_or(place = 1 AND edit = 'K' AND ini = 's') OVER (PARTITION BY p.conv_id) AS system
      FROM p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i AND p.edit <> 'I'),
x AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place + system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                                 CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) FILTER (WHERE edit <> 'D') AS repaired FROM o GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""
