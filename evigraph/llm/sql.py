"""DuckDB SQL of the registered queries over trees of digests, benchmark windows and conversation prefixes."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string: its characters and eight shifts after each, folded."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda x, y: {fold}), CAST(4294967295 AS BIGINT))"


def _leaf(text: str) -> str:
    parts = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


def merkle(levels_of_source: int = 7, levels_of_sources: int = 5) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"""
d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, {_leaf('text')} AS leaf,
         CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(lower)} END AS tampered
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY s) AS n
  FROM d
),
l0 AS (SELECT s, pos, n, leaf AS node FROM placed),
f0 AS (SELECT k, s, pos, n, coalesce(tampered, leaf) AS folded, '' AS proof FROM placed)"""]

    def rounds(node: str, fold: str, levels: int) -> None:
        for i in range(levels):
            ctes.append(f"""
{node}{i + 1} AS (
  SELECT s, pos // 16 AS pos, any_value((n + 15) // 16) AS n,
         CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node
  FROM {node}{i} GROUP BY s, pos // 16
),
{fold}{i + 1} AS (
  SELECT f.k, f.s, f.pos // 16 AS pos, any_value((f.n + 15) // 16) AS n,
         CASE WHEN any_value(f.n) > 1 THEN sha256(string_agg(CASE WHEN f.pos = l.pos THEN folded ELSE node END, '' ORDER BY l.pos))
              ELSE any_value(folded) END AS folded,
         any_value(proof) || coalesce(string_agg(node, '' ORDER BY l.pos) FILTER (WHERE f.pos <> l.pos), '') AS proof
  FROM {fold}{i} f JOIN {node}{i} l ON f.s = l.s AND f.pos // 16 = l.pos // 16 GROUP BY f.k, f.s, f.pos
)""")

    rounds("l", "f", levels_of_source)
    ctes.append(f"""
t0 AS (SELECT 0 AS s, s AS pos, count(*) OVER () AS n, node FROM l{levels_of_source}),
g0 AS (SELECT f.k, 0 AS s, f.s AS pos, t.n, f.folded, f.proof FROM f{levels_of_source} f JOIN t0 t ON t.pos = f.s)""")
    rounds("t", "g", levels_of_sources)
    return f"""WITH {','.join(ctes)}
SELECT p.doc_id, p.leaf, b.node AS subroot, r.node AS root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root, g.folded = r.node AS verified
FROM placed p JOIN t0 b ON b.pos = p.s JOIN g{levels_of_sources} g ON g.k = p.k CROSS JOIN t{levels_of_sources} r"""


def decontamination(window: int = 10) -> str:
    words = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')")
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + {window - 1}], ' ') AS t, least(len(w), {window}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
),
hits AS (SELECT r.k, r.i, r.n, w.item_id FROM runs r JOIN windows w ON w.n = r.n AND w.t = r.t),
covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hits)) GROUP BY k),
items AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY k
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (k) LEFT JOIN items i USING (k)
"""


def prefix_trie(base: int = 100, heads: int = 6) -> str:
    return f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_id
  FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (SELECT conv_id, turn_id, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_id) AS pos FROM t),
convs AS (
  SELECT conv_id, conv_id - conv_id % {base} AS base, {crc32('CAST(conv_id AS VARCHAR)')} % {heads} AS h, count(*) AS n FROM t GROUP BY conv_id
),
sized AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
turns AS (
  SELECT s.conv_id, p.pos AS d, p.turn_id, p.chars FROM sized s JOIN placed p ON p.conv_id = s.base AND p.pos <= s.h
  UNION ALL SELECT s.conv_id, p.pos - s.h + s.taken, p.turn_id, p.chars FROM sized s JOIN placed p ON p.conv_id = s.conv_id AND p.pos > s.h
),
paths AS (
  SELECT conv_id, d, sha256(string_agg(turn_id, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key, chars FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
),
lengths AS (SELECT conv_id, max(d) AS len FROM paths GROUP BY conv_id),
nodes AS (
  SELECT p.d, p.key, min(p.conv_id) AS conv, count(*) AS n, any_value(p.chars) AS chars,
         string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE l.len = p.d) AS ends
  FROM paths p JOIN lengths l USING (conv_id) GROUP BY p.d, p.key
),
up AS (SELECT n.d, n.key, n.conv, q.d AS pd, q.key AS pkey FROM nodes n JOIN paths q ON q.conv_id = n.conv AND q.d = n.d - 1),
children AS (SELECT pd AS d, pkey AS key, count(*) AS c FROM up GROUP BY pd, pkey),
below AS (
  SELECT a.d, a.key, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (WHERE c.c IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.key = n.key JOIN paths a ON a.conv_id = n.conv AND a.d <= n.d
  GROUP BY a.d, a.key
)
SELECT n.conv AS conv_id, CAST(n.d AS BIGINT) AS depth, p.conv AS parent_conv_id, n.n AS n_convs, coalesce(c.c, 0) AS n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.d = n.d AND b.key = n.key
LEFT JOIN children c ON c.d = n.d AND c.key = n.key
LEFT JOIN up u ON u.d = n.d AND u.key = n.key
LEFT JOIN nodes p ON p.d = u.pd AND p.key = u.pkey
"""
