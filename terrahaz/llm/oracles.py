"""SQL of operators whose rules SQL can say: the Merkle manifest and the repair of conversations."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text."""
    byte = ("list_reduce(list_concat([xor(a, c)], [0, 0, 0, 0, 0, 0, 0, 0]), "
            "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)")
    codes = f"list_transform(string_split({text}, ''), lambda s: cast(ord(s) AS bigint))"
    return f"xor(list_reduce(list_concat([cast(4294967295 AS bigint)], {codes}), lambda a, c: {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(cast(strlen({value}) AS varchar) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    fields = ["cast(doc_id AS varchar)", "source", "lang", "cast(n_chars AS varchar)", text]
    return f"sha256({' || '.join(map(_field, fields))})"


def _tree(name: str, leaves: str) -> str:
    """CTE of all nodes over leaves (k, idx, n, digest): levels from 0, until one node is left per k."""
    return f"""{name} AS (
  SELECT 0 AS level, k, idx, n, digest FROM {leaves}
  UNION ALL
  SELECT any_value(level) + 1, k, idx // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY k, idx // 16)"""


def _steps(name: str, leaves: str, tree: str) -> str:
    """CTE of the siblings of every leaf at every level below its root."""
    place = "(l.idx // cast(pow(16, s.level) AS bigint))"
    return f"""{name} AS (
  SELECT l.k, l.idx, s.level, coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx < {place}), '') AS before,
    coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx > {place}), '') AS behind
  FROM {leaves} l JOIN (SELECT DISTINCT k, level FROM {tree} WHERE n > 1) s ON s.k = l.k
  JOIN {tree} t ON t.k = l.k AND t.level = s.level AND t.idx // 16 = {place} // 16 GROUP BY l.k, l.idx, s.level)"""


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_leaf('text')} AS digest,
    CASE WHEN {crc32('cast(doc_id AS varchar)')} % 5 = 0 THEN {_leaf(LOWER)} ELSE {_leaf('text')} END AS shown
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM docs),
{_tree('nodes', 'leaves')},
groups AS (SELECT '' AS k, k AS name, digest, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree('top', 'groups')},
{_steps('own', 'leaves', 'nodes')},
{_steps('above', 'groups', 'top')},
path AS (
  SELECT k, idx, level, before, behind FROM own
  UNION ALL SELECT l.k, l.idx, 100 + a.level, a.before, a.behind FROM leaves l JOIN groups g ON g.name = l.k JOIN above a ON a.idx = g.idx),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k, idx ORDER BY level) AS step, count(*) OVER (PARTITION BY k, idx) AS steps FROM path),
folded AS (
  SELECT k, idx, cast(0 AS bigint) AS step, shown AS h FROM leaves
  UNION ALL SELECT f.k, f.idx, p.step, sha256(p.before || f.h || p.behind) FROM folded f JOIN numbered p ON p.k = f.k AND p.idx = f.idx AND p.step = f.step + 1),
ends AS (SELECT k, idx, arg_max(h, step) AS h FROM folded GROUP BY k, idx),
proof AS (SELECT k, idx, string_agg(before || behind, '' ORDER BY step) AS siblings FROM numbered GROUP BY k, idx)
SELECT l.doc_id, l.digest AS leaf, g.digest AS subroot, r.digest AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
  e.h AS folded_root, e.h = r.digest AS verified
FROM leaves l JOIN groups g ON g.name = l.k CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
JOIN ends e ON e.k = l.k AND e.idx = l.idx LEFT JOIN proof p ON p.k = l.k AND p.idx = l.idx"""


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = "coalesce(cast(conv_id AS varchar), ' ')"

CONVERSATIONS = f"""WITH RECURSIVE base AS (
  SELECT conv_id, {_KEY} AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32(_KEY + " || ':' || coalesce(cast(turn AS varchar), ' ')")} % 20 AS kind FROM conversations),
kept AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM base WHERE kind <> 0) c),
placed AS (SELECT *, trim(text, {WHITE}) AS bare,
    row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(cast(strlen(role) AS varchar) || ':' || role || text)) AS i FROM kept),
told AS (SELECT *, substr(role, 1, 1) AS c, CASE WHEN bare = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(substr(role, 1, 1)) OVER (PARTITION BY k ORDER BY i) AS c0 FROM placed),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE i > 1 AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM told GROUP BY k),
-- states: 0 nothing yet, 1 after s, 2 after u, 3 after a; up to two rows inserted behind each edit
ins(q, q2, more, letters, lines) AS (VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, '', ''), (1, 2, 5, 'I', chr(10) || 'user:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', chr(10) || 'user:')),
edit(q, letter, q1, c, price) AS (VALUES (0, 'D', 0, NULL, 2), (1, 'D', 1, NULL, 2), (2, 'D', 2, NULL, 2), (3, 'D', 3, NULL, 2),
  (0, 'R', 2, NULL, 1), (1, 'R', 2, NULL, 1), (2, 'R', 3, NULL, 1), (3, 'R', 2, NULL, 1),
  (0, 'K', 1, 's', 0), (0, 'K', 2, 'u', 0), (1, 'K', 2, 'u', 0), (3, 'K', 2, 'u', 0), (2, 'K', 3, 'a', 0)),
walk AS (
  SELECT k, cast(0 AS bigint) AS i, ins.q2 AS q, struct_pack(cost := cast(more AS bigint), audit := letters, said := lines) AS best FROM counts, ins WHERE ins.q = 0
  UNION ALL
  SELECT w.k, any_value(t.i), ins.q2, min(struct_pack(
    cost := w.best.cost + e.price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END + ins.more,
    audit := w.best.audit || letter || ins.letters,
    said := w.best.said || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
      ELSE chr(10) || CASE e.q1 WHEN 2 THEN 'user:' ELSE 'assistant:' END || text END || ins.lines))
  FROM walk w JOIN told t ON t.k = w.k AND t.i = w.i + 1 JOIN edit e ON e.q = w.q AND (e.c IS NULL OR e.c = t.c)
    AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) JOIN ins ON ins.q = e.q1 GROUP BY w.k, ins.q2),
ends AS (SELECT w.k, min(w.best) AS best FROM walk w JOIN counts c ON c.k = w.k AND c.n = w.i WHERE w.q IN (0, 3) GROUP BY w.k)
SELECT b.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM base) b LEFT JOIN counts c ON c.k = b.k LEFT JOIN ends e ON e.k = b.k"""
