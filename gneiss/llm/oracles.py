"""SQL of the operators on trees, runs and shards."""

from __future__ import annotations

from gneiss.llm import runs, sharding

#: The CRC-32 of a list of bytes, by the usual table, which is made by its rule.
_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i))"


def _crc32(text: str) -> str:
    """Unsigned; the table has to be in scope as crc_table.t."""
    each = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({each}, lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]), 4294967295), 4294967295)"


def _encoded(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _tree(name: str, of: str) -> str:
    """Nodes of every level over of(key, pos, n, h)."""
    return f"""{name}(key, level, pos, n, h) AS (
  SELECT key, 0, pos, n, h FROM {of}
  UNION ALL SELECT key, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY key, level, pos // 2, n
)"""


def _path(name: str, of: str, tree: str) -> str:
    """By leaf, its siblings from below: a side and a digest, or an empty text where there is none."""
    return f"""{name} AS (
  SELECT o.key, o.pos, list(coalesce(CASE WHEN s.pos % 2 = 0 THEN 'L' ELSE 'R' END || s.h, '') ORDER BY v.level) AS path
  FROM {of} o JOIN (SELECT DISTINCT key, level FROM {tree} WHERE n > 1) v ON o.key IS NOT DISTINCT FROM v.key
  LEFT JOIN {tree} s ON s.key IS NOT DISTINCT FROM o.key AND s.level = v.level AND s.pos = xor(o.pos >> v.level, 1) GROUP BY ALL
)"""


def op11() -> str:
    leaf = lambda n_chars: "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
    return rf"""
WITH RECURSIVE crc_table AS (SELECT {_TABLE} AS t
), rows AS (
  SELECT doc_id, lang AS key, {leaf("n_chars")} AS h, {leaf(f"n_chars + CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN 1 ELSE 0 END")} AS claim FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM rows
), {_tree("tree", "leaves")}, tops AS (
  SELECT key AS lang, CAST(NULL AS VARCHAR) AS key, h, row_number() OVER (ORDER BY encode(key) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), {_tree("over", "tops")}, {_path("low", "leaves", "tree")}, {_path("high", "tops", "over")}, proved AS (
  SELECT l.doc_id, l.h AS leaf, l.claim, t.h AS subroot, (SELECT h FROM over WHERE n = 1) AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM leaves l JOIN tops t ON l.key IS NOT DISTINCT FROM t.lang LEFT JOIN low ON low.key IS NOT DISTINCT FROM l.key AND low.pos = l.pos LEFT JOIN high ON high.pos = t.pos
), folded AS (
  SELECT *, list_reduce(path, lambda h, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] ELSE '' END || h || CASE WHEN s[1] = 'R' THEN s[2:] ELSE '' END), claim) AS folded_root FROM proved
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def op12() -> str:
    return rf"""
WITH crc_table AS (SELECT {_TABLE} AS t
), w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc_table
), g AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a, (h // 10) % 8 AS more FROM w
), planted AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % (1 + (n - a) // (3 + more)) + 1] END) END AS words FROM g
), single AS (
  SELECT r, n, unnest(words) AS word, unnest(range(n)) AS i FROM planted
), same AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM single x JOIN single y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND {runs.TIMES} * (y.i - x.i) <= x.n
), islands AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island
), found AS (
  SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest({runs.LEAST}, {runs.TIMES} * q) GROUP BY r, start, length
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
    list(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period)[1] AS best FROM found GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM found
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM single ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM planted LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""


def op13() -> str:
    salts = ", ".join(f"{x}::UBIGINT" for x in sharding._salts(sharding.SEED))
    mixed = f"SELECT row, step, l, r, n, a, b, xor(CASE WHEN step % 2 = 0 THEN r ELSE l END, [{salts}][CAST(step % {sharding.ROUNDS} AS INT) + 1]) AS z FROM walk, base WHERE step = 0 OR step % {sharding.ROUNDS} > 0 OR l * b + r >= n"
    for by in (0x85EBCA6B, 0xC2B2AE35):
        mixed = f"SELECT * REPLACE ((xor(z, z >> 15) * {by}::UBIGINT) % 4294967296 AS z) FROM ({mixed})"
    return rf"""
WITH RECURSIVE crc_table AS (SELECT {_TABLE} AS t
), rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) - 1 AS row FROM documents, crc_table
), base AS (
  SELECT n, a, (n + a - 1) // a AS b FROM (SELECT CAST(count(*) AS UBIGINT) AS n, CAST(ceil(sqrt(count(*))) AS UBIGINT) AS a FROM documents)
), walk(row, step, l, r) AS (
  SELECT row, 0, row // b, row % b FROM (SELECT CAST(row AS UBIGINT) AS row FROM rows), base
  UNION ALL SELECT row, step + 1, CASE WHEN step % 2 = 0 THEN (l + xor(z, z >> 16)) % a ELSE l END, CASE WHEN step % 2 = 1 THEN (r + xor(z, z >> 16)) % b ELSE r END FROM ({mixed})
), placed AS (
  SELECT row, l * b + r AS place FROM walk, base WHERE step > 0 AND step % {sharding.ROUNDS} = 0 AND l * b + r < n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % {sharding.SHARDS} AS INTEGER) AS shard, CAST(place // {sharding.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows JOIN placed ON rows.row = placed.row
"""
