"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bpe, chat, decontaminate, langid, licenses, linededup, merkle, neardup, oracles, quality, runs, secrets, sharding, warc
from gneiss.llm.common import shared_dir, table

RANKS = "byte_bpe_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.sql("SELECT -7L conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') t(turn, role)")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/gneiss-{uuid.uuid4().hex}/warc"
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_ids", F.col("n_items").isNotNull().alias("contaminated"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), tokenizer()[0])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_chat_formatting, op2_warc, op3_minhash_near_dedup, op4_quality_rules, op5_line_dedup, op6_decontamination, op7_byte_bpe, op8_secret_scan, op9_license_scan, op10_language_id, op11_merkle_manifest, op12_periodic_runs, op13_sharding]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"

_OP1 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), made AS (
  SELECT *, length('<|im_start|>') + length(regexp_replace(replace(replace(role, '\', '\e'), chr(10), '\n'), '{_CONTROL}', '\1\\\2\3', 'g')) + 1
    + length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')) + length('<|im_end|>') + 1 AS n FROM rows
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned, sum(n) AS formatted_chars FROM made GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined
"""

_OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((instr('0123456789abcdef', hex[(5 * i) // 4 + 1]) - 1) * 16 + instr('0123456789abcdef', hex[(5 * i) // 4 + 2]) - 1) >> (3 - (5 * i) % 4)) % 32, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS sh FROM w
), n AS (
  SELECT doc_id, len(sh) AS n FROM s
), e AS (
  SELECT doc_id, hash(unnest(sh)) AS h FROM s
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)
), sym AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, pos) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON r.pos = sym.a
), c AS (
  SELECT doc_id, min(pos) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

_OP5 = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, i AS pos, lines[i + 1] AS a, lines[i + 2] AS b, lines[i + 3] AS c FROM (SELECT doc_id, lines, unnest(range(len(lines) - 2)) AS i FROM d WHERE len(lines) >= 3)
), o AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w WHERE trim(a) <> '' OR trim(b) <> '' OR trim(c) <> ''
), gone AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM o, range(3) t(j) WHERE k > 1
), g AS (
  SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id
), left_over AS (
  SELECT doc_id, len(lines) AS n_lines, coalesce(len(ats), 0) AS n_removed,
    CASE WHEN ats IS NULL THEN text ELSE array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT list_contains(ats, i)], chr(10)) END AS text
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, length(text) AS n_chars_left, sha256(text) AS text_sha256 FROM left_over
"""


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rewritten(column: str, rewrites) -> str:
    for pattern, to in rewrites:
        for i in "123":
            to = to.replace(f"${i}", f"\\{i}")
        column = f"regexp_replace({column}, {_sql_text(pattern)}, {_sql_text(to)}, 'g')"
    return column


def _op6() -> str:
    d = decontaminate
    own = f"translate(text, '{d.MARKS}', '')"
    for letter, to in d.FOLDED:
        own = f"replace({own}, '{letter}', '{to}')"
    numbered = _rewritten(f"' ' || {own} || ' '", d.NUMBERS)
    marked = lambda w: f"({w} >= '{d.NUMBER}' AND {w} < '{d.NAME}')"
    capital = lambda w: f"regexp_matches({w}, '{d.CAPITAL}')"
    template = "CASE WHEN kind = 2 THEN lower(x) WHEN {m} THEN x[1] WHEN kind = 0 AND {c} THEN '{n}' ELSE lower(x) END".format(m=marked("x"), c=capital("x"), n=d.NAME)
    slot = lambda w: f"(kind < 2 AND ({marked(w)} OR kind = 0 AND {capital(w)}))"
    value = lambda w: f"lower(CASE WHEN {marked(w)} THEN {w}[2:] ELSE {w} END)"
    return rf"""
WITH raw AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark
), m AS (
  SELECT side, id, CASE WHEN regexp_matches(text, '[0-9]') THEN {numbered} ELSE {own} END AS marked FROM raw WHERE text IS NOT NULL
), w AS (
  SELECT side, id, list_filter(regexp_split_to_array(marked, {_sql_text(d.SPLIT)}), lambda x: x <> '') AS words FROM m
), p AS (
  SELECT side, id, kind, words, list_transform(words, lambda x: {template}) AS plain FROM w, (SELECT unnest([0, 1, 2]) AS kind)
), it AS (
  SELECT id AS item_id, kind, words, plain, least(len(words), {d.WINDOW}) AS length FROM p WHERE side = 'b' AND len(words) > 0
), iw AS (
  SELECT item_id, kind, i AS item_at, length, len(words) AS n, array_to_string(plain[i + 1:i + length], ' ') AS key, words[i + 1:i + length] AS own
  FROM (SELECT *, unnest(range(len(words) - length + 1)) AS i FROM it)
), judged AS (
  SELECT *, kind < 2 AND n >= {d.SHORTEST} AND len(list_filter(own, lambda x: NOT {slot('x')})) >= least({d.LITERALS}, length - 1) AS counts FROM iw
), served AS (
  SELECT item_id, kind FROM judged WHERE kind < 2 GROUP BY item_id, kind HAVING count(*) FILTER (counts) > 0 AND 2 * count(*) FILTER (counts) >= count(*)
), used AS (
  SELECT DISTINCT item_id, kind, item_at, length, key, own FROM judged WHERE counts AND (item_id, kind) IN (SELECT item_id, kind FROM served) OR kind = 2 AND item_id NOT IN (SELECT item_id FROM served)
), totals AS (
  SELECT item_id, kind, count(DISTINCT item_at) AS total FROM used GROUP BY item_id, kind
), sorts AS (
  SELECT DISTINCT kind, length FROM used
), dw AS (
  SELECT id AS doc_id, kind, length, i AS pos, array_to_string(plain[i + 1:i + length], ' ') AS key, words[i + 1:i + length] AS said
  FROM (SELECT id, kind, words, plain, length, unnest(range(len(words) - length + 1)) AS i FROM p JOIN sorts USING (kind) WHERE side = 'd' AND len(words) >= length)
), hit AS (
  SELECT DISTINCT doc_id, item_id, kind, item_at, pos - item_at AS alignment, own, said FROM dw JOIN used USING (key, kind, length)
), pairs AS (
  SELECT doc_id, item_id, kind, item_at, alignment, {value('a')} AS item, {value('b')} AS doc FROM (SELECT * EXCLUDE (own, said), unnest(own) AS a, unnest(said) AS b FROM hit) WHERE {slot('a')}
), torn AS (
  SELECT doc_id, item_id, kind, alignment, item FROM pairs GROUP BY ALL HAVING count(DISTINCT doc) > 1
), void AS (
  SELECT DISTINCT doc_id, item_id, kind, alignment, item_at FROM pairs JOIN torn USING (doc_id, item_id, kind, alignment, item)
  WHERE (doc_id, item_id, kind, alignment, item_at) IN (SELECT doc_id, item_id, kind, alignment, item_at FROM pairs WHERE item <> doc)
), sound AS (
  SELECT DISTINCT doc_id, item_id, kind, alignment, item_at FROM hit ANTI JOIN void USING (doc_id, item_id, kind, alignment, item_at)
), found AS (
  SELECT doc_id, item_id, kind, count(DISTINCT item_at) AS windows, max(here) AS here
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, kind, alignment) AS here FROM sound) GROUP BY doc_id, item_id, kind
), leaked AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found JOIN totals USING (item_id, kind) WHERE CASE WHEN kind = 2 THEN here = total ELSE windows * 100 >= {d.SHARE} * total END) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_items, 0) AS n_items, item_ids, n_items IS NOT NULL AS contaminated FROM documents LEFT JOIN leaked USING (doc_id)
"""


def _op9() -> str:
    canonical = lambda t: f"trim({_rewritten(f'chr(10) || lower({t}) || chr(10)', licenses.REWRITES)})"
    forms = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in licenses.KNOWN)
    digests = ", ".join(f"({_sql_text(i)}, {_sql_text(t)}, {n}, '{d}')" for i, t, n, d in licenses.DIGESTS)
    names = ", ".join(_sql_text(i) for i in sorted({i for i, *_ in (*licenses.KNOWN, *licenses.DIGESTS)}))
    return rf"""
WITH made AS (
  SELECT DISTINCT license_id, {canonical('t')} AS form FROM (VALUES {forms}) v(license_id, t)
), k AS (
  SELECT license_id, string_split(form, ' ')[1:{licenses.ANCHOR}] AS first, len(string_split(form, ' ')) AS n, md5(form) AS digest FROM made
  UNION ALL SELECT license_id, string_split(first, ' '), n, digest FROM (VALUES {digests}) v(license_id, first, n, digest)
), d AS (
  SELECT doc_id, text, {canonical('text')} AS form FROM documents WHERE regexp_matches(lower(text), '{licenses.HINT}')
), w AS (
  SELECT doc_id, string_split(form, ' ') AS words FROM d
), span AS (
  SELECT DISTINCT doc_id, license_id, pos + n AS place FROM (SELECT doc_id, words, unnest(range(len(words))) AS pos FROM w), k
  WHERE words[pos + 1] = first[1] AND words[pos + 1:pos + len(first)] = first AND len(words) >= pos + n AND md5(array_to_string(words[pos + 1:pos + n], ' ')) = digest
), tag AS (
  SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(x, '\s+(?:[Oo][Rr]|[Aa][Nn][Dd]|[Ww][Ii][Tt][Hh])\s+|[()\s]+')), '(-only|-or-later|[+])$', '') AS license_id
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_sql_text(licenses.TAG)}, 1)) AS x FROM d)
), found AS (
  SELECT doc_id, license_id FROM span UNION ALL SELECT doc_id, license_id FROM tag WHERE license_id IN ({names})
), held AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM found GROUP BY doc_id
), whole AS (
  SELECT doc_id, min(license_id) AS license_id FROM d JOIN k ON md5(d.form) = k.digest GROUP BY doc_id
)
SELECT documents.doc_id, whole.license_id AS document_license, coalesce(held.n, 0) AS n_notices, held.ids AS notices
FROM documents LEFT JOIN whole ON whole.doc_id = documents.doc_id LEFT JOIN held ON held.doc_id = documents.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _OP1, "op2_warc": _OP2, "op3_minhash_near_dedup": _OP3, "op5_line_dedup": _OP5, "op6_decontamination": _op6(), "op9_license_scan": _op9(), "op11_merkle_manifest": oracles.op11(), "op12_periodic_runs": oracles.op12(), "op13_sharding": oracles.op13()}
