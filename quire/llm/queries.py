"""The ``opN_`` queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, html_text, jaccard_join, langid, licenses, line_dedup, mixing, syncmers, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, shared.owner IS NOT NULL AND shared.owner <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(_table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(spark, _table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length('<turn>') + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), ':', '\c')) + 1
            + length(replace(replace(text, '\', '\b'), '<', '\l')) + length('</turn>') AS size
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, sum(strlen(text) // 4)::BIGINT AS tokens
FROM sized GROUP BY conv_id
"""


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS k,
         CASE WHEN strlen(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, strlen(text) // 4) END::BIGINT AS tokens
  FROM documents
), totals AS (
  SELECT source, sum(tokens)::BIGINT AS t FROM docs GROUP BY source
), shares AS (
  SELECT list(t::DOUBLE / (SELECT sum(t) FROM totals) ORDER BY source) AS ps FROM totals WHERE t > 0
), steps(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (
    SELECT i, lo, hi, len(ps) < 2 OR (
        -list_sum(list_transform(ps, lambda p: p ** m / z * ln(p ** m / z))) <= 0.97 * ln(len(ps)::DOUBLE)
        AND list_max(list_transform(ps, lambda p: p ** m / z / p)) <= 2.0) AS ok
    FROM (SELECT i, lo, hi, ps, (lo + hi) / 2 AS m, list_sum(list_transform(ps, lambda p: p ** ((lo + hi) / 2))) AS z FROM steps, shares WHERE i < 60)
  )
), pick AS (
  SELECT hi AS a, ps, list_sum(list_transform(ps, lambda p: p ** hi)) AS z FROM steps, shares WHERE i = 60
), plan AS (
  SELECT source, t, CASE WHEN t = 0 THEN 0.0 ELSE (t::DOUBLE / (SELECT sum(t) FROM totals)) ** a / z END AS share,
         greatest(1, (t + 199999) // 200000)::BIGINT AS blocks
  FROM totals, pick
), goal AS (
  SELECT *, CASE WHEN t = 0 THEN 0 ELSE floor(share * (SELECT sum(t) FROM totals) + 1e-6) END::BIGINT AS target FROM plan
), placed AS (
  SELECT docs.*, goal.t, share, target, (('0x' || substr(k, 1, 8))::BIGINT % blocks)::BIGINT AS block FROM docs JOIN goal USING (source)
), permuted AS (
  SELECT *, md5('mix-1|' || source || '|' || (CASE WHEN t = 0 THEN 1 ELSE target // t END + 1) || '|' || block) AS turn FROM placed
), summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY turn, k, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM permuted
)
SELECT doc_id, source, tokens, round(share, 9) AS weight, block,
       (CASE WHEN t = 0 THEN 1 ELSE target // t + CASE WHEN upto <= target % t THEN 1 ELSE 0 END END)::BIGINT AS copies
FROM summed
"""


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)
"""


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), places AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM words, (SELECT DISTINCT k FROM windows), unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(i)
), met AS (
  SELECT doc_id, i, places.k, item_id FROM places JOIN windows ON places.s = windows.s AND places.k = windows.k
), hit AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM met), unnest(range(0, k)) AS t(j) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id AS id FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_document_fingerprints": op2_document_fingerprints,
        "op3_html_extraction": op3_html_extraction,
        "op4_language_id": op4_language_id,
        "op5_url_filters": op5_url_filters,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_source_mixing": op7_source_mixing,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_license_scans": op9_license_scans,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op6_chat_formatting": OP6_SQL,
        "op7_source_mixing": OP7_SQL,
        "op8_ngram_jaccard_join": OP8_SQL,
        "op10_benchmark_decontamination": OP10_SQL,
    }
