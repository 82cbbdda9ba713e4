"""Queries on text functions, blocks and import rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import blocks
from quire.queries import query, table
from quire.sources import importer

LINES_SQL = """lines AS (
  SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS line,
         generate_subscripts(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS pos
  FROM documents
)"""
#: Lines of documents in the shapes that Markdown blocks have, by position.
DECORATED_SQL = (
    "WITH "
    + LINES_SQL
    + """, decorated AS (
  SELECT doc_id, pos, CASE pos % 7 WHEN 1 THEN '## ' || line WHEN 2 THEN '> ' || line WHEN 3 THEN '- ' || line WHEN 4 THEN '***'
                                   WHEN 5 THEN (pos::VARCHAR) || '. ' || line ELSE line END AS line
  FROM lines
), blocks AS (
  SELECT doc_id, (pos + 1)::INTEGER AS ordinal, line AS text, CASE
    WHEN regexp_matches(line, '^#{1,6}\\s+') THEN 'heading' WHEN trim(line) = '***' THEN 'scene_break' WHEN starts_with(trim(line), '>') THEN 'blockquote'
    WHEN regexp_matches(line, '^\\s*([-*+]|[0-9]+[.)])\\s+') THEN 'list' ELSE 'paragraph' END AS block_type
  FROM decorated
)""".replace("\\\\", "\\")
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line blocks of documents: (doc_id, ordinal, text, block_type)."""
    m, line = F.col("pos") % 7, F.col("line")
    shaped = (
        F.when(m == 1, F.concat(F.lit("## "), line)).when(m == 2, F.concat(F.lit("> "), line)).when(m == 3, F.concat(F.lit("- "), line))
        .when(m == 4, F.lit("***")).when(m == 5, F.concat(F.col("pos").cast("string"), F.lit(". "), line)).otherwise(line)
    )
    rows = lines(spark, sf_dir).select("doc_id", (F.col("pos") + 1).alias("ordinal"), shaped.alias("text"))
    kind = F.when(F.col("text").rlike(blocks.HEADING), "heading").otherwise(blocks.classify(F.col("text")))
    return rows.withColumn("block_type", kind)


@query("WITH " + LINES_SQL + " SELECT doc_id, pos::INTEGER AS pos, line FROM lines")
def blk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir)


@query(DECORATED_SQL + " SELECT doc_id, ordinal, block_type FROM blocks")
def blk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", "ordinal", "block_type")


@query(
    DECORATED_SQL
    + """ SELECT doc_id, ordinal, row_number() OVER w AS block_ordinal,
      CASE WHEN block_type IN ('paragraph', 'blockquote', 'list') THEN sum(CASE WHEN block_type IN ('paragraph', 'blockquote', 'list') THEN 1 ELSE 0 END) OVER w END::BIGINT AS paragraph_ordinal
    FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)"""
)
def blk_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.ordinals(decorated(spark, sf_dir)).select("doc_id", "ordinal", "block_ordinal", "paragraph_ordinal")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS text_hash FROM documents")
def blk_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("text_hash"))


@query(
    DECORATED_SQL
    + """, sized AS (SELECT *, len(string_split(text, chr(10))) AS n FROM blocks)
    SELECT doc_id, ordinal, (coalesce(sum(n + 1) OVER w, 0) + 1)::BIGINT AS line_start, (coalesce(sum(n + 1) OVER w, 0) + n)::BIGINT AS line_end
    FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def blk_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.line_ranges(decorated(spark, sf_dir), "doc_id").select("doc_id", "ordinal", "line_start", "line_end")


BLOCKS_SQL = (
    "WITH "
    + LINES_SQL
    + r""", said AS (SELECT doc_id, pos, line, regexp_replace(line, '[ \t]+$', '') AS text, regexp_matches(line, '^#\s+.*\S\s*$') AS h1 FROM lines WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''),
first AS (SELECT doc_id, min(pos) AS pos FROM said WHERE h1 GROUP BY doc_id),
blocks AS (
  SELECT doc_id, pos, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block_ordinal, CASE WHEN regexp_matches(text, '^#{1,6}\s+') THEN 'heading'
    WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') IN ('***', '---', '* * *', '#') THEN 'scene_break' WHEN starts_with(regexp_replace(text, '^\s+', ''), '>') THEN 'blockquote'
    WHEN regexp_matches(text, '^\s*([-*+]|[0-9]+[.)])\s+') THEN 'list' ELSE 'paragraph' END AS block_type
  FROM said WHERE NOT EXISTS (SELECT 1 FROM first WHERE first.doc_id = said.doc_id AND first.pos = said.pos)
), named AS (
  SELECT *, block_type IN ('paragraph', 'blockquote', 'list') AS citable, 'p-' || upper(substr(sha256(doc_id || chr(0) || block_ordinal), 1, 26)) AS id FROM blocks
)"""
)


@query(
    BLOCKS_SQL
    + """ SELECT doc_id, id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INTEGER AS ordinal, block_ordinal::INTEGER AS block_ordinal, block_type, 'sha256:' || sha256(text) AS text_hash,
      (2 * pos + 1)::INTEGER AS line_start, (2 * pos + 1)::INTEGER AS line_end FROM named WHERE citable"""
)
def blk_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-line blocks of whole documents, lines of odd position made blank-separated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return blocks.paragraphs(blocks.parse_blocks(docs)).select("doc_id", "id", "ordinal", "block_ordinal", "block_type", "text_hash", "line_start", "line_end")


@query("SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, strlen(text) // 4) END::BIGINT AS tokens FROM documents")
def txt_approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.approx_tokens(F.col("text")).alias("tokens"))


SENTENCE_SQL = r"""
WITH s AS (SELECT doc_id, regexp_extract(trim(regexp_replace(text, '\s+', ' ', 'g')), '^([^.!?]*[.!?]?)', 1) AS t FROM documents),
c AS (SELECT doc_id, t, left(t, 240) AS h FROM s)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE trim(CASE WHEN regexp_matches(h, '^.+ [^ ]*$') THEN regexp_extract(h, '^(.+) [^ ]*$', 1) ELSE h END) || '...' END AS sentence FROM c
"""


@query(SENTENCE_SQL)
def txt_first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_sentence(F.col("text"), 240).alias("sentence"))


TITLE_SQL = r"""
WITH w AS (SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 12), ' ') AS t FROM documents),
t1 AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '^["'']+|["'']+$', '', 'g'), '[.,;:!?-]+$', ''), '^["'']+|["'']+$', '', 'g')) AS t FROM w),
t2 AS (SELECT doc_id, t, left(t, 80) AS h FROM t1),
t3 AS (SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE
  trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(h, '^.+ [^ ]*$') THEN regexp_extract(h, '^(.+) [^ ]*$', 1) ELSE h END, '^["'']+|["'']+$', '', 'g'), '[.,;:!?-]+$', ''), '^["'']+|["'']+$', '', 'g')) END AS t FROM t2)
SELECT doc_id, CASE WHEN t = '' THEN 'Scene ' || doc_id ELSE t END AS title FROM t3
"""


@query(TITLE_SQL)
def txt_derived_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    fallback = F.concat(F.lit("Scene "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.derived_title(F.col("text"), fallback).alias("title"))


@query(
    r"""
WITH n AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) AS f FROM pages),
w AS (SELECT page_id, list_filter(string_split(trim(regexp_replace(translate(regexp_replace(regexp_replace(f, '\.[^.]*$', ''), '^[0-9]+[-_. ]+', ''), '-_', '  '), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM n)
SELECT page_id, coalesce(array_to_string(list_transform(ws, lambda x: upper(x[1:1]) || x[2:]), ' '), '') AS title FROM w
"""
)
def txt_title_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)/?$", 1)
    return table(spark, sf_dir, "pages").select("page_id", tx.title_from_filename(name).alias("title"))


@query(
    r"""
SELECT conv_id, turn, trim(regexp_replace(translate(lower(coalesce(text, '')), '?.,!;:-_/\''"', '            '), '\s+', ' ', 'g')) AS question FROM conversations
"""
)
def txt_normalize_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.normalize_question(F.col("text")).alias("question"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of supplier keys: some with leading zeros that clash, some without a number."""
    k = F.col("s_suppkey")
    name = (
        F.when(k % 11 == 0, F.concat(F.lit("notes-"), k.cast("string"), F.lit(".md")))
        .when(k % 2 == 0, F.concat(F.lpad((k / 2).cast("int").cast("string"), 4, "0"), F.lit("-part_two.md")))
        .otherwise(F.concat(k.cast("string"), F.lit("_part-one.md")))
    )
    return table(spark, sf_dir, "supplier").select(name.alias("file_name"))


NAMES_SQL = """WITH names AS (
  SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'notes-' || s_suppkey || '.md' WHEN s_suppkey % 2 = 0 THEN lpad((s_suppkey // 2)::VARCHAR, 4, '0') || '-part_two.md'
              ELSE s_suppkey || '_part-one.md' END AS file_name FROM supplier
), numbered AS (SELECT file_name, nullif(regexp_extract(file_name, '^([0-9]+)[-_. ]+', 1), '')::BIGINT AS number FROM names)"""


@query(
    NAMES_SQL
    + " SELECT file_name, number, row_number() OVER (ORDER BY number, file_name) AS ord FROM (SELECT * FROM numbered WHERE number IS NOT NULL)"
)
def imp_numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered, _ = importer.numeric_order(_names(spark, sf_dir).where(F.col("file_name").rlike("^[0-9]")))
    return ordered.select("file_name", F.col("number").cast("long").alias("number"), F.col("order").cast("long").alias("ord"))


@query(
    NAMES_SQL
    + """ SELECT file_name, CASE WHEN number IS NULL THEN 'no numeric prefix' ELSE 'order value ' || number || ' is shared' END AS problem
    FROM (SELECT *, count(*) OVER (PARTITION BY number) AS n FROM numbered) WHERE number IS NULL OR n > 1"""
)
def imp_order_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importer.numeric_order(_names(spark, sf_dir))[1]


@query(
    """WITH t AS (SELECT user_id, event_id, event_type = 'click' AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
    s AS (SELECT *, lower(event_type_) AS l FROM (SELECT t.*, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'a' || event_id END AS event_type_ FROM t WHERE h))
    SELECT user_id, -1 AS pos, 'no chapter boundary' AS problem FROM (SELECT DISTINCT user_id FROM t) WHERE user_id NOT IN (SELECT user_id FROM s)
    UNION ALL SELECT user_id, max(pos)::INTEGER, 'duplicate title' FROM s GROUP BY user_id, l HAVING count(*) > 1"""
)
def imp_boundary_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as lines: clicks are headings, every other one of the same title but for its case."""
    k = F.col("event_id")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("# "), F.when(k % 2 == 0, F.lit("A")).otherwise(F.concat(F.lit("a"), k)))).otherwise(F.lit("text"))
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))).alias("b"))
    docs = docs.select("user_id", F.array_join(F.transform("b", lambda x: x["l"]), "\n").alias("text"))
    return importer.boundary_problems(importer.boundaries(docs, "user_id", "text"), "user_id").select("user_id", "pos", "problem")


def _continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a user turn is a level-one heading, others are text."""
    c = table(spark, sf_dir, "conversations")
    flat = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    line = F.when(F.col("role") == "user", F.concat(F.lit("# "), flat)).otherwise(flat)
    met = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("b"))
    return met.select("conv_id", F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("text"))


@query(
    r"""
WITH flat AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), chr(10), ' ') AS t FROM conversations),
lines AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '# ' || t ELSE t END AS line, CASE WHEN role = 'user' AND trim(t) <> '' THEN trim(t) END AS title FROM flat),
numbered AS (SELECT *, sum(CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM lines)
SELECT conv_id, no::BIGINT AS chapter_no, arg_min(title, turn) AS title, string_agg(line, chr(10) ORDER BY turn) AS content, conv_id || '#chapter-' || lpad(no::VARCHAR, 4, '0') AS source_key
FROM numbered WHERE no > 0 GROUP BY conv_id, no
"""
)
def imp_continuous_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importer.continuous_split(importer.boundaries(_continuous(spark, sf_dir), "conv_id", "text"), "conv_id")


@query(
    r"""
WITH flat AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), chr(10), ' ') AS t FROM conversations),
starts AS (SELECT conv_id, turn, trim(t) AS title FROM flat WHERE role = 'user' AND trim(t) <> '')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chapter_no, title FROM starts
"""
)
def imp_boundary_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = importer.boundaries(_continuous(spark, sf_dir), "conv_id", "text", regex=r"^# (.*\S.*)$")
    return importer.continuous_split(marked, "conv_id").select("conv_id", "chapter_no", "title")


@query(
    """
WITH firsts AS (SELECT conv_id, min(turn) FILTER (role = 'user' AND trim(replace(coalesce(text, ''), chr(10), ' ')) <> '') AS f FROM conversations GROUP BY conv_id)
SELECT c.conv_id, bool_or(turn < coalesce(f, 2147483647) AND trim(replace(coalesce(text, ''), chr(10), ' ')) <> '') AS has_front_matter
FROM conversations c JOIN firsts USING (conv_id) GROUP BY c.conv_id
"""
)
def imp_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importer.front_matter(importer.boundaries(_continuous(spark, sf_dir), "conv_id", "text"), "conv_id")


@query(
    BLOCKS_SQL
    + """ SELECT doc_id::VARCHAR AS chapter_id, block_ordinal::INTEGER AS ordinal, block_type, CASE WHEN citable THEN id END AS paragraph_id, text,
      (3 + coalesce(sum(2 + citable::INT) OVER w, 0) + citable::INT)::INTEGER AS line_start, (3 + coalesce(sum(2 + citable::INT) OVER w, 0) + citable::INT)::INTEGER AS line_end, NULL::VARCHAR AS problem
    FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def snk_render_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written to canonical text and read again, by document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    found = blocks.parse_blocks(docs)
    named = found.withColumn("paragraph_id", F.when(blocks.citable(F.col("block_type")), tx.stable_id("p", F.col("doc_id"), F.col("ordinal"))))
    chapters = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("Document "), "doc_id").alias("title"))
    files = blocks.render(named.withColumnRenamed("doc_id", "chapter_id"), chapters)
    return blocks.load_canonical(files).select("chapter_id", "ordinal", "block_type", "paragraph_id", "text", "line_start", "line_end", "problem")


@query(
    NAMES_SQL
    + """ SELECT file_name, (row_number() OVER (ORDER BY file_name DESC))::INTEGER AS "order", 'Title of ' || file_name AS manifest_title FROM (SELECT DISTINCT file_name FROM names) ORDER BY file_name DESC LIMIT 20"""
)
def imp_manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty names, as a manifest lists them; the others are strays."""
    files = _names(spark, sf_dir).distinct()
    listed = [r["file_name"] for r in files.orderBy(F.desc("file_name")).limit(20).collect()]
    return importer.manifest_order(files, importer.Manifest([(f, f"Title of {f}") for f in listed]))[0].select("file_name", "order", "manifest_title")


@query(
    """WITH f AS (SELECT s_suppkey AS k, s_suppkey || '_part-one.md' AS file_name, row_number() OVER (ORDER BY s_suppkey) AS o FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 11 <> 0)
    SELECT 'ch-' || lpad(o::VARCHAR, 4, '0') AS id, o::INTEGER AS ordinal, CASE WHEN k % 4 = 1 THEN 'Chapter of ' || k ELSE 'Part One' END AS title, 'ch-' || lpad(o::VARCHAR, 4, '0') || '.md' AS file, file_name AS source_key FROM f"""
)
def imp_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of numbered files: titles from headings, else from file names."""
    k = F.col("s_suppkey")
    content = F.when(k % 4 == 1, F.concat(F.lit("Front\n# Chapter of "), k, F.lit("\nText"))).otherwise("Text only")
    files = table(spark, sf_dir, "supplier").where((k % 2 == 1) & (k % 11 != 0)).select(F.concat(k, F.lit("_part-one.md")).alias("file_name"), content.alias("content"))
    chapters, _ = importer.plan_folder(files)
    return chapters.select("id", "ordinal", "title", "file", "source_key")


@query(
    """WITH t AS (SELECT event_id, make_timestamp(2024, 1, (event_id % 28 + 1)::INTEGER, (event_id % 24)::INTEGER, 0, 0.0) AS t FROM events)
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_ms(t) WHEN 1 THEN epoch_ms(t) - 7200000 END AS millis, CASE event_id % 3 WHEN 0 THEN greatest(0, epoch_ms(t) - 1705276800000) WHEN 1 THEN greatest(0, epoch_ms(t) - 7200000 - 1705276800000) END AS elapsed FROM t"""
)
def txt_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 3339 texts in two zones, and texts that aren't; time passed since 2024-01-15."""
    k = F.col("event_id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.concat(F.lit(" 2024-01-"), two(k % 28 + 1), F.lit("T"), two(k % 24), F.lit(":00:00"), F.when(k % 3 == 0, "Z").when(k % 3 == 1, "+02:00").otherwise(" o'clock"))
    t = tx.parse_time(text)
    since = F.when(t.isNotNull(), tx.elapsed_ms(tx.parse_time(F.lit("2024-01-15T00:00:00Z")), t))
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(t).alias("millis"), since.alias("elapsed"))
