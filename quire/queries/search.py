"""Queries on full-text search and the reverse index."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.jsonvals import flexible_list
from quire.operators import postings, revindex, search
from quire.queries import query, table
from quire.queries.texts import LINES_SQL, lines
from quire.sources.aside import shared_folder
from quire.sources.store import Store

_TOKENS = "regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(source: str, key: str, text: str, words: list[str], where: str = "TRUE", limit: int = 20) -> str:
    """SQL of a query of words, all of which must occur."""
    tf = ", ".join(f"len(list_filter(ts, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(words)))
    idf = lambda i: f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5)))"
    part = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(len(words)))
    need = " AND ".join(f"f{i} > 0" for i in range(len(words)))
    return f"""t AS (SELECT *, {_TOKENS.format(text)} AS ts FROM {source}), c AS (SELECT *, len(ts) AS dl, {tf} FROM t),
    s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c)
    SELECT {key}, round(-({part}), 6) AS score FROM c, s WHERE {need} AND {where} ORDER BY round(-({part}), 6), {key} LIMIT {limit}"""


_SOURCES = {
    "lines": (lines, ["doc_id", "pos"], "line"),
    "documents": (lambda spark, sf_dir: table(spark, sf_dir, "documents"), ["doc_id"], "text"),
    "benchmark": (lambda spark, sf_dir: table(spark, sf_dir, "benchmark"), ["item_id"], "text"),
}


def _version(spark: SparkSession, sf_dir: str, name: str) -> str:
    """What tells one state of a table's files from another: names, lengths, times."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(path)
    return hashlib.sha256("|".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)).encode()).hexdigest()[:24]


def index(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of a source, built when its tables are first searched and kept beside them in the shared folder."""
    source, key, text = _SOURCES[name]
    version = _version(spark, sf_dir, "benchmark" if name == "benchmark" else "documents")
    store = Store(spark, f"{shared_folder(spark)}/quire-index/{spark.sparkContext.applicationId}/{name}-{version}")
    if not store.has("statistics"):
        docs = source(spark, sf_dir)
        buckets = postings.buckets_for(docs, [text])
        store.update({"postings": postings.build(docs, key, [text], buckets)})
        store.update({"statistics": postings.statistics(docs, store.read("postings"), buckets)})
    return store.read("postings"), store.read("statistics")


def _found(spark: SparkSession, sf_dir: str, name: str, words: str, where: DataFrame | None = None) -> DataFrame:
    return postings.search(*index(spark, sf_dir, name), words, _SOURCES[name][1], where, None)


def _rounded(df: DataFrame, key: list[str], limit: int = 20) -> DataFrame:
    """Scores to six places, then the limit, so that ties break alike everywhere."""
    return df.withColumn("score", F.round("score", 6)).orderBy("score", *key).limit(limit)


BM25_LINES_SQL = "WITH " + LINES_SQL + ", " + bm25_sql("lines", "doc_id, pos::INTEGER AS pos", "line", ["the", "of"]).replace(", doc_id, pos::INTEGER AS pos LIMIT", ", doc_id, pos LIMIT")


@query(BM25_LINES_SQL)
def fts_bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_found(spark, sf_dir, "lines", "the of"), ["doc_id", "pos"])


@query(BM25_LINES_SQL)
def fts_bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index, for frames that have none."""
    return _rounded(search.score(lines(spark, sf_dir), "the of", ["doc_id", "pos"], ["line"], limit=None), ["doc_id", "pos"])


@query("WITH " + LINES_SQL + ", t AS (SELECT doc_id, pos, " + _TOKENS.format("line") + " AS ts FROM lines), u AS (SELECT doc_id, pos, len(ts) AS dl, unnest(ts) AS token FROM t) SELECT token, doc_id, pos::INTEGER AS pos, count(*) AS tf, any_value(dl)::BIGINT AS dl FROM u GROUP BY ALL")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "lines")[0].drop("bucket")


@query("WITH " + bm25_sql("documents", "doc_id", "text", ["the", "of"], "lang = 'en' AND n_chars > 500"))
def fts_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    let = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("n_chars") > 500))
    return _rounded(_found(spark, sf_dir, "documents", "The, OF!", let), ["doc_id"])


def _and_sql(key: str, source: str, text: str, test: str) -> str:
    return f"WITH t AS (SELECT {key}, {_TOKENS.format(text)} AS ts FROM {source}) SELECT {key} FROM t WHERE {test}"


@query(_and_sql("doc_id", "documents", "text", "list_contains(ts, 'etre') AND list_contains(ts, 'une')"))
def fts_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diacritics and case don't matter."""
    return _found(spark, sf_dir, "documents", "Étre une").select("doc_id")


@query(_and_sql("doc_id", "documents", "text", "(list_contains(ts, 'stupid') AND list_contains(ts, 'the')) OR (list_contains(ts, 'der') AND NOT list_contains(ts, 'die'))"))
def fts_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "documents", "stupid AND the OR der NOT die").select("doc_id")


@query(
    "SELECT source, rank, id, score FROM (SELECT *, row_number() OVER (ORDER BY score, k) AS rank FROM (WITH "
    + bm25_sql("documents", "doc_id", "text", ["and", "in"]).replace("SELECT doc_id,", "SELECT 'documents' AS source, doc_id AS k, doc_id::VARCHAR AS id,")
    + ")) UNION ALL SELECT source, rank, id, score FROM (SELECT *, row_number() OVER (ORDER BY score, k) AS rank FROM (WITH "
    + bm25_sql("benchmark", "item_id", "text", ["and", "in"], limit=10).replace("SELECT item_id,", "SELECT 'benchmark' AS source, item_id AS k, item_id::VARCHAR AS id,")
    + "))"
)
def fts_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {name: (_rounded(_found(spark, sf_dir, name, "and in"), _SOURCES[name][1], most), _SOURCES[name][1][0], most) for name, most in (("documents", 20), ("benchmark", 10))}
    ranked = search.search_sources(found)
    return ranked.select("source", F.col("rank").cast("long").alias("rank"), "id", "score")


@query(_and_sql("conv_id, turn", "conversations", "text", "list_contains(ts, 'la')").replace("SELECT conv_id, turn FROM", "SELECT DISTINCT conv_id, turn, len(ts)::BIGINT AS tokens FROM"))
def fts_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("ts"))
    return c.where(F.array_contains("ts", "la")).select("conv_id", "turn", F.size("ts").cast("long").alias("tokens")).distinct()


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scene cards: attributes in the shapes that card fields come in."""
    p = table(spark, sf_dir, "part")
    raw = F.concat(
        F.lit('{"themes": ["'), F.col("p_brand"), F.lit('", "'), F.upper("p_brand"), F.lit('", "'), F.col("p_brand"), F.lit('", 7, null], "pov": "'), F.col("p_type"),
        F.lit('", "locations": "", "entities": {"a": "b"}, "unresolved": [" '), F.col("p_brand"), F.lit(' "]}'),
    )
    return p.select(F.col("p_partkey").cast("string").alias("scene_id"), F.col("p_size").cast("string").alias("chapter_id"), raw.alias("raw_json"))


REFS_SQL = """WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'theme' AS term_type, unnest([p_brand, upper(p_brand)]) AS term, p_partkey::VARCHAR AS scene_id, p_size::VARCHAR AS chapter_id, 'themes' AS source_field FROM part
    UNION ALL SELECT 'pov', p_type, p_partkey::VARCHAR, p_size::VARCHAR, 'pov' FROM part WHERE p_type <> ''
    UNION ALL SELECT 'unresolved', ' ' || p_brand || ' ', p_partkey::VARCHAR, p_size::VARCHAR, 'unresolved' FROM part))"""


@query(REFS_SQL + " SELECT *, 1.0::DOUBLE AS weight, term AS raw_value FROM refs")
def rix_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revindex.refs(_cards(spark, sf_dir))


@query(REFS_SQL + " SELECT term_type, term, count(*) AS occurrence_count FROM refs GROUP BY 1, 2")
def rix_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revindex.terms(revindex.refs(_cards(spark, sf_dir)), distinct=True)


@query(REFS_SQL + " SELECT term_type, term, count(*) AS occurrence_count FROM refs WHERE term_type = 'theme' AND starts_with(term, 'Brand') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 50")
def rix_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revindex.find_terms(revindex.terms(revindex.refs(_cards(spark, sf_dir)), distinct=True), "Brand", "theme")


@query(REFS_SQL + " SELECT term_type, term, scene_id, source_field FROM refs WHERE term = (SELECT min(p_brand) FROM part)")
def rix_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return revindex.find_refs(revindex.refs(_cards(spark, sf_dir)), first).select("term_type", "term", "scene_id", "source_field")


@query("WITH " + LINES_SQL + " SELECT w AS term, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS w FROM lines) WHERE starts_with(w, 'Th') GROUP BY w")
def rix_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lines(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.split("line", " "))).alias("term")).where(F.col("term").startswith("Th"))
    return words.dropDuplicates(["doc_id", "term"]).groupBy("term").agg(F.count("*").alias("docs"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN [json_extract_string(props, '$.k')] WHEN 1 THEN ['a', json_extract_string(props, '$.k')]
         WHEN 2 THEN ['text'] ELSE CAST([] AS VARCHAR[]) END AS items FROM events"""
)
def json_flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that is a number, an array, a string or an object, by turns."""
    m, k = F.col("event_id") % 4, F.get_json_object("props", "$.k")
    raw = (
        F.when(m == 0, F.concat(F.lit('{"x": '), k, F.lit("}"))).when(m == 1, F.concat(F.lit('{"x": ["a", '), k, F.lit(', " "]}')))
        .when(m == 2, F.lit('{"x": " text "}')).otherwise(F.lit('{"x": {"k": 1}}'))
    )
    return table(spark, sf_dir, "events").select("event_id", flexible_list(raw, "$.x").alias("items"))
