"""Queries on joins, listings, counts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import pack, relations
from quire.queries import query, table
from quire.queries.texts import LINES_SQL, lines


def _listed(ordered: DataFrame) -> DataFrame:
    """``position`` from 1: where a listing has each row, in the order the operator gave it."""
    placed = ordered.withColumn("_m", F.monotonically_increasing_id())
    return placed.withColumn("position", F.row_number().over(Window.orderBy("_m")).cast("long"))  # one listing, one task


@query(
    "WITH "
    + LINES_SQL
    + """ SELECT (SELECT count(*) FROM documents) AS chapters, (SELECT count(*) FROM lines) AS paragraphs, (SELECT count(*) FILTER (length(line) > 200) FROM lines) AS long_paragraphs"""
)
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lines(spark, sf_dir)
    return relations.counts({"chapters": table(spark, sf_dir, "documents"), "paragraphs": p, "long_paragraphs": p.where(F.char_length("line") > 200)})


@query("WITH " + LINES_SQL + " SELECT d.doc_id AS id, d.lang AS title, count(l.pos) AS paragraph_count FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY 1, 2")
def q_inspect_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"))
    return relations.chapter_overview(chapters, lines(spark, sf_dir).withColumnRenamed("doc_id", "chapter_id"))


@query("SELECT o_orderkey AS run_id, o_orderdate AS imported_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def q_last_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("imported_at"))
    return relations.last_import(runs)


@query("SELECT lower(s_name) AS name, s_suppkey AS id, row_number() OVER (ORDER BY lower(n_name), lower(s_name), s_suppkey) AS position FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q_entities_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    e = s.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("type"), F.col("s_name").alias("canonical_name"), F.lit("x").alias("chapter_id"))
    return _listed(relations.entities_in_order(e)).select(F.lower("canonical_name").alias("name"), "id", "position")


@query(
    """SELECT l_suppkey AS entity_id, l_orderkey AS scene_id, rank FROM (
      SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY o_custkey, l_orderkey) AS rank
      FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey) WHERE rank <= 20"""
)
def q_occurrences_for_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    occ = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("scene_id")).distinct()
    occ = occ.join(o.select(F.col("o_orderkey").alias("scene_id"), F.col("o_custkey").alias("chapter_id")), "scene_id")
    scenes = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ordinal"))
    chapters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ordinal"))
    found = relations.occurrences_for(occ, scenes, chapters)
    return found.select("entity_id", "scene_id", F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT l.doc_id AS record_id, row_number() OVER (ORDER BY CASE WHEN toxic = 1 THEN 0 ELSE 1 END, coalesce(n_chars, 999999), l.doc_id) AS position
    FROM labels l LEFT JOIN (SELECT doc_id, n_chars FROM documents WHERE lang = 'en') d USING (doc_id)"""
)
def jn_left_summary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("ordinal"))
    s = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("record_id"), F.col("doc_id").alias("chapter_id"), F.when(F.col("toxic") == 1, "book_summary").otherwise("chapter_summary").alias("record_type")
    )
    ordered = relations.summaries_in_order(s.join(chapters.withColumnRenamed("id", "chapter_id"), "chapter_id", "left"), chapters.select("id", "ordinal"))
    return _listed(ordered).select("record_id", "position")


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS chapters, count(*) FILTER (quality = 0) AS books FROM labels")
def q_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("quality") == 1, "chapter_summary").otherwise("book_summary")
    return relations.summary_counts(table(spark, sf_dir, "labels").select(kind.alias("record_type")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn_semi_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.keep_known(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn_anti_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id AS id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn_anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities, labels as occurrences: those that never occur go."""
    entities = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return relations.drop_orphans(entities, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity_id")))


@query(
    """WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
    SELECT o_orderkey AS scene_id, n AS ordinal, l_partkey AS id FROM orders JOIN l ON l_orderkey = o_orderkey
    WHERE n BETWEEN 1 + o_orderkey % 2 AND 3 + o_orderkey % 3 AND m >= 3 + o_orderkey % 3"""
)
def jn_range_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of orders within a range of places whose ends exist."""
    key = F.col("o_orderkey")
    scenes = table(spark, sf_dir, "orders").select(
        key.alias("id"), key.alias("chapter_id"), F.concat_ws("-", key, 1 + key % 2).alias("paragraph_start"), F.concat_ws("-", key, 3 + key % 3).alias("paragraph_end")
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chapter_id"), F.row_number().over(w).alias("ordinal"), F.col("l_partkey").alias("part"))
    p = p.withColumn("id", F.concat_ws("-", "chapter_id", "ordinal"))
    return relations.scene_paragraphs(scenes, p).select("scene_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("part").alias("id"))


@query(
    """WITH cited AS (SELECT o_orderkey AS scene_id, unnest([o_orderkey % 7, o_orderkey % 5, o_orderkey % 7, o_orderkey % 3]) AS id, generate_subscripts([1, 2, 3, 4], 1) - 1 AS position FROM orders)
    SELECT scene_id, id, min(position)::INTEGER AS position, any_value(n_name) AS name FROM cited JOIN nation ON n_nationkey = id GROUP BY scene_id, id"""
)
def jn_evidence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cards = table(spark, sf_dir, "orders").select(k.alias("scene_id"), F.array(k % 7, k % 5, k % 7, k % 3).alias("evidence"))
    return relations.evidence_rows(cards, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))


@query(
    """WITH refs AS (SELECT n_nationkey AS r, unnest([' p-' || n_nationkey, 'ch-' || n_regionkey, 'p-' || n_nationkey, 'x']) AS ref, generate_subscripts([1, 2, 3, 4], 1) - 1 AS position FROM nation),
    own AS (SELECT r, position, 0 AS i, trim(ref) AS id FROM refs WHERE starts_with(trim(ref), 'p-')),
    chapters AS (SELECT 'ch-' || r_regionkey AS ref, unnest(['p-a' || r_regionkey, 'p-b' || r_regionkey]) AS id, generate_subscripts([1, 2], 1) - 1 AS i FROM region),
    every AS (SELECT * FROM own UNION ALL SELECT r, position, i, chapters.id FROM refs JOIN chapters USING (ref))
    SELECT 's' || r AS record_id, id, arg_min(position, position * 100 + i)::INTEGER AS position, arg_min(i, position * 100 + i)::INTEGER AS inner_position FROM every GROUP BY r, id
    UNION ALL SELECT 'c' || r_regionkey, unnest(['p-a' || r_regionkey, 'p-b' || r_regionkey]), unnest([0, 1]), 0 FROM region"""
)
def jn_summary_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What summaries cite: paragraphs themselves, and chapters through their summaries' paragraphs."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    p = F.concat(F.lit("p-"), "n_nationkey")
    book = n.select(
        F.concat(F.lit("s"), "n_nationkey").alias("record_id"), F.lit("book_summary").alias("record_type"), F.lit(None).cast("string").alias("chapter_id"),
        F.array(F.concat(F.lit(" "), p), F.concat(F.lit("ch-"), "n_regionkey"), p, F.lit("x")).alias("evidence"),
    )
    own = r.select(
        F.concat(F.lit("c"), "r_regionkey").alias("record_id"), F.lit("chapter_summary").alias("record_type"), F.concat(F.lit("ch-"), "r_regionkey").alias("chapter_id"),
        F.array(F.concat(F.lit("p-a"), "r_regionkey"), F.concat(F.lit("p-b"), "r_regionkey")).alias("evidence"),
    )
    return relations.unresolved_summary_refs(book.unionByName(own)).select("record_id", "id", "position", F.col("inner").alias("inner_position"))


@query("WITH " + LINES_SQL + " SELECT doc_id AS chapter_id, pos::INTEGER AS ordinal, line FROM lines WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE n_chars > 2000)")
def q_paragraphs_by_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "documents").where("n_chars > 2000").agg(F.min("doc_id")).first()[0]
    p = lines(spark, sf_dir).select(F.col("doc_id").alias("chapter_id"), F.col("pos").alias("ordinal"), "line")
    return relations.paragraphs_of(p, first)


@query("SELECT c_custkey AS id, c_nationkey AS ordinal, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS position FROM customer")
def q_all_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("ordinal"))
    return _listed(relations.chapters_in_order(c)).select("id", "ordinal", "position")


@query("WITH " + LINES_SQL + ", f AS (SELECT min(doc_id) AS d FROM documents WHERE n_chars > 2000) SELECT doc_id AS chapter_id, pos::INTEGER AS ordinal FROM lines, f WHERE doc_id = d AND pos BETWEEN 2 AND 5")
def q_paragraphs_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "documents").where("n_chars > 2000").agg(F.min("doc_id")).first()[0]
    p = lines(spark, sf_dir).select(F.col("doc_id").alias("chapter_id"), F.col("pos").alias("ordinal"))
    return relations.paragraphs_in_range(p, first, 2, 5)


@query(
    """WITH u AS (SELECT doc_id::VARCHAR AS id, 0 AS src, doc_id AS position FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id::VARCHAR, 1, doc_id FROM labels WHERE quality = 1)
    SELECT id, min(src)::INTEGER AS source_rank FROM u GROUP BY id"""
)
def set_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: table(spark, sf_dir, "labels").where(c).select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("position"))
    return pack.ordered_union([part("toxic = 1"), part("quality = 1")], "id", "position").select("id", "source_rank")


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents),
    f AS (SELECT doc_id, trim(s, ' ' || chr(10) || chr(9) || chr(13)) AS s, min(i) AS i FROM p WHERE trim(s, ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY 1, 2)
    SELECT d.doc_id, sha256(coalesce(string_agg(s, '|' ORDER BY i), '')) AS items_sha256, count(s) AS n FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""
)
def set_clean_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.clean_list(F.split("text", r"\.", -1)).alias("items"))
    return d.select("doc_id", F.sha2(F.array_join("items", "|"), 256).alias("items_sha256"), F.size("items").cast("long").alias("n"))


@query("SELECT c_custkey AS id, array_to_string(list_sort(list_distinct([c_mktsegment, n_name, c_mktsegment])), chr(0)) AS source_key FROM customer JOIN nation ON c_nationkey = n_nationkey")
def set_source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("id"), tx.source_key(F.array("c_mktsegment", "n_name", "c_mktsegment")).alias("source_key"))


@query(
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'verified' ELSE 'generated' END AS status FROM labels
    WHERE CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'verified' ELSE 'generated' END IN ('verified', 'accepted', 'generated')"""
)
def q_status_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "verified").otherwise("generated")
    return relations.with_status(table(spark, sf_dir, "labels").select("doc_id", status.alias("status")), "include-generated")


def _occurring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as entities of their nations, line items as occurrences in orders."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("chapter_id"))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("scene_id")).distinct()
    return e, o.join(e.select(F.col("id").alias("entity_id"), "chapter_id"), "entity_id")


@query("SELECT DISTINCT s_suppkey AS id, s_nationkey AS chapter_id FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_orderkey % 50 = 0")
def snk_delete_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities left after all orders but every fiftieth are deleted."""
    e, o = _occurring(spark, sf_dir)
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("scene_id"))
    return relations.without_scenes({"entities": e, "occurrences": o}, gone)["entities"]


@query(
    """SELECT DISTINCT s_suppkey AS id, s_nationkey AS chapter_id FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey NOT IN (3, 4)
    UNION ALL SELECT -s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (3, 4) AND s_suppkey % 2 = 0"""
)
def snk_replace_entity_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nations' entities replaced; of the new ones every other occurs."""
    e, o = _occurring(spark, sf_dir)
    fresh = e.where("chapter_id in (3, 4)").select((-F.col("id")).alias("id"), "chapter_id")
    met = fresh.where("id % 2 = 0").select(F.col("id").alias("entity_id"), F.lit(1).cast(o.schema["scene_id"].dataType).alias("scene_id"), "chapter_id")
    return relations.replace_chapters(e, o, fresh, met, fresh)[0]
