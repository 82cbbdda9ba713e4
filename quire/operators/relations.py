"""Lookups, counts and ordered listings over the relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import uni_trim
from quire.schemas import TRUSTED


def chapter_overview(chapters: DataFrame, paragraphs: DataFrame, chapter: str | None = None) -> DataFrame:
    """Chapters with ``paragraph_count``; one, if named."""
    some = chapters if chapter is None else chapters.where(F.col("id") == chapter)
    counts = paragraphs.groupBy("chapter_id").agg(F.count("*").alias("paragraph_count"))
    joined = some.join(counts, some["id"] == counts["chapter_id"], "left").drop("chapter_id")
    return joined.withColumn("paragraph_count", F.coalesce("paragraph_count", F.lit(0)))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows each table has."""
    each = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(DataFrame.crossJoin, each)  # one row each


def chapters_in_order(chapters: DataFrame) -> DataFrame:
    return chapters.orderBy("ordinal", "id")


def paragraphs_of(paragraphs: DataFrame, chapter: str) -> DataFrame:
    """A chapter's paragraphs in order."""
    return paragraphs.where(F.col("chapter_id") == chapter).orderBy("ordinal")


def by_id(df: DataFrame, value: str, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == value.strip())


def last_import(imports: DataFrame) -> DataFrame:
    return imports.orderBy(F.desc("imported_at"), F.desc("run_id")).limit(1)


def scenes_in_order(scenes: DataFrame, chapters: DataFrame) -> DataFrame:
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("ordinal").alias("chapter_ordinal"))
    return scenes.join(c, "chapter_id").orderBy("chapter_ordinal", "ordinal")


def with_status(cards: DataFrame, policy: str = "trusted-only") -> DataFrame:
    """Cards a policy lets through; an unknown policy is trusted-only."""
    allowed = (*TRUSTED, "generated") if policy == "include-generated" else TRUSTED
    return cards.where(F.lower(uni_trim(F.coalesce("status", F.lit("")))).isin(*allowed))


def cards_in_order(cards: DataFrame, scenes: DataFrame, chapters: DataFrame, policy: str, chapter: str | None = None) -> DataFrame:
    """Cards let through, in manuscript order (``chapter_ordinal``, ``scene_ordinal``)."""
    s = scenes.select(F.col("id").alias("scene_id"), F.col("chapter_id").alias("_c"), F.col("ordinal").alias("scene_ordinal"))
    c = chapters.select(F.col("id").alias("_c"), F.col("ordinal").alias("chapter_ordinal"))
    found = with_status(cards.drop("chapter_id"), policy).join(s, "scene_id").join(c, "_c").withColumnRenamed("_c", "chapter_id")
    found = found.where(F.col("chapter_id") == chapter) if chapter else found
    return found.orderBy("chapter_ordinal", "scene_ordinal")


def paragraphs_in_range(paragraphs: DataFrame, chapter: str, first: int, last: int) -> DataFrame:
    return paragraphs.where((F.col("chapter_id") == chapter) & F.col("ordinal").between(first, last)).orderBy("ordinal")


def scene_paragraphs(scenes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(scene_id, paragraph columns): paragraphs within each scene's range."""
    p = paragraphs.select("chapter_id", F.col("id").alias("_id"), F.col("ordinal").alias("_o"))
    ends = (
        scenes.select(F.col("id").alias("scene_id"), "chapter_id", "paragraph_start", "paragraph_end")
        .join(p.select("chapter_id", F.col("_id").alias("paragraph_start"), F.col("_o").alias("_a")), ["chapter_id", "paragraph_start"])
        .join(p.select("chapter_id", F.col("_id").alias("paragraph_end"), F.col("_o").alias("_b")), ["chapter_id", "paragraph_end"])
        .select("scene_id", "chapter_id", "_a", "_b")
    )
    # the chapter is the join key; the range is checked within it
    return ends.join(paragraphs, "chapter_id").where(F.col("ordinal").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def entities_in_order(entities: DataFrame, chapter: str | None = None) -> DataFrame:
    some = entities.where(F.col("chapter_id") == chapter) if chapter else entities
    return some.orderBy(F.lower("type"), F.lower("canonical_name"), "id")


def occurrences_for(occurrences: DataFrame, scenes: DataFrame, chapters: DataFrame, limit: int = 20) -> DataFrame:
    """The first occurrences of each entity in manuscript order."""
    s = scenes.select(F.col("id").alias("scene_id"), F.col("ordinal").alias("_so"))
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("ordinal").alias("_co"))
    w = Window.partitionBy("entity_id").orderBy("_co", "_so", "scene_id")
    placed = occurrences.join(s, "scene_id").join(c, "chapter_id").withColumn("rank", F.row_number().over(w))
    return placed.where(F.col("rank") <= limit).drop("_so", "_co")


def summaries_in_order(summaries: DataFrame, chapters: DataFrame, chapter: str | None = None) -> DataFrame:
    """The book first, then chapters in order; ``position`` tells the rank keys."""
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("ordinal").alias("_o"))
    some = summaries.where(F.col("chapter_id") == chapter) if chapter else summaries
    first = F.when(F.col("record_type") == "book_summary", 0).otherwise(1)
    return some.join(c, "chapter_id", "left").orderBy(first, F.coalesce("_o", F.lit(999999)), "chapter_id", "record_id").drop("_o")


def summary_id(target: str) -> str:
    """Record id that a target names: book, book_summary, a chapter, or an id itself."""
    bare = target.strip()
    if bare in ("book", "book_summary"):
        return "book_summary"
    return bare if bare.startswith("chapter_summary:") else f"chapter_summary:{bare}"


def summary_counts(summaries: DataFrame) -> DataFrame:
    kind = F.col("record_type")
    return summaries.agg(
        F.count("*").alias("total"), F.count_if(kind == "chapter_summary").alias("chapters"), F.count_if(kind == "book_summary").alias("books")
    )


def drop_orphans(entities: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Entities that occur somewhere."""
    return entities.join(occurrences.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi")


def without_scenes(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after scenes (scene_id) were deleted: their cards and occurrences go, entities left without any, and the whole reverse index."""
    ids = gone.select("scene_id").distinct()
    out = {name: tables[name].join(ids, "scene_id", "left_anti") for name in ("scene_cards", "occurrences") if name in tables}
    if "scenes" in tables:
        out["scenes"] = tables["scenes"].join(ids, F.col("id") == F.col("scene_id"), "left_anti")
    if "entities" in tables and "occurrences" in out:
        out["entities"] = drop_orphans(tables["entities"], out["occurrences"])
    for name in ("index_refs", "index_terms"):
        if name in tables:
            out[name] = tables[name].limit(0)
    return tables | out


def replace_chapters(entities: DataFrame, occurrences: DataFrame, fresh_entities: DataFrame, fresh_occurrences: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and occurrences with those of some chapters (chapter_id) replaced; entities that then occur nowhere go."""
    ids = chapters.select("chapter_id").distinct()
    o = occurrences.join(ids, "chapter_id", "left_anti").unionByName(fresh_occurrences)
    e = entities.join(ids, "chapter_id", "left_anti").unionByName(fresh_entities)
    return drop_orphans(e, o), o


def keep_known(cited: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Citations that name a known record, in order and as often as they came."""
    return cited.join(known.select(column).distinct(), column, "left_semi")


def first_citations(cited: DataFrame, by: str, column: str, position: str) -> DataFrame:
    """Each cited record once, where it came first."""
    w = Window.partitionBy(by, column).orderBy(position)
    return cited.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def evidence_rows(cards: DataFrame, paragraphs: DataFrame, by: str = "scene_id") -> DataFrame:
    """Paragraphs that cards cite, each once for a card, ``position`` from 0."""
    cited = cards.select(by, F.posexplode("evidence").alias("position", "id"))
    return first_citations(cited, by, "id", "position").join(paragraphs, "id")


def unresolved_summary_refs(summaries: DataFrame) -> DataFrame:
    """(record_id, position, id): paragraph ids that summaries cite, chapters' ids made theirs."""
    cited = summaries.select("record_id", "record_type", "chapter_id", F.posexplode("evidence").alias("position", "ref"))
    cited = cited.withColumn("ref", F.trim("ref"))
    own = cited.where(F.col("ref").startswith("p-"))
    chapter = own.where("record_type = 'chapter_summary' and chapter_id is not null").select(
        F.col("chapter_id").alias("ref"), F.col("position").alias("inner"), F.col("ref").alias("id")
    )
    direct = own.select("record_id", "position", F.lit(0).alias("inner"), F.col("ref").alias("id"))
    through = cited.where(F.col("ref").startswith("ch-")).select("record_id", "position", "ref").join(chapter, "ref").select("record_id", "position", "inner", "id")
    every = direct.unionByName(through)
    w = Window.partitionBy("record_id", "id").orderBy("position", "inner")
    return every.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
