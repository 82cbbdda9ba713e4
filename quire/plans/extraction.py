"""The entity layer: what a chapter's cards say, consolidated by a model and checked.

A chapter's index references become one prompt; the answer's entities count only
where they occur: in a scene of the chapter, under a name the references hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip_fences
from quire.operators import pack
from quire.plans.compile import entities_from, joined_lines
from quire.sources.provider import Provider, attempt, generate

SYSTEM = "Consolidate the names into entities as one JSON object: entities, each with canonical_name, type, aliases, occurrences of scene_id, surface_texts, source_fields, confidence."
#: Kinds of references that name entities.
TERM_TYPES = ("entity", "participant", "pov", "location")


def chapter_refs(refs: DataFrame, scenes: DataFrame, term_types: tuple[str, ...] = TERM_TYPES) -> DataFrame:
    """References of some kinds with ``position``, their order within the chapter."""
    s = scenes.select(F.col("id").alias("scene_id"), F.col("ordinal").alias("_so"))
    w = Window.partitionBy("chapter_id").orderBy("_so", "scene_id", "term_type", "source_field", "term", "raw_value")
    some = refs.where(F.col("term_type").isin(*term_types)).join(s, "scene_id")
    return pack.dealt(some, "chapter_id").withColumn("position", F.row_number().over(w)).drop("_so")


def by_scene_and_field(refs: DataFrame, by: str = "chapter_id") -> DataFrame:
    """(by, scene_id, scene_rank, source_field, values): scenes in order of first mention, values each once in order."""
    first = refs.groupBy(by, "scene_id", "source_field", F.trim("raw_value").alias("v")).agg(F.min("position").alias("p")).where("v <> ''")
    fields = first.groupBy(by, "scene_id", "source_field").agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("l"), F.min("p").alias("_p"))
    ranked = fields.withColumn("_first", F.min("_p").over(Window.partitionBy(by, "scene_id")))
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy("_first"))
    return ranked.select(by, "scene_id", rank.alias("scene_rank"), "source_field", F.transform("l", lambda x: x["v"]).alias("values"))


def prompts(refs: DataFrame) -> DataFrame:
    """(chapter_id, user): a line for each scene and field, in order."""
    grouped = by_scene_and_field(refs)
    line = F.concat(F.lit("["), F.col("scene_id"), F.lit("] "), F.col("source_field"), F.lit(": "), F.array_join("values", "; "))
    return joined_lines(grouped.withColumn("o", F.struct("scene_rank", "source_field")), ["chapter_id"], "o", line)


def is_whole(content):  # noqa: ANN001, ANN201
    """Whether an answer is JSON that holds a list of entities, or was cut off inside one."""
    body = strip_fences(content)
    listed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.entities", "variant")).startswith("ARRAY")
    return F.coalesce(listed, body.rlike(r'(?s)^\s*\{.*"entities"\s*:\s*\[') & F.try_parse_json(body).isNull())


def compile_entities(refs: DataFrame, scenes: DataFrame, provider: Provider, model: str = "", tries: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, occurrences, snapshots) of all chapters of ``refs``; an answer that can't be read is asked for again."""
    asked = prompts(chapter_refs(refs, scenes))

    def ask(items: DataFrame, number: int, last: DataFrame | None) -> DataFrame:
        return generate(items, provider, "entities", SYSTEM, model).select("chapter_id", "content")

    def fallback(items: DataFrame) -> DataFrame:
        return items.select("chapter_id", F.lit('{"entities": []}').alias("content"))

    answers = attempt(asked, ["chapter_id"], ask, is_whole(F.col("content")), fallback, tries)
    entities, occurrences = entities_from(answers.select("chapter_id", "content"), refs, scenes)
    return entities, occurrences, snapshots(scenes.select("chapter_id").distinct(), entities, occurrences)


def snapshots(chapters: DataFrame, entities: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(chapter_id, entity_count, occurrence_count): what a chapter's commit declares; 0 where it has none."""
    e = entities.groupBy("chapter_id").agg(F.count_distinct("id").alias("entity_count"))
    o = occurrences.groupBy("chapter_id").agg(F.count_distinct("entity_id", "scene_id").alias("occurrence_count"))
    met = chapters.join(e, "chapter_id", "left").join(o, "chapter_id", "left")
    return met.select("chapter_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("entity_count", "occurrence_count")])
