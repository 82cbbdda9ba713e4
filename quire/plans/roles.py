"""The role layer: which characters of the whole book are principal, and why.

Character entities of all chapters and the scenes they are in make one prompt.
The answer must place every source entity in exactly one role and may cite only
scenes its entities are in; names and aliases come from the entities, ids from
the sets of entities that earlier roles stood for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_list, excluding, redact_ids, source_key, stable_id, strip_fences
from quire.plans.compile import joined_lines, role_violations
from quire.sources.logs import set_hash
from quire.sources.provider import Provider, generate

SYSTEM = "Classify the characters as one JSON object: roles, each with source_entity_ids, canonical_name, classification, role, confidence, rationale, evidence of scene_id and reason."
_ROLE = "struct<source_entity_ids:array<string>,entity_ids:array<string>,canonical_name:string,name:string,classification:string,role:string,confidence:double,rationale:string,evidence:array<struct<scene_id:string,reason:string>>>"
CLASSES = ("principal", "major_supporting", "supporting", "minor", "uncertain")


class RoleError(ValueError):
    """An answer breaks a rule of roles."""


def sources(entities: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(id, chapter_id, canonical_name, aliases, scenes): character entities with the scenes they are in."""
    people = entities.where(F.lower(F.trim("type")) == "character")
    seen = occurrences.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("scene_id")).alias("scenes"))
    none = F.array().cast("array<string>")
    return people.join(seen, "id", "left").select("id", "chapter_id", "canonical_name", clean_list(F.coalesce("aliases", none)).alias("aliases"), F.coalesce("scenes", none).alias("scenes"))


def needed_scenes(found: DataFrame) -> DataFrame:
    """Every scene of a source entity, once, in order."""
    return found.select(F.explode("scenes").alias("scene_id")).distinct().orderBy("scene_id")


def context(found: DataFrame, cards: DataFrame) -> DataFrame:
    """(scene_id, title, summary): cards of the needed scenes, paragraph ids out of their summaries."""
    c = cards.select("scene_id", "title", redact_ids(F.coalesce("summary", F.lit(""))).alias("summary"))
    return needed_scenes(found).join(c, "scene_id", "left")


def input_hash(found: DataFrame, scenes: DataFrame) -> str:
    """One hash of all that the prompt is made of, whatever its order."""
    rows = found.select(F.lit("entity").alias("kind"), F.to_json(F.struct("id", "chapter_id", "canonical_name", "aliases", "scenes")).alias("body"))
    more = scenes.select(F.lit("scene").alias("kind"), F.to_json(F.struct("scene_id", "title", "summary")).alias("body"))
    return "sha256:" + set_hash(rows.unionByName(more), ["kind", "body"])


def is_current(snapshot: dict | None, hashed: str, model: str, prompt_version: str) -> bool:
    """Whether the last commit was made from the same input, model and prompt."""
    return snapshot is not None and (snapshot.get("input_hash"), snapshot.get("model"), snapshot.get("prompt_version")) == (hashed, model, prompt_version)


def prompt(found: DataFrame, scenes: DataFrame) -> DataFrame:
    """(book, user): one row with a line for each entity and scene."""
    people = found.select(
        F.struct(F.lit(0).alias("k"), F.lower("canonical_name").alias("a"), F.col("id").alias("b")).alias("o"),
        F.concat(F.lit("["), "id", F.lit("] "), "canonical_name", F.lit(" ("), F.array_join("aliases", ", "), F.lit(") in "), F.array_join("scenes", ", ")).alias("line"),
    )
    told = scenes.select(
        F.struct(F.lit(1).alias("k"), F.col("scene_id").alias("a"), F.lit("").alias("b")).alias("o"),
        F.concat(F.lit("["), "scene_id", F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("summary", F.lit(""))).alias("line"),
    )
    return joined_lines(people.unionByName(told).withColumn("book", F.lit("book")), ["book"], "o", F.col("line"))


def normalize_class(value: Column) -> Column:
    """A class by its name with any separators; none is uncertain, an unknown one null."""
    v = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")
    return F.when(v == "", "uncertain").when(v.isin(*CLASSES), v)


def chosen_name(name: Column, people: Column) -> Column:
    """The entity name or alias that a given name is, whatever its case; else the first entity's name.

    ``people``: array of structs with canonical_name and aliases, in order.
    """
    said = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.flatten(F.transform(people, lambda p: F.concat(F.array(p["canonical_name"]), p["aliases"])))
    same = F.get(F.filter(known, lambda x: F.lower(x) == said), F.lit(0))
    first = F.get(F.filter(F.transform(people, lambda p: p["canonical_name"]), lambda x: F.trim(x) != ""), F.lit(0))
    return F.coalesce(same, first, F.lit("Unnamed character"))


def from_answer(answer: DataFrame, found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Roles from an answer (content): named after their entities, with ids that stay for the same entities."""
    body = strip_fences(F.col("content"))
    raw = answer.select(F.posexplode(F.from_json(F.get_json_object(body, "$.roles"), f"array<{_ROLE}>")).alias("at", "r")).select("at", "r.*")
    none = F.array().cast("array<string>")
    ids = clean_list(F.concat(F.coalesce("source_entity_ids", none), F.coalesce("entity_ids", none)))
    rows = raw.withColumn("ids", ids)
    people = rows.select("at", F.posexplode("ids").alias("i", "id")).join(found.select("id", "canonical_name", "aliases"), "id")
    grouped = people.groupBy("at").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "canonical_name", "aliases"))), lambda x: F.struct(x["canonical_name"], x["aliases"])).alias("people"))
    met = rows.join(grouped, "at", "left").withColumn("people", F.coalesce("people", F.array().cast("array<struct<canonical_name:string,aliases:array<string>>>")))
    name = chosen_name(F.coalesce(F.when(F.trim("canonical_name") != "", F.col("canonical_name")), F.col("name")), F.col("people"))
    every = F.flatten(F.transform("people", lambda p: F.concat(F.array(p["canonical_name"]), p["aliases"])))
    cited = F.filter(F.coalesce("evidence", F.array().cast("array<struct<scene_id:string,reason:string>>")), lambda e: F.trim(F.coalesce(e["scene_id"], F.lit(""))) != "")
    cited = F.array_distinct(F.transform(cited, lambda e: F.struct(F.trim(e["scene_id"]).alias("scene_id"), F.trim(F.coalesce(e["reason"], F.lit(""))).alias("reason"))))
    out = met.select(
        F.array_sort("ids").alias("source_entity_ids"), name.alias("canonical_name"), excluding(every, name).alias("aliases"), normalize_class(F.col("classification")).alias("classification"),
        F.trim(F.coalesce("role", F.lit(""))).alias("role"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.8)))).alias("confidence"),
        F.trim(F.coalesce("rationale", F.lit(""))).alias("rationale"), cited.alias("evidence"), F.lit("generated").alias("status"),
    )
    key = source_key(F.col("source_entity_ids"))
    fresh = out.withColumn("character_id", stable_id("char", key))
    if before is None:
        return fresh
    old = before.select(source_key(F.col("source_entity_ids")).alias("_key"), F.col("character_id").alias("_old"))
    return fresh.withColumn("_key", key).join(old, "_key", "left").withColumn("character_id", F.coalesce("_old", "character_id")).drop("_key", "_old")


def violations(roles: DataFrame, entities: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(character_id, problem) of all rules, those of classes and reasons included."""
    bad = roles.where("classification is null").select("character_id", F.lit("unknown classification").alias("problem"))
    bare = roles.select("character_id", F.explode("evidence").alias("e")).where("e.reason = ''").select("character_id", F.lit("evidence without a reason").alias("problem"))
    empty = roles.where(F.size("source_entity_ids") == 0).select("character_id", F.lit("role without entities").alias("problem"))
    return role_violations(roles, entities, occurrences).unionByName(bad).unionByName(bare).unionByName(empty)


def compile_roles(
    entities: DataFrame, occurrences: DataFrame, cards: DataFrame, provider: Provider, model: str = "", before: DataFrame | None = None
) -> tuple[DataFrame, dict]:
    """(roles, snapshot): asked once for the book; an answer that breaks a rule is an error."""
    found = sources(entities, occurrences)
    told = context(found, cards)
    hashed = input_hash(found, told)
    answer = generate(prompt(found, told), provider, "roles", SYSTEM, model).select("content").collect()
    spark = entities.sparkSession
    roles = from_answer(spark.createDataFrame([(r["content"],) for r in answer], "content string"), found, before)
    broken = violations(roles, entities, occurrences).orderBy("problem", "character_id").limit(1).collect()
    if broken:
        raise RoleError(f"{broken[0]['character_id']}: {broken[0]['problem']}")
    artifact = set_hash(roles.select(F.to_json(F.struct(*sorted(roles.columns))).alias("r")), ["r"])
    return roles, {"role_count": roles.count(), "input_hash": hashed, "artifact_hash": "sha256:" + artifact, "model": model}
