"""The layers that are built over paragraphs, each a function of frames.

Scene cards, entities, roles and summaries ask a model; what is built here is
all around that call: prompts, checks of what it cites, retries, fallbacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.jsonvals import flexible_list, json_evidence, json_list, json_text, salvage
from quire.functions.text import clamp_unit, clean_list, cut_at_word, derived_title, excluding, first_sentence, normalize_entity_type, source_key, stable_id, strip_fences
from quire.operators import pack
from quire.operators.relations import scene_paragraphs
from quire.plans.planner import role_priority
from quire.sources.aside import Aside
from quire.sources.provider import Provider, attempt, generate

CARD_SYSTEM = "Describe the scene as one JSON object: title, summary, evidence, themes, entities, participants, pov, locations, unresolved."
SUMMARY_SYSTEM = "Summarise as one JSON object: summary, themes, unresolved, evidence."


def joined_lines(df: DataFrame, by: list[str], order: str, line: Column, name: str = "user") -> DataFrame:
    """One text for each group: its lines in order."""
    met = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_l"))
    return met.select(*by, F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias(name))


def scene_prompts(scenes: DataFrame, paragraphs: DataFrame, compact: bool = False) -> DataFrame:
    """(scene_id, chapter_id, user): paragraphs with their ids; compact ones for a retry after a timeout."""
    rows = scene_paragraphs(scenes, paragraphs)
    if compact:
        rows = pack.head_tail(rows, ["scene_id"], [F.col("ordinal")])
        text = F.when(F.char_length("text") > 600, F.concat(cut_at_word(F.col("text"), 600), F.lit("..."))).otherwise(F.col("text"))
        rows = rows.withColumn("text", text)
    return joined_lines(rows, ["scene_id", "chapter_id"], "ordinal", F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("text")))


def parse_cards(answers: DataFrame) -> DataFrame:
    """Model answers as card columns, whatever shapes the fields came in."""
    body = strip_fences(F.col("content"))
    value = F.try_parse_json(body)

    def part(name: str) -> Column:
        return F.to_json(F.try_variant_get(value, f"$.{name}", "variant"))

    cut = F.try_parse_json(body).isNull()
    return answers.withColumns(
        {
            "summary": json_text(part("summary")),
            "title": json_text(part("title")),
            "evidence": json_evidence(part("evidence")),
            "truncated": cut,
            "raw_json": body,
        }
    )


class ExtractionError(ValueError):
    """A strict run met a scene whose card couldn't be made."""


def scene_cards(scenes: DataFrame, paragraphs: DataFrame, provider: Provider, model: str = "", on_failure: str = "fallback") -> DataFrame:
    """(scene_id, chapter_id, title, summary, evidence, status, action) for every scene.

    Evidence must lie in the scene.  An answer without any is asked for once
    more, with a compact prompt if the model timed out.  A scene that fails
    again gets a card of its first sentence ("fallback"), one that is marked
    skipped ("skip"), or is an error ("strict").
    """
    member = scene_paragraphs(scenes, paragraphs).select("scene_id", "id", "ordinal", "text")

    def ask(items: DataFrame, number: int, last: DataFrame | None) -> DataFrame:
        prompts = scene_prompts(items, paragraphs).withColumn("action", F.lit("none" if number == 1 else "retry"))
        if last is not None:
            late = last.where(F.col("error").startswith("timeout")).select("scene_id")
            short = scene_prompts(items.join(late, "scene_id", "left_semi"), paragraphs, compact=True).withColumn("action", F.lit("compact-retry"))
            prompts = prompts.join(late, "scene_id", "left_anti").unionByName(short)
        return supported(parse_cards(generate(prompts, provider, "scene-card", CARD_SYSTEM, model)), member)

    def fallback(items: DataFrame) -> DataFrame:
        first = items.select(F.col("id").alias("scene_id"), "chapter_id").join(member, "scene_id").where(F.trim("text") != "")
        text = first.groupBy("scene_id", "chapter_id").agg(F.min_by(F.struct("id", "text"), "ordinal").alias("p"))
        summary = first_sentence(F.col("p.text"), 240)
        return text.select("scene_id", "chapter_id", derived_title(summary, F.concat(F.lit("Scene "), F.col("scene_id"))).alias("title"), summary.alias("summary"), F.array("p.id").alias("evidence"))

    items = scenes.withColumn("scene_id", F.col("id"))
    good = (F.size("evidence") > 0) & (F.trim("summary") != "")
    done = attempt(items, ["scene_id"], ask, good, fallback)
    failed = F.col("action") == "fallback"
    if on_failure == "strict":
        bad = done.where(failed).select("scene_id").orderBy("scene_id").limit(1).collect()
        if bad:
            raise ExtractionError(f"no card of {bad[0]['scene_id']}")
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.trim("title")).otherwise(derived_title(F.col("summary"), F.concat(F.lit("Scene "), F.col("scene_id"))))
    status = F.when(failed, "skipped").otherwise("generated") if on_failure == "skip" else F.lit("generated")
    fields = {n: json_list(F.to_json(F.try_variant_get(F.try_parse_json("raw_json"), f"$.{n}", "variant"))) for n in ("participants", "unresolved")}
    made = done.withColumns({n: F.coalesce(v, F.array().cast("array<string>")) for n, v in fields.items()})
    return made.select("scene_id", "chapter_id", title.alias("title"), "summary", "evidence", "participants", "unresolved", status.alias("status"), "action", "raw_json")


def supported(cards: DataFrame, member: DataFrame, by: str = "scene_id") -> DataFrame:
    """Cards whose evidence keeps only what lies in their scene, in order."""
    cited = cards.select(by, F.posexplode("evidence").alias("_at", "id")).join(member.select(by, "id"), [by, "id"])
    kept = cited.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"]).alias("_kept"))
    return cards.join(kept, by, "left").withColumn("evidence", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")


def entities_from(answers: DataFrame, refs: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, occurrences) from answers (chapter_id, content).

    A whole answer or the whole objects of one that was cut off; an occurrence
    must be in a scene of the chapter and say something its references say.
    """
    body = strip_fences(F.col("content"))
    kind = "struct<name:string,canonical_name:string,type:string,aliases:array<string>,occurrences:array<struct<scene_id:string,surface_texts:array<string>,source_fields:array<string>,confidence:double>>>"
    rows = answers.select("chapter_id", F.explode(salvage(body, "entities")).alias("o")).select("chapter_id", F.from_json("o", kind).alias("e"))
    name = F.trim(F.coalesce(F.when(F.trim("e.canonical_name") != "", F.col("e.canonical_name")), F.col("e.name"), F.lit("")))
    named = rows.select("chapter_id", name.alias("canonical_name"), normalize_entity_type(F.col("e.type")).alias("type"), F.col("e.aliases").alias("aliases"), F.col("e.occurrences").alias("occ"))
    named = named.where("canonical_name <> ''").withColumn("id", stable_id("entity", F.col("chapter_id"), F.col("type"), F.lower("canonical_name")))
    known = scenes.select("chapter_id", F.col("id").alias("scene_id"))
    surface = refs.select("scene_id", F.lower(F.trim("raw_value")).alias("_key")).distinct()
    seen = named.select("id", "chapter_id", F.explode("occ").alias("x")).select("id", "chapter_id", "x.*").join(known, ["chapter_id", "scene_id"])
    said = seen.withColumn("s", F.explode(clean_list(F.col("surface_texts")))).withColumn("_key", F.lower("s")).join(surface, ["scene_id", "_key"])
    confidence = clamp_unit(F.coalesce(F.max("confidence"), F.lit(0.8)))
    occurrences = said.groupBy(F.col("id").alias("entity_id"), "chapter_id", "scene_id").agg(
        F.array_sort(F.collect_set("s")).alias("surface_texts"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("source_fields", F.array().cast("array<string>"))))).alias("source_fields"), confidence.alias("confidence")
    )
    live = named.join(occurrences.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi")
    first = live.groupBy("id", "chapter_id").agg(
        F.first("canonical_name").alias("canonical_name"), F.first("type").alias("type"), F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")
    )
    return first.select("id", "chapter_id", "type", "canonical_name", excluding(F.col("a"), F.col("canonical_name")).alias("aliases"), F.lit("generated").alias("status")), occurrences


def role_violations(roles: DataFrame, entities: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(character_id, problem): entities without or with several roles, foreign evidence, bare principals."""
    used = roles.select("character_id", F.explode("source_entity_ids").alias("id"))
    people = entities.where(F.col("type") == "character")
    missing = people.join(used, "id", "left_anti").select(F.lit(None).cast("string").alias("character_id"), F.concat(F.lit("entity without a role: "), F.col("id")).alias("problem"))
    twice = used.groupBy("id").agg(F.min("character_id").alias("character_id"), F.count("*").alias("n")).where("n > 1").select("character_id", F.concat(F.lit("entity in several roles: "), F.col("id")).alias("problem"))
    unknown = used.join(people, "id", "left_anti").select("character_id", F.concat(F.lit("unknown entity: "), F.col("id")).alias("problem"))
    linked = used.join(occurrences.select(F.col("entity_id").alias("id"), "scene_id"), "id").select("character_id", "scene_id").distinct()
    cited = roles.select("character_id", F.explode("evidence").alias("e")).select("character_id", F.col("e.scene_id").alias("scene_id"))
    foreign = cited.join(linked, ["character_id", "scene_id"], "left_anti").select("character_id", F.lit("evidence of a scene it isn't in").alias("problem"))
    bare = roles.where((role_priority(F.col("classification")) == 0) & ((F.trim(F.coalesce("rationale", F.lit(""))) == "") | (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)))
    return missing.unionByName(twice).unionByName(unknown).unionByName(foreign).unionByName(bare.select("character_id", F.lit("principal without rationale or evidence").alias("problem")))


def stable_roles(fresh: DataFrame, before: DataFrame) -> DataFrame:
    """Roles with the ids that the same sets of entities had before."""
    old = before.select(source_key(F.col("source_entity_ids")).alias("_key"), F.col("character_id").alias("_old"))
    key = source_key(F.col("source_entity_ids"))
    met = fresh.withColumn("_key", key).join(old, "_key", "left")
    return met.withColumn("character_id", F.coalesce("_old", stable_id("char", F.col("_key")))).drop("_key", "_old")


def chapter_summaries(windows: DataFrame, paragraphs: DataFrame, provider: Provider, model: str = "") -> DataFrame:
    """(chapter_id, summary, themes, unresolved, evidence, action) by windows, then by chapter.

    Windows are (chapter_id, window, first, last) positions of its paragraphs.
    """
    w = Window.partitionBy("chapter_id").orderBy("ordinal")
    placed = paragraphs.withColumn("_pos", F.row_number().over(w))
    inside = windows.join(placed, "chapter_id").where(F.col("_pos").between(F.col("first"), F.col("last")))
    prompts = joined_lines(inside, ["chapter_id", "window"], "_pos", F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("text")))
    aside = Aside(paragraphs.sparkSession, "windows")
    part = aside.keep(generate(prompts, provider, "chapter-window", SUMMARY_SYSTEM, model))
    body = strip_fences(F.col("content"))
    part = part.select("chapter_id", "window", json_text(F.to_json(F.try_variant_get(F.try_parse_json(body), "$.summary", "variant"))).alias("summary"), flexible_list(body, "$.themes").alias("themes"), flexible_list(body, "$.unresolved").alias("unresolved"), flexible_list(body, "$.evidence").alias("evidence"))
    part = supported(part.withColumn("_w", F.concat_ws("|", "chapter_id", "window")), inside.select(F.concat_ws("|", "chapter_id", "window").alias("_w"), "id"), "_w").drop("_w")

    def ask(items: DataFrame, number: int, last: DataFrame | None) -> DataFrame:
        said = part.where("trim(summary) <> ''").join(items.select("chapter_id"), "chapter_id")
        text = joined_lines(said, ["chapter_id"], "window", F.col("summary"))
        answers = generate(text, provider, "chapter-summary", SUMMARY_SYSTEM, model)

        def every(name: str) -> Column:
            rows = F.sort_array(F.collect_list(F.struct("window", F.col(name).alias("v"))))
            return F.array_distinct(F.flatten(F.transform(rows, lambda x: x["v"]))).alias(name)

        joined = said.groupBy("chapter_id").agg(*[every(name) for name in ("themes", "unresolved", "evidence")])
        whole = json_text(F.to_json(F.try_variant_get(F.try_parse_json(body), "$.summary", "variant")))
        return answers.select("chapter_id", whole.alias("summary")).join(joined, "chapter_id")

    def fallback(items: DataFrame) -> DataFrame:
        rows = pack.head(placed.join(items.select("chapter_id"), "chapter_id").where(F.trim("text") != ""), ["chapter_id"], [F.col("_pos")], 2)
        text = joined_lines(rows, ["chapter_id"], "_pos", first_sentence(F.col("text"), 240), "s")
        ids = rows.groupBy("chapter_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "id"))), lambda x: x["id"]).alias("evidence"))
        none = F.array().cast("array<string>")
        return text.join(ids, "chapter_id").select("chapter_id", F.replace("s", F.lit("\n"), F.lit(" ")).alias("summary"), none.alias("themes"), none.alias("unresolved"), "evidence")

    chapters = paragraphs.select("chapter_id").distinct()
    return attempt(chapters, ["chapter_id"], ask, (F.trim("summary") != "") & (F.size("evidence") > 0), fallback)


def support_paragraphs(windows: list[list[str]], cited: list[list[str]], most: int = 3) -> list[str]:
    """Paragraph ids that stand for windows: those cited, at most three a window, else its first new one.

    The choice in a window depends on those before it, so this is a walk over
    the windows of one chapter.
    """
    known = {p for w in windows for p in w}
    seen: dict[str, None] = {}
    for i, window in enumerate(windows):
        valid = [p for p in (cited[i] if i < len(cited) else []) if p in known]
        fresh = [p for p in dict.fromkeys(valid[:most]) if p not in seen]
        fresh = fresh or [p for p in window if p not in seen][:1]
        seen.update(dict.fromkeys(fresh))
    return list(seen)


def book_violations(book: DataFrame, chapters: DataFrame, roles: DataFrame) -> DataFrame:
    """(record_id, problem): chapters a book summary doesn't cite, principals without a final state."""
    cited = book.select("record_id", F.explode("source_records").alias("id"))
    lost = chapters.select(F.col("id")).join(cited.select("id"), "id", "left_anti").select(F.lit("book_summary").alias("record_id"), F.concat(F.lit("chapter not cited: "), F.col("id")).alias("problem"))
    stated = book.select(F.explode("character_final_states").alias("s")).where(F.trim("s.state") != "").select(F.col("s.character_id").alias("character_id"))
    bare = roles.where(role_priority(F.col("classification")) == 0).join(stated, "character_id", "left_anti")
    return lost.unionByName(bare.select(F.lit("book_summary").alias("record_id"), F.concat(F.lit("no final state: "), F.col("character_id")).alias("problem")))
