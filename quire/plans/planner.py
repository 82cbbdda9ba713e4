"""From a question to what it asks, and to the evidence packet for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import phrases
from quire.functions.text import contains_any, contains_phrase, normalize_question, once, uni_trim
from quire.operators import pack

BROAD_INTENTS = ("whole_summary", "chapter_summary", "character_inventory", "character_arc", "theme_style", "ending", "broad")
MAX_EVIDENCE = 20
ENTITY_LIMIT, ENTITY_INVENTORY_LIMIT = 6, 24
ROLE_LIMIT, ROLE_INVENTORY_LIMIT = 8, 24
TAIL_CARDS, SPREAD_CARDS, FALLBACK_CARDS = 4, 12, 6


def _mode(mode: Column) -> Column:
    return F.lower(uni_trim(F.coalesce(mode, F.lit(""))))


def is_character_question(q: Column, mode: Column) -> Column:
    return contains_any(q, phrases.CHARACTER) | _mode(mode).isin(*phrases.CHARACTER_MODES)


def intent(question: Column, mode: Column, chapter: Column) -> Column:
    """What a question asks; the first rule that holds."""

    def rules(q: Column) -> Column:
        arc = contains_any(q, phrases.GENERIC_ARC) | (
            contains_any(q, phrases.CHANGE) & (contains_any(q, phrases.HOW_DOES) | contains_any(q, phrases.CHARACTER))
        )
        of_chapter = (F.trim(F.coalesce(chapter, F.lit(""))) != "") | contains_any(q, phrases.CHAPTER)
        summary = contains_any(q, phrases.SUMMARY)
        return (
            F.when(contains_any(q, phrases.ENDING), "ending")
            .when(contains_any(q, phrases.INVENTORY), "character_inventory")
            .when(arc, "character_arc")
            .when(summary & of_chapter, "chapter_summary")
            .when(summary, "whole_summary")
            .when(_mode(mode).isin(*phrases.THEME_MODES) | contains_any(q, phrases.THEME), "theme_style")
            .when(contains_any(q, phrases.BROAD), "broad")
            .when(is_character_question(q, mode), "character_question")
            .otherwise("narrow_recall")
        )

    return once(normalize_question(question), rules)


def is_broad(kind: Column) -> Column:
    return kind.isin(*BROAD_INTENTS)


def paragraph_limit(kind: Column, most: Column) -> Column:
    """Paragraphs to retrieve: more for broad questions."""
    m = F.when(most <= 0, MAX_EVIDENCE).otherwise(most)
    return F.when(is_broad(kind), F.greatest(m * 4, m + 20)).otherwise(m)


def mentioned(q: Column, name: Column) -> Column:
    return contains_phrase(q, normalize_question(name))


def entity_score(q: Column, name: Column, aliases: Column, kind: Column, wants: Column, matched: Column) -> Column:
    """Name 100, one alias 80, a bonus by type for character questions, 60 for a search hit."""
    kind = F.lower(uni_trim(F.coalesce(kind, F.lit(""))))
    bonus = F.when(kind == "character", 20).when(kind.isin("group", "organization"), 8).when(kind == "unknown", 4).otherwise(0)
    return (
        F.when(mentioned(q, name), 100).otherwise(0)
        + F.when(F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: mentioned(q, a)), 80).otherwise(0)
        + F.when(wants, bonus).otherwise(0)
        + F.when(matched, 60).otherwise(0)
    )


def role_priority(classification: Column) -> Column:
    c = F.lower(uni_trim(F.coalesce(classification, F.lit(""))))
    return F.when(c == "principal", 0).when(c == "major_supporting", 1).when(c == "supporting", 2).when(c == "minor", 3).otherwise(4)


def role_score(q: Column, name: Column, aliases: Column, linked: Column, classification: Column, kind: Column) -> Column:
    """Name 100, one alias 80, a linked entity 70, class bonuses for lists and arcs."""
    rank = role_priority(classification)
    return (
        F.when(mentioned(q, name), 100).otherwise(0)
        + F.when(F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: mentioned(q, a)), 80).otherwise(0)
        + F.when(linked, 70).otherwise(0)
        + F.when(kind == "character_inventory", 40 - rank).otherwise(0)
        + F.when((kind == "character_arc") & contains_any(q, phrases.GENERIC_ARC) & (rank <= 1), 25).otherwise(0)
    )


def wants_roles(kind: Column, mode: Column) -> Column:
    return kind.isin("character_inventory", "character_question", "character_arc") | _mode(mode).isin(*phrases.CHARACTER_MODES)


def top_entities(entities: DataFrame, question: str, mode: str, kind: str, matched: list[str]) -> DataFrame:
    """Best entities for a question: by score, name, listing order."""
    q, m = normalize_question(F.lit(question)), F.lit(mode)
    hit = F.col("id").isin(*matched) if matched else F.lit(False)
    scored = entities.withColumn("score", entity_score(q, F.col("canonical_name"), F.col("aliases"), F.col("type"), is_character_question(q, m), hit))
    limit = ENTITY_INVENTORY_LIMIT if kind == "character_inventory" else ENTITY_LIMIT
    return scored.where("score > 0").orderBy(F.desc("score"), F.lower("canonical_name"), F.lower("type"), "id").limit(limit)


def top_roles(roles: DataFrame, entities: DataFrame, question: str, mode: str, kind: str) -> DataFrame:
    """Best roles for a question: by score, class, name; none where roles aren't asked for."""
    q = normalize_question(F.lit(question))
    linked = roles.select("character_id", F.explode("source_entity_ids").alias("id")).join(entities.select("id"), "id").select("character_id").distinct()
    met = roles.join(linked.withColumn("_linked", F.lit(True)), "character_id", "left")
    score = role_score(q, F.col("canonical_name"), F.col("aliases"), F.coalesce("_linked", F.lit(False)), F.col("classification"), F.lit(kind))
    wanted = met.withColumn("score", score).where((F.col("score") > 0) & wants_roles(F.lit(kind), F.lit(mode))).drop("_linked")
    limit = ROLE_INVENTORY_LIMIT if kind == "character_inventory" else ROLE_LIMIT
    return wanted.orderBy(F.desc("score"), role_priority(F.col("classification")), F.lower("canonical_name"), "character_id").limit(limit)


def visible(summaries: DataFrame) -> DataFrame:
    """Summaries with anything to say."""
    return summaries.where((F.trim(F.coalesce("summary", F.lit(""))) != "") | (F.size(F.coalesce("themes", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("unresolved", F.array().cast("array<string>"))) > 0))


def summaries_for(summaries: DataFrame, kind: str, chapter: str) -> DataFrame:
    """The summaries a question of this kind is answered from: one book, or chapters."""
    seen = visible(summaries)
    if chapter:
        seen = seen.where((F.col("record_type") != "chapter_summary") | (F.col("chapter_id") == chapter))
    chapters = seen.where("record_type = 'chapter_summary'")
    book = seen.where("record_type = 'book_summary'").orderBy("record_id").limit(1)
    has_book = not book.isEmpty()
    if kind == "whole_summary":
        return book if has_book else chapters
    prefer_chapters = kind == "chapter_summary" or bool(chapter)
    if prefer_chapters and not chapters.isEmpty():
        return chapters
    if has_book:
        return book
    return chapters if kind in ("character_arc", "theme_style", "broad", "ending") else seen


def wants_coverage_cards(kind: str, has_summary: bool, has_cards: bool) -> bool:
    """Whether cards spread over the whole are added to those that were found."""
    if kind not in BROAD_INTENTS or has_summary:
        return False
    return not has_cards or kind in ("character_inventory", "whole_summary", "broad")


def coverage_cards(cards: DataFrame, kind: str) -> DataFrame:
    """The last cards for the ending, else cards spread over the whole."""
    order = [F.col("chapter_ordinal"), F.col("scene_ordinal")]
    one = cards.withColumn("_all", F.lit(1))
    picked = pack.tail(one, ["_all"], order, TAIL_CARDS) if kind == "ending" else pack.spread(one, ["_all"], order, SPREAD_CARDS)
    return picked.drop("_all")


def fallback_cards(cards: DataFrame, kind: str) -> DataFrame:
    """Cards where search found none: the last ones for the ending, else both ends."""
    order = [F.col("chapter_ordinal"), F.col("scene_ordinal")]
    one = cards.withColumn("_all", F.lit(1))
    picked = pack.tail(one, ["_all"], order, TAIL_CARDS) if kind == "ending" else pack.bookend(one, ["_all"], order, FALLBACK_CARDS)
    return picked.drop("_all")


def pack_paragraphs(found: DataFrame, by: list[str], most: int, kind: Column, fallback: Column) -> DataFrame:
    """At most ``most`` paragraphs of each question, in order of ``position``.

    The last ones for an ending without hits, a spread for broad questions or
    without hits, else the first ones.
    """
    most = most if most > 0 else MAX_EVIDENCE
    w = Window.partitionBy(*by)
    counted = found.withColumns({"_rn": F.row_number().over(w.orderBy("position")), "_n": F.count("*").over(w)})
    j, last = F.col("_rn") - 1, F.col("_n") - 1
    if most == 1:
        spread = F.col("_rn") == 1
    else:
        i = F.floor(j * (most - 1) / last)
        spread = F.exists(F.array(i - 1, i, i + 1), lambda x: (x >= 0) & (x <= most - 1) & (F.round(x * last / F.lit(float(most - 1))) == j))
    keep = (
        F.when(F.col("_n") <= most, True)
        .when((kind == "ending") & fallback, F.col("_rn") > F.col("_n") - most)
        .when(is_broad(kind) | fallback, spread)
        .otherwise(F.col("_rn") <= most)
    )
    return counted.where(keep).drop("_rn", "_n")
