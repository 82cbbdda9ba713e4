"""The book summary: made of the chapters' summaries and the principal roles alone.

The answer must cite every chapter and say how each principal ends.  An answer
that was cut off, or has no text, is replaced by the chapters' first sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.jsonvals import flexible_list, is_truncated, json_text
from quire.functions.text import clean_list, first_sentence, strip_fences
from quire.plans.compile import book_violations, joined_lines
from quire.plans.planner import role_priority
from quire.sources.aside import Aside
from quire.sources.provider import Provider, generate

SYSTEM = "Summarise the book from its chapters as one JSON object: summary, themes, unresolved, evidence (chapter ids), character_final_states of character_id and state."
SENTENCE, PARTS = 260, 3


class SummaryError(ValueError):
    """A book summary breaks a rule."""


def principals(roles: DataFrame) -> DataFrame:
    return roles.where(role_priority(F.col("classification")) == 0)


def prompt(chapters: DataFrame, roles: DataFrame) -> DataFrame:
    """(book, user): chapters in order with their summaries, then the principals."""
    told = chapters.select(F.struct(F.lit(0).alias("k"), F.col("ordinal").cast("long").alias("n"), F.col("chapter_id").alias("i")).alias("o"), F.concat(F.lit("["), "chapter_id", F.lit("] "), "summary").alias("line"))
    people = principals(roles).select(
        F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("n"), F.col("character_id").alias("i")).alias("o"), F.concat(F.lit("["), "character_id", F.lit("] "), "canonical_name").alias("line")
    )
    return joined_lines(told.unionByName(people).withColumn("book", F.lit("book")), ["book"], "o", F.col("line"))


def fallback(chapters: DataFrame, by: str = "book") -> DataFrame:
    """(by, summary, evidence): the first sentences of the first three chapters that have any, and the first three chapters."""
    said = chapters.withColumn("s", first_sentence(F.col("summary"), SENTENCE)).withColumn("_has", F.col("s") != "")
    w = Window.partitionBy(by).orderBy("ordinal", "chapter_id")
    ranked = said.withColumns({"_n": F.row_number().over(w), "_k": F.sum(F.col("_has").cast("int")).over(w)})
    first = ranked.where((F.col("_has") & (F.col("_k") <= PARTS)) | (F.col("_n") <= PARTS))
    part = F.sort_array(F.collect_list(F.when(F.col("_has") & (F.col("_k") <= PARTS), F.struct("_n", "s"))))
    cited = F.sort_array(F.collect_list(F.when(F.col("_n") <= PARTS, F.struct("_n", "chapter_id"))))
    return first.groupBy(by).agg(F.array_join(F.transform(part, lambda x: x["s"]), " ").alias("summary"), F.transform(cited, lambda x: x["chapter_id"]).alias("evidence"))


def final_states(body: Column) -> Column:
    """Clean (character_id, state) pairs of an answer, the first of each character."""
    raw = F.from_json(F.get_json_object(body, "$.character_final_states"), "array<struct<character_id:string,state:string>>")
    none = F.array().cast("array<struct<character_id:string,state:string>>")
    bare = F.transform(F.coalesce(raw, none), lambda x: F.struct(F.trim(F.coalesce(x["character_id"], F.lit(""))).alias("character_id"), F.trim(F.coalesce(x["state"], F.lit(""))).alias("state")))
    full = F.filter(bare, lambda x: (x["character_id"] != "") & (x["state"] != ""))
    return F.filter(full, lambda x, i: ~F.exists(F.slice(full, F.lit(1), i), lambda y: y["character_id"] == x["character_id"]))


def parsed(answers: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, summary, themes, unresolved, evidence, character_final_states, action) of answers (book, content)."""
    body = strip_fences(F.col("content"))
    nested = F.get_json_object(body, "$.book_summary")
    whole = F.when(F.coalesce(F.get_json_object(body, "$.summary"), F.lit("")) == "", F.coalesce(nested, body)).otherwise(body)
    rows = answers.select("book", body.alias("body"), whole.alias("whole"))
    value = F.try_parse_json("whole")
    read = rows.select(
        "book", is_truncated(F.col("body")).alias("cut"), json_text(F.to_json(F.try_variant_get(value, "$.summary", "variant"))).alias("said"),
        *[flexible_list(F.col("whole"), f"$.{n}").alias(n) for n in ("themes", "unresolved")], clean_list(flexible_list(F.col("whole"), "$.evidence")).alias("cited"), final_states(F.col("whole")).alias("character_final_states"),
    )
    spare = fallback(chapters).select("book", F.col("summary").alias("_s"), F.col("evidence").alias("_e"))
    met = read.join(spare, "book", "left")
    none = F.col("cut") | (F.trim(F.coalesce("said", F.lit(""))) == "")
    return met.select(
        "book", F.when(none, F.col("_s")).otherwise(F.trim("said")).alias("summary"), "themes", "unresolved",
        F.when(none & (F.size("cited") == 0), F.col("_e")).otherwise(F.col("cited")).alias("evidence"), "character_final_states", F.when(none, "fallback").otherwise("none").alias("action"),
    )


def compile_book(chapters: DataFrame, roles: DataFrame, provider: Provider, model: str = "", roles_hash: str = "") -> DataFrame:
    """The book's summary row; one that leaves out a chapter or a principal's end is an error.

    ``chapters``: (chapter_id, ordinal, summary) of the chapters' summaries.
    """
    one = chapters.withColumn("book", F.lit("book"))
    told = Aside(chapters.sparkSession, "book").keep(generate(prompt(chapters, roles), provider, "book-summary", SYSTEM, model).select("book", "content"))
    ids = chapters.agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "chapter_id"))), lambda x: x["chapter_id"]).alias("source_records"))
    row = parsed(told, one).join(ids).select(
        F.lit("book_summary").alias("record_id"), F.lit("book_summary").alias("record_type"), F.lit(None).cast("string").alias("chapter_id"), F.lit(None).cast("string").alias("chapter_title"), "summary",
        "themes", "unresolved", "evidence", "source_records", "character_final_states", F.lit(roles_hash).alias("character_roles_hash"), "action", F.lit("generated").alias("status"),
    )
    done = Aside(chapters.sparkSession, "book").keep(row)
    cited = done.select("record_id", F.col("evidence").alias("source_records"), "character_final_states")
    bad = book_violations(cited, chapters.select(F.col("chapter_id").alias("id")), roles).orderBy("problem").limit(1).collect()
    if bad:
        raise SummaryError(bad[0]["problem"])
    return done
