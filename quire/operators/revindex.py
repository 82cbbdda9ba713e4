"""Literal reverse index of scene-card fields.

Terms are taken as they are written: no trimming, no case folding; only JSON
strings count, alone or in arrays; empty ones don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import once
from quire.operators.pack import dealt
from quire.schemas import TERM_FIELDS

REF_KEY = ["term_type", "term", "scene_id", "source_field", "raw_value"]


def literal_strings(parsed: Column, field: str) -> Column:
    """The string values of a field of a parsed JSON object: itself, or the strings of its array."""
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    one = F.when(F.schema_of_variant(value) == "STRING", F.array(F.try_variant_get(value, "$", "string")))
    items = F.try_variant_get(value, "$", "array<variant>")
    many = F.transform(
        F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")
    )
    return F.filter(F.coalesce(one, many, F.array().cast("array<string>")), lambda x: x != "")


def refs(cards: DataFrame, scene_col: str = "scene_id", chapter_col: str = "chapter_id", raw_col: str = "raw_json") -> DataFrame:
    """One row for each distinct (type, term, scene, field, value); each card is parsed once."""

    def of_field(parsed: Column, kind: str, field: str) -> Column:
        return F.transform(
            literal_strings(parsed, field),
            lambda x: F.struct(F.lit(kind).alias("term_type"), x.alias("term"), F.lit(field).alias("source_field"), x.alias("raw_value")),
        )

    found = once(F.try_parse_json("_raw"), lambda v: F.flatten(F.array(*[of_field(v, kind, field) for kind, field in TERM_FIELDS])))
    # cards are dealt, not their references: all of one scene are in one task, and each task sorts few
    each = dealt(cards.select(F.col(scene_col).alias("scene_id"), F.col(chapter_col).alias("chapter_id"), F.col(raw_col).alias("_raw")), "scene_id")
    rows = each.select("scene_id", "chapter_id", F.explode(found).alias("r"))
    out = rows.select("r.term_type", "r.term", "scene_id", "chapter_id", "r.source_field", F.lit(1.0).alias("weight"), "r.raw_value")
    return out.dropDuplicates(REF_KEY)


def terms(index: DataFrame, distinct: bool = False) -> DataFrame:
    """(term_type, term, occurrence_count) of distinct references; ``distinct`` says that they are already."""
    rows = index if distinct else index.dropDuplicates(REF_KEY)
    return rows.groupBy("term_type", "term").agg(F.count("*").alias("occurrence_count"))


def find_terms(all_terms: DataFrame, prefix: str = "", term_type: str | None = None, limit: int = 50) -> DataFrame:
    """Terms that start with a prefix as written, in order."""
    found = all_terms.where(F.col("term").startswith(prefix)) if prefix else all_terms
    if term_type:
        found = found.where(F.col("term_type") == term_type)
    return found.orderBy("term_type", "term").limit(limit)


def find_refs(index: DataFrame, term: str, term_type: str | None = None) -> DataFrame:
    """References of one term, exactly as written."""
    found = index.where(F.col("term") == term)
    return found.where(F.col("term_type") == term_type) if term_type else found


def inspect(index: DataFrame, term: str, term_type: str | None = None, limit: int = 50) -> tuple[str, DataFrame]:
    """("refs", exact references) if there are any, else ("terms", terms with that prefix)."""
    exact = find_refs(index, term, term_type)
    return ("refs", exact) if not exact.isEmpty() else ("terms", find_terms(terms(index), term, term_type, limit))


def in_order(index: DataFrame, scenes: DataFrame, chapters: DataFrame) -> DataFrame:
    """References in manuscript order, then by type, field, term and value."""
    s = scenes.select(F.col("id").alias("scene_id"), F.col("ordinal").alias("_so"))
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("ordinal").alias("_co"))
    placed = index.join(s, "scene_id").join(c, "chapter_id")
    return placed.orderBy("_co", "_so", "term_type", "source_field", "term", "raw_value").drop("_co", "_so")
