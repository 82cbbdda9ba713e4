"""Schemas of the relations and the enumerations their columns use."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_S, _I, _L, _D, _B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()
_SS = ArrayType(_S)


def _of(**columns: object) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_GENERATED = {"generation_run": _S, "generation_model": _S, "prompt_version": _S, "status": _S}

PROJECTS = _of(project_id=_S, title=_S, language=_S)
IMPORTS = _of(run_id=_S, type=_S, source_path=_S, imported_at=_S, chapters=_I, paragraphs=_I, status=_S)
CHAPTERS = _of(id=_S, ordinal=_I, title=_S, file=_S, source_key=_S)
BLOCKS = _of(chapter_id=_S, ordinal=_I, block_type=_S, paragraph_id=_S)
PARAGRAPHS = _of(
    id=_S, chapter_id=_S, ordinal=_I, block_type=_S, text=_S, text_hash=_S, source_file=_S, source_line_start=_I, source_line_end=_I
)
SCENES = _of(id=_S, chapter_id=_S, paragraph_start=_S, paragraph_end=_S, ordinal=_I, boundary_source=_S, status=_S)
SCENE_CARDS = _of(scene_id=_S, title=_S, summary=_S, evidence=_SS, **_GENERATED, raw_json=_S)
FINAL_STATE = _of(character_id=_S, state=_S)
SUMMARIES = _of(
    record_id=_S, record_type=_S, chapter_id=_S, chapter_title=_S, summary=_S, themes=_SS, unresolved=_SS, evidence=_SS, source_records=_SS,
    character_final_states=ArrayType(FINAL_STATE), generated_at=_S, character_roles_hash=_S, **_GENERATED, raw_json=_S,
)
ENTITIES = _of(id=_S, chapter_id=_S, type=_S, canonical_name=_S, aliases=_SS, evidence=_SS, **_GENERATED, raw_json=_S)
OCCURRENCES = _of(entity_id=_S, chapter_id=_S, scene_id=_S, surface_texts=_SS, source_fields=_SS, confidence=_D, **_GENERATED)
ENTITY_SNAPSHOTS = _of(chapter_id=_S, entity_count=_I, occurrence_count=_I, committed_at=_S)
SCENE_SNAPSHOTS = _of(chapter_id=_S, committed_at=_S)
INDEX_TERMS = _of(term_type=_S, term=_S, occurrence_count=_L)
INDEX_REFS = _of(term_type=_S, term=_S, scene_id=_S, chapter_id=_S, source_field=_S, weight=_D, raw_value=_S)
ROLE_EVIDENCE = _of(scene_id=_S, reason=_S)
ROLES = _of(
    character_id=_S, source_entity_ids=_SS, canonical_name=_S, aliases=_SS, classification=_S, role=_S, confidence=_D, rationale=_S,
    evidence=ArrayType(ROLE_EVIDENCE), status=_S,
)
ROLE_SNAPSHOTS = _of(run_id=_S, role_count=_I, input_hash=_S, artifact_hash=_S, model=_S, prompt_version=_S, committed_at=_S)
TASKS = _of(
    task_id=_S, run_id=_S, task_type=_S, scene_id=_S, record_id=_S, prompt_version=_S, status=_S, error=_S, started_at=_S, finished_at=_S,
    duration_ms=_L, prompt_tokens=_L, output_tokens=_L,
)
RUNS = _of(run_id=_S, kind=_S, status=_S, started_at=_S, finished_at=_S, error=_S)
STAGED = _of(layer=_S, sequence=_L, target_id=_S, task_id=_S, content_hash=_S, payload=_S)
COMMITS = _of(layer=_S, sequence=_L, content_hash=_S)

#: Append-only log rows; ``seq`` is the line order, which decides replay.
LOG = _of(seq=_L, record_type=_S, line=_S)

BLOCK_TYPES = ("heading", "paragraph", "blockquote", "list", "scene_break", "unknown")
CITABLE = ("paragraph", "blockquote", "list")
BOUNDARY_SOURCES = ("explicit", "model", "paragraph_count", "chapter_end")
STATUSES = ("generated", "verified", "accepted", "rejected", "skipped")
ENTITY_TYPES = ("character", "location", "object", "organization", "group", "document", "event-concept", "unknown")
ROLE_CLASSES = ("principal", "major_supporting", "supporting", "minor", "uncertain")
TRUSTED = ("verified", "accepted")
QUERY_MODES = ("recall", "continuity", "interpretation", "style", "development")
INTENTS = (
    "ending", "character_inventory", "character_arc", "chapter_summary", "whole_summary", "theme_style", "broad", "character_question", "narrow_recall",
)
#: Term type and the scene-card field it is read from.
TERM_FIELDS = (
    ("theme", "themes"), ("entity", "entities"), ("participant", "participants"), ("pov", "pov"), ("location", "locations"), ("unresolved", "unresolved"),
)
