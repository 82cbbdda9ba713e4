"""The evidence packet of a question, the prompt made of it, and the answer's checks.

A packet is rows (section, position, record_id, chapter_id, text): summaries,
roles, entities, digests, cards and paragraphs.  Everything in it was limited
before (searches, entity and role limits, the packing), so it is small; only it
is brought to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clean_list, strip_fences
from quire.operators import pack
from quire.plans.compile import joined_lines
from quire.plans.planner import BROAD_INTENTS
from quire.sources.provider import Provider, Request, generate

#: Sections in the order of the prompt, with their headings.
SECTIONS = (("summary", "Summaries"), ("role", "Characters"), ("entity", "Entities"), ("digest", "Condensed evidence"), ("card", "Scenes"), ("paragraph", "Evidence paragraphs"))
#: What a mode asks the model to look at.
FOCUS = {
    "recall": "Keep to what is stated.", "continuity": "Say what characters know, believe and have lived through at that point.", "interpretation": "Look at themes, motifs and meaning.",
    "style": "Look at voice, technique and structure.", "development": "Look at how characters, their relations and the plot change.",
}
ANSWER = "Answer the question from the records as one JSON object: answer, evidence (paragraph ids), records_used (ids of other records), uncertainties."
CONDENSE = "Condense the paragraphs for a later answer as one JSON object: summary, support (paragraph ids), uncertainties."
LEAST_CHUNK = 8


@dataclass
class Packet:
    """What an answer may rest on."""

    intent: str
    rows: list[dict] = field(default_factory=list)
    sources: dict[str, list[str]] = field(default_factory=dict)

    def section(self, name: str) -> list[dict]:
        return [r for r in self.rows if r["section"] == name]

    def paragraphs(self) -> dict[str, str]:
        """Ids that may be cited, with their chapters."""
        return {r["record_id"]: r["chapter_id"] for r in self.section("paragraph")}

    def records(self) -> list[str]:
        """Ids of all records but paragraphs, in order, each once."""
        return list(dict.fromkeys(r["record_id"] for name, _ in SECTIONS[:-1] for r in self.section(name) if r["record_id"]))

    def valid_records(self) -> set[str]:
        """Ids an answer may name as used: the records and what they were made from."""
        return set(self.records()) | {s for given in self.sources.values() for s in given if s}

    def is_empty(self) -> bool:
        return not any(self.section(s) for s in ("paragraph", "card", "summary"))

    def prompt(self, question: str) -> str:
        parts = []
        for name, heading in SECTIONS:
            rows = self.section(name)
            if rows or name == "paragraph":
                body = "\n".join(f"[{r['record_id']}]{' (' + r['chapter_id'] + ')' if r['chapter_id'] else ''} {r['text']}" for r in rows)
                parts.append(f"## {heading}\n\n{body or '(none)'}")
        return "\n\n".join([*parts, f"## Question\n\n{question}"])


def rows_of(found: DataFrame, section: str, record_id: Column, text: Column, order: list[Column], chapter: Column | None = None, sources: Column | None = None) -> DataFrame:
    """Rows of one section, ``position`` from 1; ``found`` is small."""
    none = F.array().cast("array<string>")
    return found.select(
        F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"), record_id.cast("string").alias("record_id"),
        (F.lit(None) if chapter is None else chapter).cast("string").alias("chapter_id"), text.alias("text"), (none if sources is None else F.coalesce(sources, none)).alias("sources"),
    )


def summary_rows(summaries: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    kind = F.col("record_type")
    record = F.when(kind == "book_summary", F.lit("book_summary")).otherwise(F.concat(F.lit("chapter_summary:"), "chapter_id"))
    text = F.concat_ws(" ", F.trim("summary"), *[F.when(F.size(F.coalesce(c, none)) > 0, F.concat(F.lit(f"{c}: "), F.array_join(c, "; "))) for c in ("themes", "unresolved")])
    given = F.col("source_records") if "source_records" in summaries.columns else none
    return rows_of(summaries, "summary", record, text, [F.when(kind == "book_summary", 0).otherwise(1), F.col("chapter_id"), F.col("record_id")], F.col("chapter_id"), given)


def role_rows(roles: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", F.concat("canonical_name", F.lit(","), F.lit(" "), "classification"), F.col("role"), F.concat(F.lit("("), F.array_join("aliases", ", "), F.lit(")")))
    order = [F.desc("score"), F.lower("canonical_name"), F.col("character_id")]
    return rows_of(roles, "role", F.concat(F.lit("character_role:"), "character_id"), text, order, sources=F.col("source_entity_ids"))


def entity_rows(entities: DataFrame) -> DataFrame:
    text = F.concat("canonical_name", F.lit(", "), "type", F.lit(" ("), F.array_join("aliases", ", "), F.lit(")"))
    return rows_of(entities, "entity", F.col("id"), text, [F.desc("score"), F.lower("canonical_name"), F.lower("type"), F.col("id")], F.col("chapter_id"))


def card_rows(cards: DataFrame, order: list[Column]) -> DataFrame:
    return rows_of(cards, "card", F.col("scene_id"), F.concat_ws(" ", "title", "summary"), order, F.col("chapter_id"))


def wants_digests(kind: str, found: int, most: int, has_summaries: bool, has_cards: bool) -> bool:
    """Whether paragraphs are condensed: too many for a broad question that nothing else covers."""
    return found > most and kind in BROAD_INTENTS and not has_summaries and not has_cards


def digest_prompts(paragraphs: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, chunk, user, ids): runs of twice ``most`` paragraphs (8 at least) in order of ``position``."""
    size = max(2 * most, LEAST_CHUNK)
    parts = pack.chunks(paragraphs, by, [F.col("position")], size)
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.col("text"))
    ids = parts.groupBy(*by, "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", F.col("id").cast("string").alias("id")))), lambda x: x["id"]).alias("ids"))
    return joined_lines(parts, [*by, "chunk"], "position", line).join(ids, [*by, "chunk"])


def digests(paragraphs: DataFrame, by: list[str], most: int, provider: Provider, model: str = "") -> DataFrame:
    """(by, digest_id, summary, support): each run condensed; support must be of the run.

    ``summary`` is empty where the answer has none, which is the caller's error to raise.
    """
    said = generate(digest_prompts(paragraphs, by, most), provider, "condense", CONDENSE, model)
    body = strip_fences(F.col("content"))
    support = clean_list(F.coalesce(F.from_json(F.get_json_object(body, "$.support"), "array<string>"), F.array().cast("array<string>")))
    return said.select(
        *by, F.format_string("digest-%04d", F.col("chunk") + 1).alias("digest_id"), F.trim(F.coalesce(F.get_json_object(body, "$.summary"), F.lit(""))).alias("summary"),
        F.filter(support, lambda x: F.array_contains(F.col("ids"), x)).alias("support"),
    )


def answered(packet: Packet, question: str, provider: Provider, mode: str, model: str = "") -> tuple[str, list[str], list[str], dict]:
    """(text, cited paragraphs, records used, the raw answer); what isn't in the packet is dropped.

    A broad question whose answer names nothing rests on all records.
    """
    reply = provider.generate(Request("answer", f"{ANSWER} {FOCUS.get(mode, FOCUS['recall'])}", packet.prompt(question), model, 0.2))
    if reply.error:
        raise OSError(reply.error)
    bare = reply.content.strip()
    if bare.startswith("```"):
        bare = bare.removeprefix("```").removeprefix("json").strip().removesuffix("```")
    raw = json.loads(bare) if bare.strip() else {}
    known = packet.paragraphs()
    cited = [i for i in raw.get("evidence") or [] if i in known]
    valid = packet.valid_records()
    used = list(dict.fromkeys(i.strip() for i in raw.get("records_used") or [] if i.strip() in valid))
    if not used and not cited and packet.intent in BROAD_INTENTS:
        used = packet.records()
    return str(raw.get("answer", "")).strip(), cited, used, raw
