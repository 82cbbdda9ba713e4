"""Whether a project can be worked with: its settings, its tables and its model servers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from quire.functions.jsonvals import endpoint_scope
from quire.operators import replay, segment
from quire.sources.provider import Provider, Request
from quire.sources.settings import Settings
from quire.sources.store import Store

MODES = ("explicit", "hybrid", "paragraph-count")
POLICIES = ("trusted-only", "include-generated")


@dataclass(frozen=True)
class Check:
    name: str
    ok: bool
    detail: str = ""


def check_settings(s: Settings) -> list[Check]:
    """A row for each setting that has rules."""
    return [
        Check("window", s.window_tokens > 0 and 0 <= s.window_overlap, f"{s.window_tokens} tokens, {s.window_overlap} paragraphs again"),
        Check("scene_mode", s.scene_mode in MODES, s.scene_mode),
        Check("scene_breaks", bool(s.scene_breaks) and all(b.strip() for b in s.scene_breaks), ", ".join(s.scene_breaks)),
        Check("verification", s.verification in ("off", "recovered", "selective", "all"), s.verification),
        Check("card_policy", s.card_policy in POLICIES, s.card_policy),
        Check("max_evidence", s.max_evidence > 0, str(s.max_evidence)),
        *[Check(f"models.{role}", endpoint_scope(spec["base_url"]) != "invalid", spec["base_url"]) for role, spec in sorted(s.models.items()) if "base_url" in spec],
    ]


def check_tables(store: Store) -> list[Check]:
    """What the relations must be like: there, whole, and in step with one another."""
    if not store.has("paragraphs"):
        return [Check("manuscript", False, "nothing was imported")]
    out = [Check("manuscript", True, f"{store.read('paragraphs').count()} paragraphs")]
    same = store.read("paragraphs").groupBy("id").count().where("count > 1").limit(1).collect()
    out.append(Check("paragraph ids", not same, same[0]["id"] if same else ""))
    if store.has("scenes"):
        bad = segment.partition_violations(store.read("scenes"), store.read("paragraphs")).orderBy("chapter_id", "ordinal").limit(1).collect()
        out.append(Check("scenes", not bad, f"{bad[0]['chapter_id']}: {bad[0]['problem']}" if bad else ""))
    if store.has("scene_cards"):
        left = replay.pending(store.read("scenes").select(F.col("id").alias("scene_id")), store.read("scene_cards"), ["scene_id"]).count()
        out.append(Check("scene cards", left == 0, f"{left} scenes without one" if left else ""))
    return out


def check_provider(provider: Provider, model: str = "") -> Check:
    """Whether a model server answers at all."""
    r = provider.generate(Request("ping", "Answer with the JSON object {}.", "{}", model, max_tokens=20))
    return Check("provider", not r.error, r.error or r.finish_reason)
