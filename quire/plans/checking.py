"""The verification layer: a second model call on scene cards, and what follows.

Cards are selected by mode and asked about together with the paragraphs they
cite.  The verdict sets the card's status; a card already judged is left alone
unless forced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalize_support, strip_fences
from quire.operators.relations import evidence_rows
from quire.plans import verify
from quire.plans.compile import joined_lines
from quire.sources.aside import Aside
from quire.sources.provider import Provider, generate

SYSTEM = "Check the scene card against the paragraphs as one JSON object: supported, support_level, epistemic_type, overstatement, missing_counterevidence."
#: Keys under which a verdict may be wrapped.
WRAPPERS = ("verification", "record_verification", "result")


class VerdictError(ValueError):
    """A model's verdict can't be read."""


def selected(cards: DataFrame, mode: str, force: bool = False) -> DataFrame:
    """Cards to check: those the mode names and no verdict covers yet; (scene_id, status, action, evidence, summary, participants, unresolved)."""
    none = F.array().cast("array<string>")
    has = lambda c: F.coalesce(c, none) if c in cards.columns else none
    wanted = verify.should_verify(mode, verify.is_recovered(F.col("action")), verify.is_suspicious(F.col("evidence"), F.col("summary"), has("participants"), has("unresolved")))
    some = cards.where(wanted)
    return some if force else some.where(~verify.is_verified(F.col("status")))


def prompts(cards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(scene_id, user): the card, then the paragraphs it cites in order."""
    head = cards.select("scene_id", F.lit(-1).alias("position"), F.concat(F.col("title"), F.lit(": "), F.col("summary")).alias("line"))
    cited = evidence_rows(cards.select("scene_id", "evidence"), paragraphs.select("id", "text"))
    rows = head.unionByName(cited.select("scene_id", "position", F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("text")).alias("line")))
    return joined_lines(rows, ["scene_id"], "position", F.col("line"))


def verdict(content: Column) -> Column:
    """Struct of a verdict, wrapped or not; ``supported`` is null where there is none."""
    value = F.try_parse_json(strip_fences(content))
    wrapped = [F.try_variant_get(value, f"$.{w}", "variant") for w in WRAPPERS]
    inner = F.coalesce(*[F.when(F.schema_of_variant(w).startswith("OBJECT"), w) for w in wrapped], value)

    def text(name: str) -> Column:
        return F.coalesce(F.trim(F.try_variant_get(inner, f"$.{name}", "string")), F.lit(""))

    supported = F.try_variant_get(inner, "$.supported", "boolean")
    counter = F.coalesce(F.try_variant_get(inner, "$.missing_counterevidence", "array<string>"), F.array().cast("array<string>"))
    return F.struct(
        supported.alias("supported"), normalize_support(text("support_level"), F.coalesce(supported, F.lit(False))).alias("support_level"),
        text("epistemic_type").alias("epistemic_type"), text("overstatement").alias("overstatement"), counter.alias("missing_counterevidence"),
    )


def check_cards(cards: DataFrame, paragraphs: DataFrame, provider: Provider, mode: str, auto_accept: bool = False, model: str = "", force: bool = False) -> DataFrame:
    """``cards`` with ``verification`` and the status that follows; cards that weren't selected stay as they are."""
    asked = prompts(selected(cards, mode, force), paragraphs)
    answers = generate(asked, provider, "record-verification", SYSTEM, model).select("scene_id", verdict(F.col("content")).alias("verification"))
    told = Aside(cards.sparkSession, "verdicts").keep(answers)
    unread = told.where("verification.supported is null").orderBy("scene_id").limit(1).collect()
    if unread:
        raise VerdictError(f"no verdict on {unread[0]['scene_id']}")
    met = cards.drop("verification").join(told, "scene_id", "left")
    status = verify.status(F.col("verification.supported"), F.lit(auto_accept))
    return met.withColumn("status", F.when(F.col("verification").isNotNull(), status).otherwise(F.col("status")))
