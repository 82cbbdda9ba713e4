"""Which records a second model call should check, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import uni_trim

MODES = ("off", "recovered", "selective", "all")


def is_recovered(action: Column) -> Column:
    return F.lower(uni_trim(F.coalesce(action, F.lit("")))).isin("retry", "compact-retry", "fallback")


def is_suspicious(evidence: Column, summary: Column, participants: Column, unresolved: Column) -> Column:
    """No evidence, a summary of under 40 signs, or over 16 participants and open questions."""

    def count(x: Column) -> Column:
        return F.coalesce(F.size(F.coalesce(x, F.array())), F.lit(0))

    return (count(evidence) == 0) | (F.char_length(uni_trim(F.coalesce(summary, F.lit("")))) < 40) | (count(participants) + count(unresolved) > 16)


def should_verify(mode: str, recovered: Column, suspicious: Column) -> Column:
    if mode == "off":
        return F.lit(False)
    if mode == "recovered":
        return recovered
    return recovered | suspicious if mode == "selective" else F.lit(True)


def status(supported: Column, auto_accept: Column) -> Column:
    return F.when(~supported, "rejected").when(auto_accept, "accepted").otherwise("verified")


def is_verified(value: Column) -> Column:
    return F.lower(uni_trim(F.coalesce(value, F.lit("")))).isin("verified", "accepted", "rejected")


def effective_mode(requested: str | None, configured: str | None, layer: str = "") -> str:
    """The mode of a run: its own, else the project's, else all; the verification layer checks all."""
    if layer == "verification":
        return "all"
    for value in (requested, configured):
        bare = (value or "").strip().lower()
        if bare in MODES:
            return bare
    return "all"
