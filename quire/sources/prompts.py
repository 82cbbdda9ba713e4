"""Prompts in a folder that users may edit: defaults, loading, upgrade by version."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from quire.plans import book, checking, extraction, packet, roles
from quire.plans import compile as layers
from quire.sources.settings import prompt_version, should_upgrade

#: Prompts by name, each with its family and number.
SHIPPED = {
    "scene-card": (layers.CARD_SYSTEM, 1), "chapter-summary": (layers.SUMMARY_SYSTEM, 1), "book-summary": (book.SYSTEM, 1), "entities": (extraction.SYSTEM, 1),
    "roles": (roles.SYSTEM, 1), "record-verification": (checking.SYSTEM, 1), "answer": (packet.ANSWER, 1), "condense": (packet.CONDENSE, 1),
}


@dataclass(frozen=True)
class Prompt:
    name: str
    content: str
    version: str


def default(name: str) -> Prompt:
    body, number = SHIPPED[name]
    return Prompt(name, f"<!-- prompt-version: {name}-v{number} -->\n{body}\n", f"{name}-v{number}")


def load(folder: Path | None, name: str) -> Prompt:
    """The prompt on disk, else the one that is shipped; its version is what its version line says, else ``custom``."""
    path = folder / f"{name}.md" if folder else None
    if path is None or not path.is_file():
        return default(name)
    text = path.read_text(encoding="utf-8")
    found = prompt_version(text)
    return Prompt(name, text, f"{found[0]}-v{found[1]}" if found else "custom")


def sync(folder: Path) -> dict[str, str]:
    """Write prompts that are missing, replace older ones of the same family; edited families stay.  Name to what was done."""
    folder.mkdir(parents=True, exist_ok=True)
    done = {}
    for name in SHIPPED:
        path, shipped = folder / f"{name}.md", default(name).content
        if not path.is_file():
            done[name] = "written"
        elif should_upgrade(path.read_text(encoding="utf-8"), shipped):
            done[name] = "upgraded"
        else:
            done[name] = "kept"
            continue
        draft = path.with_suffix(".tmp")
        draft.write_text(shipped, encoding="utf-8")
        draft.replace(path)
    return done
