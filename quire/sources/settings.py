"""Project settings, roles of models and prompts."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

PROMPT_VERSION = re.compile(r"(?im)^\s*(?:<!--\s*)?prompt[-_ ]version:\s*([a-z0-9-]+)-v(\d+)")


@dataclass(frozen=True)
class Settings:
    """What a project sets; defaults hold elsewhere."""

    title: str = ""
    language: str = "en"
    window_tokens: int = 12_000
    window_overlap: int = 3
    scene_mode: str = "hybrid"
    scene_target: int | None = None
    scene_max_paragraphs: int | None = None
    scene_breaks: tuple[str, ...] = ("***", "---", "* * *", "#")
    verification: str = "all"
    auto_accept: bool = False
    max_evidence: int = 20
    card_policy: str = "trusted-only"
    models: dict[str, dict[str, str]] = field(default_factory=dict)


def load(text: str) -> Settings:
    """Settings from TOML; unknown keys are ignored, blank values keep the default."""
    data = tomllib.loads(text)
    flat = {**data, **data.get("project", {}), **data.get("compile", {}), **data.get("query", {})}
    known = {k: v for k, v in flat.items() if k in Settings.__dataclass_fields__ and v not in ("", None)}
    if "scene_breaks" in known:
        known["scene_breaks"] = tuple(known["scene_breaks"])
    return Settings(**known)


def dump(settings: Settings) -> str:
    """TOML that ``load`` reads back."""
    out = []
    for name in Settings.__dataclass_fields__:
        value = getattr(settings, name)
        if value is None or name == "models":
            continue
        if isinstance(value, bool):
            out.append(f"{name} = {str(value).lower()}")
        elif isinstance(value, int):
            out.append(f"{name} = {value}")
        elif isinstance(value, tuple):
            out.append(f"{name} = [" + ", ".join('"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in value) + "]")
        else:
            out.append(f'{name} = "' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"')
    for role, spec in settings.models.items():
        out.append(f"\n[models.{role}]")
        out += [f'{k} = "{v}"' for k, v in spec.items()]
    return "\n".join(out) + "\n"


def find_env(name: str, variable: str, executable_dir: str | None = None) -> Path | None:
    """A settings file: the one a variable names, else in the working folder, else beside the program."""
    named = os.environ.get(variable)
    places = [Path(named)] if named else []
    places.append(Path.cwd() / name)
    if executable_dir:
        places.append(Path(executable_dir) / name)
    return next((p for p in places if p.is_file()), None)


def model_for(settings: Settings, role: str) -> tuple[str, str]:
    """(provider, model) of a role, with the default role's values where it has none."""
    base, own = settings.models.get("default", {}), settings.models.get(role, {})
    return own.get("provider", base.get("provider", "fake")), own.get("model", base.get("model", ""))


def prompt_version(text: str) -> tuple[str, int] | None:
    """(family, number) that a prompt's version line gives."""
    found = PROMPT_VERSION.search(text)
    return (found.group(1).lower(), int(found.group(2))) if found else None


def should_upgrade(current: str, shipped: str) -> bool:
    """Whether a prompt on disk is an older one of the same family as the shipped one."""
    a, b = prompt_version(current), prompt_version(shipped)
    return a is not None and b is not None and a[0] == b[0] and a[1] < b[1]
