"""Tolerant reading of JSON that a model wrote.

Plain shapes are read in the JVM with VARIANT; recursive coercions and the
salvage of cut-off arrays are Arrow-batched Python, for which SQL has no words.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# fixed values: keys tried in order for an object's text
TEXT_KEYS = ("plot_overview", "summary", "action", "description", "text", "statement", "title", "name", "value", "paragraph_id", "id")
# fixed values: keys under which evidence ids may stand
EVIDENCE_KEYS = (
    "paragraph_id", "paragraphId", "paragraphID", "paragraph_ids", "paragraphIds", "paragraphIDs", "paragraph", "paragraphs", "id", "ids",
    "source", "sources", "source_paragraph", "sourceParagraph", "source_paragraphs", "sourceParagraphs", "citation", "citations", "evidence",
)


def number_text(value: float | int) -> str:
    """A JSON number as text: integral values without a fraction."""
    return str(int(value)) if float(value).is_integer() and abs(value) < 1e21 else repr(float(value))


def value_text(value: object) -> str:
    """Text of any JSON value: arrays joined by ``; ``, objects by their best key or all of them."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return "; ".join(t for t in map(value_text, value) if t)
    best = next((t for t in (value_text(value.get(k)) for k in TEXT_KEYS) if t), "")
    return best or "; ".join(f"{k}: {t}" for k, t in ((k, value_text(value[k])) for k in sorted(value)) if t)


def value_list(value: object) -> list[str]:
    """A list of texts from an array, or from one value."""
    items = value if isinstance(value, list) else [value]
    return [t for t in map(value_text, items) if t]


def evidence_ids(value: object) -> list[str]:
    """Paragraph ids from a string, an array or objects of either, in order, each once."""

    def walk(v: object) -> list[str]:
        if isinstance(v, str):
            return [v.strip()] if v.strip() else []
        if isinstance(v, list):
            return [i for x in v for i in walk(x)]
        if isinstance(v, dict):
            named = [i for k in EVIDENCE_KEYS if k in v for i in walk(v[k])]
            return named + [k for k in sorted(v) if k.strip().startswith("p-")]
        return []

    return list(dict.fromkeys(walk(value)))


def _loaded(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def json_text(values: pd.Series) -> pd.Series:
    return values.map(lambda x: value_text(_loaded(x)))


@F.pandas_udf(ArrayType(StringType()))
def json_list(values: pd.Series) -> pd.Series:
    return values.map(lambda x: value_list(_loaded(x)))


@F.pandas_udf(ArrayType(StringType()))
def json_evidence(values: pd.Series) -> pd.Series:
    return values.map(lambda x: evidence_ids(_loaded(x)))


def complete_objects(content: str, key: str) -> list[str]:
    """The whole JSON objects of the array under ``key``, though the text may be cut off."""
    found = content.find(f'"{key}"')
    rest = content[found + len(key) + 2 :].lstrip(": \n\r\t") if found >= 0 else ""
    if not rest.startswith("["):
        return []
    decoder, at, out = json.JSONDecoder(), 1, []
    while at < len(rest):
        if rest[at] == "]":
            break
        if rest[at] != "{":
            at += 1
            continue
        try:
            _, end = decoder.raw_decode(rest, at)
        except ValueError:
            break
        out.append(rest[at:end])
        at = end
    return out


def salvage(content: Column, key: str) -> Column:
    """``complete_objects`` as a column of JSON texts."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: complete_objects(x or "", key))

    return run(content)


def is_truncated(content: Column) -> Column:
    """Text that begins like JSON but doesn't parse."""
    return content.rlike(r"^\s*[{\[]") & F.try_parse_json(content).isNull()


def flexible_list(raw: Column, path: str) -> Column:
    """Strings of a field that is a string, a number, a boolean or an array of these; JVM only."""
    value = F.try_variant_get(F.try_parse_json(raw), path, "variant")
    kind = F.schema_of_variant(value)
    many = F.try_variant_get(value, "$", "array<string>")
    one = F.array(F.try_variant_get(value, "$", "string"))
    items = F.when(kind.startswith("ARRAY"), many).when(kind.startswith("OBJECT") | (kind == "VOID"), F.array().cast("array<string>")).otherwise(one)
    return F.filter(F.coalesce(F.transform(items, lambda x: F.trim(x)), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def endpoint_scope(url: str) -> str:
    """loopback, private, link-local, shared, remote or invalid, by a URL's host."""
    import ipaddress
    from urllib.parse import urlsplit

    try:
        host = urlsplit(url).hostname
    except ValueError:
        return "invalid"
    if not host:
        return "invalid"
    if host == "localhost":
        return "loopback"
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return "remote"
    if ip.is_loopback:
        return "loopback"
    if ip.is_link_local:
        return "link-local"
    if ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10"):
        return "shared"
    return "private" if ip.is_private else "remote"
