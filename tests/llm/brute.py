"""Plain versions of what the operators compute, for small fixtures."""

from __future__ import annotations

import re
from collections import Counter

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Rows with nulls, empty and odd texts, copies, and a repeated row.
PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, "First line here\nShared line of text\n\nshort", "en", "a"),
    (2, "  SHARED line of text \nOther line entirely", "en", "a"),
    (3, None, None, None),
    (4, "", "de", "b"),
    (5, PASSAGE, "en", "a"),
    (6, PASSAGE.upper(), "en", "a"),
    (7, PASSAGE + " tail one two three", "en", "b"),
    (8, "one two three four five " * 400, "fr", "a"),
    (8, "one two three four five " * 400, "fr", "a"),
    (9, "tiny", "fr", "c"),
    (10, "TINY", "fr", "c"),
    (11, "Ünïcödé \u2028 line\u00a0x\x0bÄÖÜ 数字 text", "de", "c"),
    (12, "12 345 ---", None, "c"),
    (None, "Shared line of text", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def line_key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII)


def dedup(rows: list[tuple]) -> list[tuple]:
    held: dict[str, set[int]] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 10 and i is not None:
                held.setdefault(line_key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(line_key(x), ())) < 2 or min(held[line_key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text: str | None, k: int = 5) -> set:
    w = SPACE_WORD.findall((text or "").translate(ASCII))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows: list[tuple]) -> dict[int, int]:
    root = {i: i for i, _ in rows if i is not None}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    index: dict[tuple, list[int]] = {}
    for at, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(at)
    for at, (i, s) in enumerate(sets):
        for other, n in Counter(o for x in s for o in index[x] if o > at).items():
            j, u = sets[other]
            if 100 * n >= 80 * (len(s) + len(u) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def leaks(text: str | None, items: list[tuple], window: int = 13) -> tuple[int, set[int], set[str]]:
    w = ALNUM_WORD.findall((text or "").translate(ASCII))
    hit: set[int] = set()
    met: set[str] = set()
    for item, said in items:
        v = ALNUM_WORD.findall((said or "").translate(ASCII))
        k = min(window, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                met.add("" if item is None else str(item))
    return len(w), hit, met


def cut(text: str, items: list[tuple]) -> str:
    """The text without runs of hit words, again and again until no word is hit."""
    while True:
        _, hit, _ = leaks(text, items)
        if not hit:
            return text
        out, at = "", 0
        words = list(ALNUM_WORD.finditer(text.translate(ASCII)))
        for i, w in enumerate(words):
            if i in hit and i - 1 not in hit:
                out += text[at : w.start()]
            if i in hit:
                at = w.end()
        text = out + text[at:]


def places(text: str | None, phrases) -> tuple[int, list[int], set[str]]:
    w = ALNUM_WORD.findall((text or "").translate(ASCII))
    at, labels = [], set()
    for phrase, label in phrases:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), at, labels
