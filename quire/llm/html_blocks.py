"""HTML to leaf blocks: runs of text between block-level tags, with their ancestors.

A forgiving reader that goes over the page once.  Nothing it does at a tag looks
at the whole stack or the rest of the page, so time is linear in the page
however tags are nested, left open or broken.

Defined results: end tags that were left out are implied; an end tag without its
start tag is ignored, and one inside a table cell ends nothing outside the cell;
a new tag inside a broken one ends that; a quoted value that isn't closed, or
that swallows tags and runs on into a word, ends with its tag at the first ``>``;
a tag or comment that the page's end cuts off is dropped; script and style that
never end take the rest of the page, other raw elements that never end lose
their tag only.  Text of the head belongs to the body, but for raw elements.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_S = r"[ \t\n\r\f]"
#: A well-formed tag, read without any backtracking.
_TAG = re.compile(
    rf"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:{_S}++[^ \t\n\r\f\"'<>/=]++(?:{_S}*+={_S}*+(?:\"[^\"]*+\"|'[^']*+'|[^ \t\n\r\f\"'<>=`]++))?+)*+){_S}*+(/?)>"
)
_NAME = re.compile(r"[a-zA-Z][^ \t\n\r\f/><]*")
_GAP = re.compile(r"[ \t\n\r\f/]*")
_SPACES = re.compile(r"[ \t\n\r\f]*")
_ATTRIBUTE = re.compile(r"=?[^ \t\n\r\f/>=<]*")
_BARE = re.compile(r"[^ \t\n\r\f>]*")
_ATTR = re.compile(rf"([^ \t\n\r\f\"'<>/=]++)(?:{_S}*+={_S}*+(\"[^\"]*+\"|'[^']*+'|[^ \t\n\r\f\"'<>=`]++))?+")
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_FAR = re.compile(r"&#0*([0-9]{8,});?")

#: Elements whose content is text, not markup, and none of the page's own text.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that part blocks; any other without a hyphen in its name runs in line.
BLOCK = frozenset(
    "address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol optgroup option p"
    " pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that part blocks but may stand inside a paragraph.
EMBED = frozenset("audio canvas datalist iframe noscript object select template video".split())
_ROOTS = frozenset(("html", "head", "body"))
_CELLS = frozenset(("td", "th", "caption"))
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
#: A start tag of the first kind ends an open one of the second, up to the nearest of the third.
_IMPLIED = (
    ({"li"}, {"li"}, {"ul", "ol", "menu", "dir"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
    ({"tr", "tbody", "thead", "tfoot"}, {"tr"}, {"table"}),
    ({"option", "optgroup"}, {"option"}, {"select", "datalist"}),
)
_GROUP = {tag: i for i, (starts, _, _) in enumerate(_IMPLIED) for tag in starts}
_SCOPED = frozenset(t for _, ends, walls in _IMPLIED for t in ends | walls)
_NOWHERE = (-1,) * len(_IMPLIED)


class Node:
    """An element with its ancestors; ``depth`` is its place on the stack, ``scope`` where implied ends reach to."""

    __slots__ = ("tag", "parent", "depth", "names", "role", "hidden", "main", "scope", "inline", "cell", "known")

    def __init__(self, tag: str, parent: Node | None, depth: int, attributes: str = ""):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.names: tuple[str, ...] = ()
        self.role, self.hidden = "", tag == "template"
        self.main: bool | None = parent.main if parent else None
        self.known: object = None  # what a field keeps of the ancestors
        if attributes and not attributes.isspace():
            found: dict[str, str] = {}
            for name, value in _ATTR.findall(attributes):
                found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
            self.names = tuple(_WORD.findall(_HUMP.sub(r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()))
            self.role = found.get("role", "").lower()
            style = found.get("style", "").replace(" ", "").lower()
            self.hidden = self.hidden or "hidden" in found or "display:none" in style or found.get("aria-hidden") == "true"
            if "data-main" in found:
                self.main = found["data-main"] == "1"
        scope = parent.scope if parent else _NOWHERE
        if tag in _SCOPED:
            scope = tuple(depth if tag in ends else -1 if tag in walls else at for (_, ends, walls), at in zip(_IMPLIED, scope))
        self.scope = scope

    def path(self) -> list[Node]:
        """The element and its ancestors, outermost first."""
        out, node = [], self
        while node is not None:
            out.append(node)
            node = node.parent
        return out[::-1]


@dataclass
class Block:
    text: str
    node: Node | None
    linked: int
    main: bool = False
    features: list[str] = field(default_factory=list)


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond all code points are U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_FAR.sub("�", text))


def clean(text: str) -> str:
    """Character references decoded, white space runs made one space, trimmed."""
    return " ".join(decoded(text).split())


class _Reader:
    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.blocks: list[Block] = []
        self.stack: list[Node] = []
        self.block_at: list[int] = []  # places on the stack of the elements that part blocks
        self.inline: dict[str, int] = {}  # open inline elements since the last of them
        self.cell: dict[str, int] = {}  # open blocks since the last table cell
        self.parts: dict[str, int] = {}  # open parts of tables, in all
        self.run: list[str] = []
        self.linked: list[str] = []
        self.owner: Node | None = None
        self.link = -1  # where on the stack a link is open
        self.nexts: dict[str, int] = {}
        self.endless: set[str] = set()

    def next(self, sign: str, at: int) -> int:
        """Place of the next ``sign``, the page's size if there is none; each stretch is searched once."""
        known = self.nexts.get(sign, -1)
        if known < at:
            known = self.page.find(sign, at)
            known = self.size if known < 0 else known
            self.nexts[sign] = known
        return known

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                node = self.owner
                self.blocks.append(Block(text, node, len(" ".join("".join(self.linked).split())), bool(node and node.main)))
            self.run, self.linked = [], []
        self.owner = None

    def say(self, raw: str) -> None:
        text = decoded(raw)
        if not self.run and (not text or text.isspace()):
            return
        top = self.stack[-1] if self.stack else None
        if not self.run or (self.owner is not None and self.owner.depth > (top.depth if top else -1)):
            self.owner = top
        self.run.append(text)
        if self.link >= 0:
            self.linked.append(text)

    def cut(self, depth: int) -> None:
        """Close all elements from this place of the stack on."""
        stack = self.stack
        while len(stack) > depth:
            node = stack.pop()
            if self.block_at and self.block_at[-1] == node.depth:
                self.block_at.pop()
                self.inline = node.inline
                if node.cell is not None:
                    self.cell = node.cell
                if node.tag in _TABLE:
                    self.parts[node.tag] -= 1
                else:
                    self.cell[node.tag] -= 1
            else:
                self.inline[node.tag] -= 1
        if self.link >= depth:
            self.link = -1

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        parts = tag in BLOCK or tag in EMBED or "-" in tag
        stack = self.stack
        if parts:
            self.flush()
            if tag in BLOCK and self.block_at and stack[self.block_at[-1]].tag == "p":
                self.cut(self.block_at[-1])  # an open paragraph and its inline elements end here
        if tag in _GROUP and stack:
            open_at = stack[-1].scope[_GROUP[tag]]
            if open_at >= 0:
                self.cut(open_at)
        if tag == "a" and self.link >= 0:
            self.link = -1  # links don't nest
        if closed:
            return
        node = Node(tag, stack[-1] if stack else None, len(stack), attributes)
        if parts:
            node.inline, node.cell = self.inline, None
            self.inline = {}
            if tag in _TABLE:
                self.parts[tag] = self.parts.get(tag, 0) + 1
                if tag in _CELLS:
                    node.cell, self.cell = self.cell, {}
            else:
                self.cell[tag] = self.cell.get(tag, 0) + 1
            self.block_at.append(len(stack))
        else:
            self.inline[tag] = self.inline.get(tag, 0) + 1
            if tag == "a":
                self.link = len(stack)
        stack.append(node)

    def end(self, tag: str) -> None:
        if tag in BLOCK or tag in EMBED or "-" in tag:
            self.flush()
            if (self.parts if tag in _TABLE else self.cell).get(tag, 0) > 0:
                at = len(self.stack) - 1
                while self.stack[at].tag != tag:
                    at -= 1
                self.cut(at)
        elif self.inline.get(tag, 0) > 0:
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.cut(at)
        elif tag == "a":
            self.link = -1

    def broken(self, at: int) -> tuple[str, bool, int]:
        """(attributes, whether it closes itself, end) of a tag that isn't well formed; the end is the size if cut off."""
        page, begin, closed = self.page, at, False
        while True:
            gap = _GAP.match(page, at)
            at, closed = gap.end(), page.endswith("/", gap.start(), gap.end())
            if at >= self.size:
                return "", False, self.size
            if page[at] == ">":
                return page[begin:at], closed, at + 1
            if page[at] == "<":
                return page[begin:at], False, at
            at = _ATTRIBUTE.match(page, at).end()
            after = _SPACES.match(page, at).end()
            if not page.startswith("=", after):
                continue
            at = _SPACES.match(page, after + 1).end()
            if at < self.size and page[at] in "\"'":
                to = self.next(page[at], at + 1)
                follows = page[to + 1 : to + 2]
                swallowed = follows and follows not in " \t\n\r\f/>" and self.next("<", at) < to
                if to >= self.size or swallowed:
                    to = self.next(">", at)
                    return page[begin:at], False, min(self.size, to + 1)
                at = to + 1
            else:
                at = _BARE.match(page, at).end()

    def skip(self, tag: str, at: int) -> int:
        """Where a raw element that starts here ends."""
        if tag not in self.endless:
            met = _END[tag].search(self.page, at)
            if met is not None:
                return met.end()
            self.endless.add(tag)
        return self.size if tag in ("script", "style") else at

    def read(self) -> list[Block]:
        page, size, at, said = self.page, self.size, 0, 0
        while True:
            at = page.find("<", at)
            if at < 0 or at + 1 >= size:
                self.say(page[said:])
                break
            sign = page[at + 1]
            if not (sign.isascii() and (sign.isalpha() or sign in "/!?")):
                at += 1
                continue
            if said < at:
                self.say(page[said:at])
            if page.startswith("<!--", at):
                to = page.find("-->", at + 2)
                at = said = size if to < 0 else to + 3
                continue
            named = page[at + 2 : at + 3] if sign == "/" else sign
            if not (named.isascii() and named.isalpha()):
                at = said = min(size, self.next(">", at) + 1)
                continue
            met = _TAG.match(page, at)
            if met is not None:
                ending, tag, attributes, closed = bool(met[1]), met[2].lower(), met[3], bool(met[4])
                to = met.end()
                if "<" in tag:
                    met = None
            if met is None:
                ending = sign == "/"
                name = _NAME.match(page, at + 1 + ending)
                tag = name[0].lower()
                attributes, closed, to = self.broken(name.end())
                if to >= size and not page.endswith(">"):
                    break
            at = said = to
            if ending:
                self.end(tag)
            elif tag in RAW:
                at = said = at if closed and tag not in ("script", "style") else self.skip(tag, at)
            elif tag in VOID:
                if tag in ("br", "hr"):
                    self.flush()
            elif tag not in _ROOTS:
                self.start(tag, attributes, closed)
        self.flush()
        return self.blocks


_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\r\f/>])[^>]*+>?", re.I) for tag in RAW}


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order, each with the innermost element that holds all its text."""
    return _Reader(page).read()
