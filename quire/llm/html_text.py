"""Main text of web pages by a linear-chain conditional random field.

The page's leaf blocks are a chain; each has features of its ancestors (tags,
words of their classes and ids, roles) and of its text.  The field is trained
on labelled pages, made by a generator of layouts, by gradient steps on its
regularised likelihood; Viterbi finds the best labelling of a page, and the
blocks labelled main are the text.

Defined results: null or empty html, and pages without main blocks, give an
empty text; repeated rows get equal answers; text cut off inside a tag or a
character reference ends there; an empty table gives an empty result; columns
named like an output are replaced, others pass through.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textkit as tk
from quire.llm.html_blocks import Block, Node, leaf_blocks
from quire.llm.scratch import bound_batches

_HOLDERS = ("article", "main")

_SAID = re.compile(r"(?i)\b(cookies?|subscribe|newsletter|advert\w*|sponsored|repl(?:y|ies)|comments?|sign (?:in|up)|log ?in|share|copyright|privacy|menu|related|read more|password|email)\b")


def _given(node: Node) -> set[str]:
    """Features that an element gives to all text inside it."""
    f = {f"in:{node.tag}"} | {f"name:{w}" for w in node.names}
    if node.role:
        f.add(f"role:{node.role}")
    if node.hidden:
        f.add("hidden")
    return f


def _own(block: Block, place: str, bare: bool) -> set[str]:
    """Features of a block's own text and innermost element; ``bare``: in no article or main element."""
    text = block.text
    words = text.count(" ") + 1
    f = {f"tag:{block.node.tag if block.node else ''}", place}
    size = next(j for j, most in enumerate((2, 5, 10, 20, 50, 1 << 60)) if words <= most)
    f.add(f"size:{size}")
    link = block.linked / max(1, len(text))
    f.add(f"link:{0 if link == 0 else 1 if link < 0.3 else 2 if link < 0.8 else 3}")
    f.add(f"end:{text[-1] in '.!?…:»”'}")
    f.add(f"commas:{min(3, text.count(','))}")
    if "©" in text[:40]:
        f.add("said:©")
    if words <= 30:
        f |= {f"said:{w.lower()}" for w in _SAID.findall(text)}
    if bare:
        f.add(f"bare:{size}")
    return f


def _place(i: int, n: int) -> str:
    return "first" if i == 0 else "last" if i == n - 1 else "inside"


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block of a page."""
    out = []
    for i, b in enumerate(blocks):
        path = b.node.path() if b.node else []
        given = set().union(*map(_given, path)) if path else set()
        out.append(sorted(given | _own(b, _place(i, len(blocks)), not any(n.tag in _HOLDERS for n in path))))
    return out


@dataclass
class Field:
    """Weights of the field: main against other for each feature, and steps between labels."""

    weights: dict[str, float]
    start: tuple[float, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def scores(self, blocks: list[Block]) -> list[float]:
        """Weight of each block's features; an element adds to its parent's only what that lacks.

        Features outside the field count for nothing and aren't kept, so what a
        deeply nested page needs is linear in its elements.
        """
        weights, nothing, out = self.weights, (frozenset(), 0.0, True), []
        for i, b in enumerate(blocks):
            chain, node = [], b.node
            while node is not None and node.known is None:
                chain.append(node)
                node = node.parent
            seen, score, bare = node.known if node is not None else nothing
            for node in reversed(chain):
                new = {f for f in _given(node) if f in weights and f not in seen}
                if new:
                    seen, score = seen | new, score + sum(weights[f] for f in sorted(new))
                bare = bare and node.tag not in _HOLDERS
                node.known = (seen, score, bare)
            own = _own(b, _place(i, len(blocks)), bare)
            out.append(score + sum(weights.get(f, 0.0) for f in sorted(own)))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The best labelling by Viterbi; a tie goes to other."""
        if not blocks:
            return []
        scores = self.scores(blocks)
        other, main = self.start[0], self.start[1] + scores[0]
        back = []
        for s in scores[1:]:
            from_other = (other + self.step[0][0], other + self.step[0][1])
            from_main = (main + self.step[1][0], main + self.step[1][1])
            back.append((from_main[0] > from_other[0], from_main[1] > from_other[1]))
            other, main = max(from_other[0], from_main[0]), max(from_other[1], from_main[1]) + s
        label = main > other
        labels = [label]
        for came in reversed(back):
            label = came[label]
            labels.append(label)
        return labels[::-1]

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return " ".join(b.text for b, main in zip(blocks, self.decode(blocks)) if main)


class Chains:
    """Labelled pages as arrays, for the likelihood of a field and its gradient."""

    def __init__(self, chains: list[list[Block]]):
        named = [features(c) for c in chains]
        self.names = sorted({x for c in named for f in c for x in f})
        at = {x: i for i, x in enumerate(self.names)}
        self.n, self.longest = len(chains), max(len(c) for c in chains)
        x = np.zeros((self.n, self.longest, len(self.names)), dtype=np.float32)
        y = np.zeros((self.n, self.longest), dtype=np.int64)
        self.real = np.zeros((self.n, self.longest), dtype=bool)
        for i, c in enumerate(chains):
            for j, b in enumerate(c):
                x[i, j, [at[f] for f in named[i][j]]] = 1
                y[i, j], self.real[i, j] = b.main, True
        self.flat = x.reshape(-1, len(self.names))
        self.gold_x = self.flat.T @ (y.reshape(-1) * self.real.reshape(-1)).astype(np.float32)
        self.gold_start = np.bincount(y[:, 0], minlength=2)
        pairs = self.real[:, 1:]
        self.gold_step = np.zeros((2, 2))
        np.add.at(self.gold_step, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)

    def likelihood(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """(log-likelihood of the labels, its gradient): forward and backward sums over all labellings."""
        w, start, step = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        n, longest, real, flat = self.n, self.longest, self.real, self.flat
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, longest)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = start + emit[:, 0]
        for j in range(1, longest):
            into = np.logaddexp.reduce(ahead[:, j - 1, :, None] + step, axis=1) + emit[:, j]
            ahead[:, j] = np.where(real[:, j, None], into, ahead[:, j - 1])
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        expected_step = np.zeros((2, 2))
        for j in range(longest - 2, -1, -1):
            onward = step + (emit[:, j + 1] + behind[:, j + 1])[:, None, :]
            both = np.exp(ahead[:, j, :, None] + onward - whole[:, None, None])
            expected_step += both[real[:, j + 1]].sum(axis=0)
            behind[:, j] = np.where(real[:, j + 1, None], np.logaddexp.reduce(onward, axis=2), behind[:, j + 1])
        sure = np.exp(ahead + behind - whole[:, None, None]) * real[:, :, None]
        gold = self.gold_x @ w + self.gold_start @ start + (self.gold_step * step).sum()
        gradient = [self.gold_x - flat.T @ sure[:, :, 1].reshape(-1).astype(np.float32), self.gold_start - sure[:, 0].sum(axis=0), (self.gold_step - expected_step).reshape(-1)]
        return float(gold - whole.sum()), np.concatenate(gradient)


def fit(pages: list[str], rounds: int = 150, ridge: float = 0.005, rate: float = 0.15) -> Field:
    """Train on pages whose elements say by ``data-main`` what is main text."""
    known = Chains([c for c in (leaf_blocks(p) for p in pages) if c])
    theta = np.zeros(len(known.names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        gradient = known.likelihood(theta)[1] / known.n - ridge * theta / 10
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    step = theta[-4:].reshape(2, 2)
    return Field(dict(zip(known.names, theta[:-6].tolist())), tuple(theta[-6:-4].tolist()), tuple(map(tuple, step.tolist())))


# --- labelled pages -------------------------------------------------------

#: What holds the main text: elements, and words that their classes and ids are made of.
_HOLDER_TAGS = ("div", "div", "div", "section", "main", "td")
_HOLDER_WORDS = ("content", "post", "article", "body", "entry", "column", "text", "main", "single", "prose", "page", "hentry", "detail", "markdown", "document", "news", "blog")
_NAV = (
    "<nav>{ul}</nav>", '<div class="menu">{ul}</div>', '<ul class="nav navbar">{li}</ul>', '<div id="navigation">{ul}</div>', '<div role="navigation">{ul}</div>',
    '<nav class="breadcrumb">{a}</nav>', '<div class="breadcrumbs">{a}</div>', '<div class="topbar menu">{a}</div>', '<div class="pagination pager">{a}</div>',
)
_ASIDE = (
    "<aside><h3>{t}</h3><p>{s}</p>{ul}</aside>", '<div class="sidebar"><h4>{t}</h4>{ul}<p>{s}</p></div>', '<div id="sidebar"><p>{s}</p><p>{s}</p></div>',
    '<aside class="related"><h2>{t}</h2>{ul}</aside>', '<div class="related posts">{ul}</div>', '<div class="widget"><p>{s}</p></div>', '<div class="share social">{a}</div>',
    '<div role="complementary"><p>{s}</p></div>', '<div class="recommended promoted">{ul}</div>', '<div class="author bio"><p>{s}</p></div>', '<div class="tags meta">{a}</div>',
)
_AD = (
    '<div class="ad">{s}</div>', '<div class="ads"><p>{s}</p></div>', '<div class="advert">{s}</div>', '<div class="advertisement"><p>{s}</p><a href="/">{t}</a></div>',
    '<div id="banner">{s}</div>', '<div class="sponsored content"><p>{s}</p></div>', '<section class="promo">{s}</section>', '<div class="adsbox sponsor">{s}</div>',
    '<aside class="ad">{s}</aside>', '<ins class="adsbygoogle"><p>{s}</p></ins>', '<div class="ad slot"><span>{s}</span></div>',
)
_NOTICE = (
    '<div class="cookie notice"><p>{s}</p><button>{t}</button></div>', '<div class="notice">{s}</div>', '<div id="cookie">{s}</div>', '<div class="alert">{s}</div>',
    '<div class="cookies consent banner">{s}</div>', '<div class="gdpr privacy"><p>{s}</p></div>', '<div role="alert">{s}</div>', '<div class="popup modal overlay"><p>{s}</p></div>',
    '<div class="paywall subscribe"><p>{s}</p></div>', "<noscript>{s}</noscript>", "<noscript><p>{s}</p></noscript>", "<template><p>{s}</p></template>", '<div role="dialog"><p>{s}</p></div>', '<dialog><p>{s}</p></dialog>', '<div class="message warning disclaimer">{s}</div>',
)
_FORM = (
    '<form><label>{t}</label><input name="q"><button>{t}</button></form>', '<form class="search"><p>{s}</p><input></form>', '<div class="newsletter signup"><form><p>{s}</p></form></div>',
    "<form><select><option>{t}</option><option>{t}</option></select><button>{t}</button></form>", "<select><option>{t}<option>{t}</select>", "<button>{t}</button>",
    '<form action="/login"><label>{t}</label><p>{t}</p></form>', '<form><fieldset><legend>{t}</legend><p>{s}</p></fieldset></form>', '<div class="subscription form"><p>{s}</p></div>',
)
_HEADER = (
    "<header><h1>{t}</h1><p>{s}</p></header>", '<div class="header"><p>{t}</p></div>', '<div id="header"><span>{t}</span>{ul}</div>', '<header class="site header"><p>{s}</p></header>',
    '<div class="masthead">{t}</div>', '<div class="logo">{t}</div>', '<div role="banner"><p>{t}</p></div>', "<header><p>{s}</p>{ul}</header>",
)
_FOOTER = (
    "<footer>{s}</footer>", "<footer>&copy; {t} &middot; {s}</footer>", '<div class="footer"><p>{s}</p>{ul}</div>', '<div id="footer">&copy; {t}</div>', '<div role="contentinfo"><p>{s}</p></div>',
    '<footer><p>{s}</p><p>{s}</p>{ul}</footer>', '<div class="copyright legal">{s}</div>', '<div class="bottom bar"><p>{s}</p></div>',
)
_COMMENTS = (
    '<section class="comments"><h2>{t}</h2>{cs}</section>', '<div id="comments"><ol class="comment list">{cs}</ol></div>', '<div class="comments">{cs}</div>', '<section id="discussion">{cs}</section>',
    '<div class="responses replies">{cs}</div>', '<div class="reader comments">{cs}</div>', '<ul class="commentlist">{cs}</ul>', '<section id="thread feedback">{cs}</section>',
)
_COMMENT = ('<div class="comment"><p>{p}</p></div>', '<article class="comment"><p>{p}</p></article>', "<p>{p}</p>", '<li><b>{t}</b><p>{p}</p></li>', '<div class="reply"><span>{t}</span><p>{p}</p></div>')
_SYLLABLES = "la ment er th on re ti de en an ou is at es or ver che un sta po ki lo ma ne ra su te vi wo be".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    said = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    for i in range(4, len(said) - 1, 7):
        said[i] += rng.choice([",", ",", ".", "", ";"])
    return " ".join(said)


def labelled_page(rng: random.Random) -> str:
    """One page of a random layout; ``data-main`` marks the article and what is not of it."""

    def fill(shape: str) -> str:
        while (met := re.search(r"\{(ul|li|a|t|s|p|cs)\}", shape)) is not None:
            kind = met.group(1)
            links = lambda: [f'<a href="/{i}">{_words(rng, 1, 4)}</a>' for i in range(rng.randint(2, 6))]
            text = {
                "t": lambda: _words(rng, 1, 6),
                "s": lambda: _words(rng, 4, 30) + rng.choice([".", ".", ""]),
                "p": lambda: _words(rng, 5, 60) + rng.choice([".", "!"]),
                "a": lambda: rng.choice([" ", " | ", " &gt; "]).join(links()),
                "li": lambda: "".join(f"<li>{x}</li>" for x in links()),
                "ul": lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in links()) + "</ul>",
                "cs": lambda: "".join(rng.choice(_COMMENT) for _ in range(rng.randint(1, 4))),
            }[kind]()
            shape = shape[: met.start()] + text + shape[met.end() :]
        return shape

    def other(kinds: tuple[str, ...]) -> str:
        return f'<div data-main="0">{fill(rng.choice(kinds))}</div>' if rng.random() < 0.1 else re.sub(r"^<(\w+)", r'<\1 data-main="0"', fill(rng.choice(kinds)))

    def piece() -> str:
        kind = rng.random()
        text = _words(rng, *rng.choice([(1, 3), (4, 12), (8, 25), (15, 80), (30, 150)])) + rng.choice([".", ".", ".", "!", "", "!!", " ###"])
        if kind < 0.72:
            return f"<p>{rng.choice(['', '<b>', '<em>'])}{text}{rng.choice(['', '<br>' + _words(rng, 1, 20)])}</p>"
        if kind < 0.8:
            return f"<h{rng.randint(2, 4)}>{_words(rng, 1, 9)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{_words(rng, 1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.93:
            return f"<pre><code>{text}</code></pre>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{_words(rng, 1, 5)}</td><td>{_words(rng, 1, 9)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.965:
            return f"<p>{text} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {_words(rng, 2, 9)}</p>"
        if kind < 0.97:
            return f'<{rng.choice(["object", "video", "audio", "canvas"])}>{_words(rng, 3, 20)}.</{rng.choice(["object", "video"])}>'
        if kind < 0.975:
            return f"<div>{text}</div>"
        if kind < 0.98:
            return f"<dl><dt>{_words(rng, 1, 4)}<dd>{_words(rng, 3, 15)}</dl>"
        if kind < 0.99:
            return f'<figure><img src="x"><figcaption>{_words(rng, 2, 15)}</figcaption></figure>'
        return f'<p>{_words(rng, 3, 20)} <a href="/x">{_words(rng, 1, 6)}</a> {_words(rng, 3, 20)}.</p>'

    def holder() -> tuple[str, str]:
        """Start and end tags around the main text."""
        if rng.random() < 0.45:
            return rng.choice(["<article{c}>", "<article{c}>", "<main{c}>", "<main><article{c}>"]), ""
        words = rng.sample(_HOLDER_WORDS, rng.randint(1, 2))
        name = rng.choice(["class", "class", "id"]) + f'="{rng.choice(["-", " ", "_"]).join(words)}"'
        if rng.random() < 0.2:
            name = 'role="main"' + rng.choice(["", " " + name])
        inner = f"<{rng.choice(_HOLDER_TAGS)} {name}{{c}}>"
        if rng.random() < 0.15:
            inner = rng.choice(["<article{c}>", inner]) + f'<div class="{rng.choice(_HOLDER_WORDS)}">'
        elif rng.random() < 0.2:
            inner = f'<div id="{rng.choice(_HOLDER_WORDS)}">' + inner
        table = "<td" in inner
        return "<table><tr>" * table + inner, "</table>" * table

    inside = []
    if rng.random() < 0.75:
        title = f"<h{rng.choice([1, 1, 1, 2])}>{_words(rng, 1, 14)}</h1>"
        title = title[:-2] + title[2] + ">"
        inside.append(f"<header>{title}</header>" if rng.random() < 0.15 else title)
    for _ in range(rng.choice([1, 1, 2, 4, 8, 12])):
        inside.append(f"<section>{piece()}{piece()}</section>" if rng.random() < 0.08 else piece())
        if rng.random() < 0.2:
            inside.append(other(rng.choice([_AD, _ASIDE, _NOTICE, _FORM])))
    if rng.random() < 0.2:
        inside.append(other(_COMMENTS))
    if rng.random() < 0.1:
        inside.append(other(_FOOTER))
    begin, after_it = holder()
    ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", begin)) if t not in ("table", "tr"))
    main = begin.replace("{c}", ' data-main="1"') + "".join(inside) + ends + after_it
    many = rng.choice([0.0, 0.15, 0.4, 0.5])
    before = [other(k) for k in (_HEADER, _NAV, _NOTICE, _AD, _FORM, _ASIDE) if rng.random() < many]
    many = rng.choice([0.0, 0.15, 0.4, 0.5])
    after = [other(k) for k in (_COMMENTS, _ASIDE, _AD, _NAV, _FORM, _NOTICE, _FOOTER) if rng.random() < many]
    if rng.random() < 0.1:
        rng.shuffle(before)
    body = "".join(before) + main + "".join(after)
    if rng.random() < 0.2:
        body = f'<div class="{rng.choice(["wrapper", "container", "page", "site", "layout row", "outer"])}">{body}</div>'
    return f"<html><head><title>{_words(rng, 2, 6)}</title></head><body>{body}</body></html>"


def labelled_pages(count: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(count)]


TRAIN_PAGES, TRAIN_SEED = 1000, 11


@functools.cache
def default_field() -> Field:
    """The field trained on the generator's pages; a second or two, once a process."""
    return fit(labelled_pages(TRAIN_PAGES, TRAIN_SEED))


def extract(pages: DataFrame, html_col: str = "html", trained: Field | None = None, keep_html: bool = True) -> DataFrame:
    """``pages`` with the main ``text`` and its length ``n_chars`` in code points."""
    bound_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained or default_field())
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    columns = [c for c in pages.columns if c not in ("text", "n_chars") and (keep_html or c != html_col)]
    schema = T.StructType([pages.schema[c] for c in columns] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = [known.text(x.as_py()) for x in batch.column(batch.schema.names.index("_q_html"))]
            arrays = [batch.column(batch.schema.names.index(c)) for c in columns]
            arrays += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "text", "n_chars"])

    return pages.select(*columns, F.col(html_col).alias("_q_html")).mapInArrow(tk.tidy(run), schema)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), keep_html=False)
