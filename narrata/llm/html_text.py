"""Main text of HTML pages by the maximum-scoring contiguous region.

A page is a sequence of words and tags. A word scores by the log odds that its block stands in the main text:
a logistic model of the elements around it, the words of their class, id and role, the block's length,
punctuation and links, and where it stands to the page's article and to the container with most prose. A tag
scores negative, by how rarely it is inside main texts. All weights are learned from labelled pages. A linear
scan then finds the contiguous region of the greatest sum; blocks inside it that score negative (an advert, a
form) are left out.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.common import columns_of, map_rows, ready

# HTML's raw-text, void and inline elements, and those that hold no article by their meaning.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "label", "fieldset"}
ARTICLE = {"article", "main"}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Open elements that these tags end without an end tag.
CLOSES = {"p": _ENDS_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ENDS = re.compile(r"[.!?:;…。]['\")\]»”]*\s*$")
_MARKS = re.compile(r"[.,;:!?]")


@dataclass
class Block:
    """Text between two tags of block elements: its element, words, words in links, and pieces of text."""

    element: int
    at: int
    words: int = 0
    links: int = 0
    text: str = ""
    inner: bool = False  # in the page's article, or in the container with most prose
    pieces: list[str] = field(default_factory=list)
    features: tuple[str, ...] = ()  # of the block itself, besides those of the elements around it


@dataclass
class Page:
    """The elements (name, parent, words of class, id and role, words in all, features) and the tokens of a page.

    An element's features are those that none of the elements around it has, so that depth costs nothing.
    A token is (tag, None) or ('', block).
    """

    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    said: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    words: list[int] = field(default_factory=lambda: [0])
    features: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    tokens: list[tuple[str, Block | None]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def said_words(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role: one alone as c:word, one of a compound as p:word."""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        for token in "".join(filter(None, m.groups())).lower().split():
            parts = re.split(r"[^a-z]+", token)
            parts = [x for x in parts if x]
            out += [("c:" if len(parts) == 1 else "p:") + x for x in parts]
    return tuple(out)


def parse(page: str) -> Page:
    """The page's elements, blocks and tokens; broken markup is read as far as it goes."""
    out = Page()
    stack, shut = [0], Counter()  # open elements; how many of each name are open
    block: Block | None = None
    links = at = 0
    n = len(page)
    closest = [0]  # innermost block element for each open element

    def put(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(closest[-1], len(out.tokens))
            out.blocks.append(block)
            out.tokens.append(("", block))
        text = html.unescape(text)
        block.pieces.append(text)
        if links:
            block.links += len(text.split())

    def tag(name: str) -> None:
        nonlocal block
        if name.removeprefix("/") not in INLINE and name not in RAW:
            block = None
        out.tokens.append((name, None))

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            put(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if shut[name]:
                while True:
                    last = out.names[stack.pop()]
                    closest.pop()
                    shut[last] -= 1
                    links -= last == "a"
                    if last == name:
                        break
            tag("/" + name)
            continue
        while (last := out.names[closest[-1]]) in CLOSES and name in CLOSES[last]:  # an end that HTML implies
            while True:
                gone = out.names[stack.pop()]
                closest.pop()
                shut[gone] -= 1
                links -= gone == "a"
                if gone == last:
                    break
        tag(name)
        if name in RAW:
            at = raw_end(name).search(page, at).end()
        elif name not in VOID:
            out.names.append(name)
            out.parents.append(stack[-1])
            out.said.append(said_words(m[3]) if m[3] else ())
            out.words.append(0)
            stack.append(len(out.names) - 1)
            closest.append(stack[-1] if name not in INLINE else closest[-1])
            shut[name] += 1
            links += name == "a"
    for b in out.blocks:
        b.text, b.pieces = "".join(b.pieces), []
        b.words = len(b.text.split())
        out.words[b.element] += b.words
    for e in range(len(out.names) - 1, 0, -1):  # parents come before their children
        out.words[out.parents[e]] += out.words[e]
    return out


def _bucket(n: int) -> int:
    return min(7, n.bit_length())


def describe(page: Page) -> None:
    """Fills in the features of elements and blocks. What is said of an element holds for all in it, so each is looked at once."""
    names, parents, n = page.names, page.parents, len(page.names)
    total = max(1, page.words[0])
    furniture, article, plain, best_in = [False] * n, [False] * n, [False] * n, [False] * n
    for e in range(1, n):
        up = parents[e]
        furniture[e] = furniture[up] or names[e] in FURNITURE
        article[e] = article[up] or names[e] in ARTICLE
        plain[e] = names[e] in ARTICLE or (plain[up] and names[e] not in FURNITURE and not page.said[e])
    prose: Counter = Counter()
    for b in page.blocks:
        if b.words >= 5 and not furniture[b.element]:
            e = parents[b.element] if names[b.element] in ("p", "li", "blockquote", "h1", "h2", "h3", "pre", "dd") else b.element
            prose[e] += b.words - b.links
            prose[parents[e]] += (b.words - b.links) / 2
    prose.pop(0, None)
    best = max(prose, key=lambda e: (prose[e], -e)) if prose else 0
    # Whether the page's article is one: most pages that have the element keep the story in it.
    held = sum(b.words for b in page.blocks if article[b.element]) / total
    page_has = "none" if not any(article) else "most" if held >= 0.3 else "some"
    page.features = [()] * n
    path, active = [0], set()  # the elements around the current one, and what they say
    for e in range(1, n):
        up = parents[e]
        while path[-1] != up:
            active.difference_update(page.features[path.pop()])
        best_in[e] = best_in[up] or e == best
        size = "inner" if article[up] else "big" if page.words[e] >= 0.5 * total else "small"
        own = {f"t:{names[e]}", *(f"{w}@{size}" for w in page.said[e])}
        if article[up] and names[e] in FURNITURE:
            own.add("art:furniture")
        page.features[e] = tuple(own - active)
        active.update(page.features[e])
        path.append(e)
    seen = False
    for i, b in enumerate(page.blocks):
        e = b.element
        seen = seen or best_in[e]
        b.inner = best_in[e] or (article[e] and page_has == "most")
        b.features = (
            f"in:{page_has}:{article[e]}",
            f"plain:{plain[e]}",
            f"best:{best_in[e]}:{page_has == 'most'}",
            f"own:{names[e]}",
            f"furniture:{furniture[e]}",
            f"n:{_bucket(b.words)}",
            f"links:{min(3, 4 * b.links // max(1, b.words))}",
            f"ends:{bool(_ENDS.search(b.text))}",
            f"marks:{_bucket(len(_MARKS.findall(b.text)))}",
            f"after:{seen and not best_in[e]}",
            f"before:{_bucket(page.blocks[i - 1].words) if i else 'none'}",
            f"next:{_bucket(page.blocks[i + 1].words) if i + 1 < len(page.blocks) else 'none'}",
            f"sign:{'©' in b.text}",
            "all",
        )


@dataclass
class Weights:
    """Log odds by feature of a block, and the scores of tags, which are below zero."""

    block: dict[str, float]
    tag: dict[str, float]

    def scores(self, page: Page) -> list[float]:
        """Of the page's blocks: what the elements around say is summed up on the way down."""
        get = self.block.get
        around = [0.0] * len(page.names)
        for e in range(1, len(around)):
            around[e] = around[page.parents[e]] + sum(get(f, 0.0) for f in page.features[e])
        return [around[b.element] + sum(get(f, 0.0) for f in b.features) for b in page.blocks]


def features_of(page: Page, block: Block) -> set[str]:
    """All features of a block: its own and those of the elements around it."""
    out, e = set(block.features), block.element
    while e:
        out.update(page.features[e])
        e = page.parents[e]
    return out


def learn(labelled: list[tuple[str, str]], strength: float = 0.3, rounds: int = 9) -> Weights:
    """Weights from pages with their main text: a block counts as inside if its text is found in the main text.

    The block model is logistic regression with an L2 penalty. A tag's score is a share
    (TAG_SCALE) of its log odds of being inside, so that a short last paragraph outweighs the tags before it.
    """
    rows, target, inside, seen = [], [], Counter(), Counter()
    for source, main in labelled:
        page, have = parse(source), " ".join(main.split())
        describe(page)
        truth = [" ".join(b.text.split()) in have for b in page.blocks]
        rows += [features_of(page, b) for b in page.blocks]
        target += truth
        within = [k for k, (name, b) in enumerate(page.tokens) if b is not None and " ".join(b.text.split()) in have]
        for k, (name, b) in enumerate(page.tokens):
            if b is None:
                name = name.removeprefix("/")
                seen[name] += 1
                inside[name] += bool(within) and within[0] < k < within[-1]
    names = sorted(set().union(*rows))
    number = {f: i for i, f in enumerate(names)}
    # Blocks that look the same are one row, with how many of them are inside.
    alike: dict[frozenset[str], list[int]] = {}
    for r, inner in zip(rows, target, strict=True):
        n = alike.setdefault(frozenset(r), [0, 0])
        n[0] += 1
        n[1] += inner
    # Rows have few features of many, so products are summed over the features, and pairs of them, that rows have.
    has = [np.array([number[f] for f in r]) for r in alike]
    size, k = np.array([len(r) for r in has]), len(names)
    of, at = np.repeat(np.arange(len(has)), size), np.concatenate(has)
    pairs = np.concatenate([(r[:, None] * k + r).ravel() for r in has])
    of_pair = np.repeat(np.arange(len(has)), size * size)
    (m, y), w = np.array(list(alike.values()), float).T, np.zeros(k)
    for _ in range(rounds):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at]), -30, 30)))
        slope = np.bincount(at, (m * p - y)[of], k) + strength * w
        bend = np.bincount(pairs, (m * p * (1 - p))[of_pair], k * k).reshape(k, k) + strength * np.eye(k)
        w = w - np.linalg.solve(bend, slope)
    tags = {t: min(TAG_MOST, max(TAG_LEAST, TAG_SCALE * float(np.log((inside[t] + 0.5) / (seen[t] - inside[t] + 0.5)) - 1))) for t in seen}
    return Weights({f: float(v) for f, v in zip(names, w, strict=True)}, tags)


#: Bounds of a tag's score, and of a word's.
TAG_LEAST, TAG_MOST, WORD_LEAST, WORD_MOST = -0.5, -0.01, -3.0, 1.0
TAG_SCALE = 0.05
#: A run of blocks that are left out costs the region no more than this: a menu between two halves of a story,
#: and an advert in the middle of one.
BRIDGE, INNER_BRIDGE = 6.0, 0.5


@lru_cache(maxsize=64)
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*(?:>|\Z)|\Z", re.I)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous region of the greatest positive sum; the first of equals, (0, 0) if none."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


# Words that classes and ids of furniture are made of, and those of main texts.
SAID = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs toolbar pagination pager",
    "header": "header masthead topbar banner",
    "footer": "footer copyright colophon",
    "aside": "sidebar aside related recommended widget widgets rail toc tags",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promoted promotion",
    "notice": "cookie cookies consent gdpr notice popup modal overlay paywall alert newsletter subscribe signup",
    "comments": "comment comments reply replies discussion disqus respond guestbook",
    "form": "form search searchbox login share sharing social",
}
CONTENT_WORDS = "article content post entry story body text"
#: Labelled pages that the weights are learned from.
PAGES = 1400


class Layouts:
    """Labelled pages of varied layouts, written by rule from a seed: each is (html, main text, name of its shell)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "bdfglmnprst", "aeiou"
        self.words = ["".join(self.r.choice(letters[k % 2]) for k in range(self.r.randrange(2, 9))) for _ in range(900)]

    def say(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high))).capitalize()

    def sentences(self, low: int, high: int) -> str:
        mark = self.r.choice([".", ".", ".", ".", "!", "?", "%%%.", "###", " © 1."])
        return " ".join(self.say(4, 18) + mark for _ in range(self.r.randint(low, high)))

    def named(self, kind: str) -> str:
        """A class or id that says what kind of furniture an element is; now and then a compound."""
        word = self.r.choice(SAID[kind].split())
        if self.r.random() < 0.3:
            word = self.r.choice([f"{word}-{self.r.choice(self.words)}", f"{self.r.choice(['site', 'page', 'main', 'the'])}-{word}", f"{word}_box"])
        return f'{self.r.choice(["class", "class", "id"])}="{word}"'

    def decoy(self) -> str:
        """A class that has a word of furniture in it and means something else."""
        word = self.r.choice(" ".join(SAID.values()).split())
        return f'class="{self.r.choice(["has", "no", "with"])}-{word}"' if self.r.random() < 0.5 else f'class="{word}-{self.r.choice(["free", "of", "fixed", "enabled", "open"])}-{self.r.choice(self.words)}"'

    def links(self, low: int, high: int, kind: str = "li") -> str:
        return "".join(f"<{kind}><a href=/{self.r.choice(self.words)}>{self.say(1, 4)}</a></{kind}>" for _ in range(self.r.randint(low, high)))

    def menu(self, how: int) -> str:
        body = f"<ul>{self.links(3, 12)}</ul>"
        return ["", f"<nav>{body}</nav>", f"<div {self.named('menu')}>{body}</div>", body, f"<table><tr>{self.links(3, 9, 'td')}</tr></table>"][how]

    def block(self, kind: str, tag: str, inner: str) -> str:
        return f"<{tag}>{inner}</{tag}>" if tag != "div" else f"<div {self.named(kind)}>{inner}</div>"

    def comments(self, how: int) -> str:
        said = [f"<b>{self.say(1, 2)}</b> <p>{self.sentences(1, 3)}</p>" for _ in range(self.r.randint(1, 7))]
        if how == 1:
            return f"<section {self.named('comments')}>{''.join(said)}</section>"
        if how == 2:
            return f"<div {self.named('comments')}>" + "".join(f'<article class="comment">{x}</article>' for x in said) + "</div>"
        if how == 3:
            return f"<ol {self.named('comments')}>" + "".join(f"<li>{x}</li>" for x in said) + "</ol>"
        if how == 4:
            return f"<div><h3>{self.say(1, 2)}</h3>" + "".join(f"<div>{x}</div>" for x in said) + "</div>"
        return ""

    def story(self) -> tuple[str, str]:
        """The markup of a story with things inside that aren't part of it, and its text."""
        r, out, text = self.r, [], []

        def add(markup: str, said: str) -> None:
            out.append(markup.format(html.escape(said)))
            text.append(said)

        if r.random() < 0.8:
            add("<h1>{}</h1>", self.say(2, 9))
        if r.random() < 0.2:
            add("<p>{}</p>", self.say(2, 4))
        for _ in range(r.choice([1, 1, 2, 3, 5, 9, 16])):
            x = r.random()
            if x < 0.08:
                add("<h2>{}</h2>", self.say(1, 5))
            elif x < 0.13:
                add("<blockquote>{}</blockquote>", self.sentences(1, 2))
            elif x < 0.18:
                items = [self.say(2, 9) for _ in range(r.randint(2, 5))]
                out.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
                text += items
            elif x < 0.22:
                add("<figure><img src=x><figcaption>{}</figcaption></figure>", self.say(3, 9))
            elif x < 0.27:
                out.append(r.choice([f"<div {self.named('advert')}>{self.sentences(1, 2)}</div>", f"<aside>{self.sentences(1, 1)}</aside>", f"<form><label>{self.say(1, 3)}</label><input></form>", f"<div {self.named('form')}>{self.links(2, 4, 'span')}</div>"]))
            elif x < 0.33:
                add(f"<p {self.decoy()}>{{}}</p>", self.sentences(1, 3))
            else:
                add(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}</b></p>", "<p>{}<br>"]), self.sentences(1, 7))
        return "".join(out), " ".join(text)

    def page(self) -> tuple[str, str, str]:
        r = self.r
        body, text = self.story()
        shell = r.randrange(14)
        said = r.sample(CONTENT_WORDS.split(), 2)
        main = [
            "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div>{}</div>", "<div><div>{}</div></div>", "<section>{}</section>",
            '<div class="CONTENT">{}</div>', '<div id="CONTENT-area"><div>{}</div></div>', "<table><tr><td>{}</td></tr></table>", "<article><div>{}</div></article>", "<article><header>{}</article>", "TWO",
            '<div class="CONTENT-MORE">{}</div>', '<section id="CONTENT_MORE"><div class="MORE">{}</div></section>',
        ][shell].replace("CONTENT", said[0]).replace("MORE", said[1])
        menu, comments = r.randrange(5), r.randrange(5)
        if main == "TWO":
            other, more = self.story()
            main, text = f"<article>{body}</article>{self.menu(r.randint(1, 2))}<article>{other}</article>", f"{text} {more}"
        elif "<header>" in main:
            main = main.format(f"{self.say(1, 3)}</header>" + body)
        else:
            main = main.format(body)
        if comments and r.random() < 0.25 and main.endswith("</article>"):
            main = main.removesuffix("</article>") + self.comments(r.choice([1, 2, 3])) + "</article>"
            comments = 0
        furniture = [
            lambda: self.block("header", r.choice(["header", "div"]), f"<h2>{self.say(1, 3)}</h2> {self.say(1, 5)}"),
            lambda: self.menu(menu),
            lambda: self.block("notice", r.choice(["div", "div", "dialog"]), self.sentences(1, 3)),
            lambda: self.block("advert", "div", self.sentences(1, 4)),
            lambda: f'<div class="text">{self.sentences(1, 1)}</div>' if r.random() < 0.3 else "",
        ]
        after = [
            lambda: self.block("aside", r.choice(["aside", "div"]), f"<h3>{self.say(1, 2)}</h3>{r.choice([self.links(2, 6), '<p>' + self.sentences(1, 2) + '</p>'])}"),
            lambda: self.comments(comments),
            lambda: self.block("form", r.choice(["form", "div"]), f"<label>{self.say(1, 4)}</label><input><button>{self.say(1, 1)}</button>"),
            lambda: self.block("footer", r.choice(["footer", "div"]), r.choice([f"&copy; {self.say(2, 9)}.", f"&copy; {self.say(1, 2)} &middot; {self.sentences(1, 6)}", self.links(2, 5), self.sentences(1, 4)])),
        ]
        before = "".join(f() for f in furniture if r.random() < 0.6)
        after = "".join(f() for f in after if r.random() < 0.7)
        whole = f"{before}{main}{after}"
        wrap = r.randrange(4)
        if wrap:
            whole = f"<div {[self.decoy(), 'class=page', 'id=wrap'][wrap - 1]}>{whole}</div>"
        return f"<html><head><title>{self.say(1, 4)}</title></head><body>{whole}</body></html>", text, f"{shell}.{menu}.{comments}"


@lru_cache(maxsize=1)
def weights() -> Weights:
    """The weights learned from PAGES labelled pages."""
    layouts = Layouts(1)
    return learn([layouts.page()[:2] for _ in range(PAGES)])


def main_text(source: str | None, w: Weights | None = None) -> str:
    """The main text: blocks in page order, white space as single spaces; empty if there is none."""
    if not source:
        return ""
    w = w or weights()
    page = parse(source)
    describe(page)
    odds = {id(b): max(WORD_LEAST, x) for b, x in zip(page.blocks, w.scores(page), strict=True)}
    scores, run, most = [], 0.0, INNER_BRIDGE
    for name, b in page.tokens:
        s = w.tag.get(name.removeprefix("/"), TAG_LEAST / 2) if b is None else min(WORD_MOST, odds[id(b)]) * b.words
        if b is not None and s > 0:
            run, most = 0.0, INNER_BRIDGE
        else:
            if b is not None and not b.inner:
                most = BRIDGE
            s = max(s, min(0.0, -most - run))
            run += s
        scores.append(s)
    first, last = best_region(scores)
    out: list[str] = []
    for name, b in page.tokens[first:last]:
        if b is None:
            if name.removeprefix("/") not in INLINE:
                out.append(" ")
        elif odds[id(b)] > 0:
            out += (" ", b.text, " ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page: the carried columns, text, n_chars (code points).

    A null or empty page, and one without text, gives an empty text. Every row gives one row; further columns
    are left out. Broken markup (open elements, cut references, cut tags) is read as far as it goes.
    """
    ready(pages.sparkSession)
    kinds = pages.select(*carry).schema.fields
    inner = [f"c{i}" for i in range(len(kinds))]
    shared = pages.sparkSession.sparkContext.broadcast(weights())

    def step(rows: dict[str, list]) -> dict[str, object]:
        texts = [main_text(p, shared.value) for p in rows["html"]]
        return {c: rows[c] for c in inner} | {"text": texts, "n_chars": [len(t) for t in texts]}

    taken = pages.select(*(F.col(f.name).alias(c) for f, c in zip(kinds, inner, strict=True)), F.col("html").alias("html"))
    schema = columns_of(*((c, f.dataType) for c, f in zip(inner, kinds, strict=True)), ("text", T.StringType()), ("n_chars", T.LongType()))
    found = map_rows(taken, step, schema, "html")
    return found.select(*(F.col(c).alias(f.name) for c, f in zip(inner, kinds, strict=True)), "text", "n_chars")
