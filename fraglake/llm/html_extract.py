"""Main text of web pages from a tree-structured graphical model.

A page becomes a tree of its block elements.  Each node is content or not.  Its own
features (what kind of element it is, words of its class and id, how much text it
has and how much of that is linked) give one potential; for each parent and child
there is a potential for the four combinations of their states, which depends on
whether the child is plain (a paragraph, a list, a division) or names a role of its
own.  Messages are passed up and down the tree (sum-product), which gives the
marginal probability of content for each node exactly.  A block of text is kept
when the node that holds it is likelier content than not.

The potentials are trained by gradient ascent on the likelihood of labelled pages;
:func:`labelled_pages` writes them (varied layouts, each block with its label).  It
runs on the driver with a fixed seed.

Blocks: character references are decoded, runs of white space become one space,
blocks are trimmed, empty ones left out, the others joined in page order by two line
breaks.  Comments, scripts, styles and markup are never text.

Defined results: null and empty pages have empty text; unclosed, misnested and
unknown tags are tolerated (an open paragraph ends where the next block begins, and
what is left open ends with the page); text without any element is one block;
null urls and ids, and repeated rows, are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements by what they do to the tree: fixed values.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp", "noembed", "noframes", "annotation", "annotation-xml"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded menclose mtable mtr mtd".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An open element of the values ends where the key begins.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("thead", "tbody"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
#: Such an end tag or implied end doesn't reach beyond these.
SCOPES = frozenset("table ul ol dl body html article section main aside nav header footer div form select".split())

#: Words in class, id and role, by what they suggest: fixed values.
HINTS = {
    "content": "article articlebody body-text content entry entry-content hentry main main-content post post-body post-content story text prose",
    "navigation": "breadcrumb breadcrumbs crumbs menu nav navbar navigation pager pagination paging tabs toc toolbar topbar skip links",
    "furniture": "banner bottom colophon copyright footer header masthead site-footer site-header logo legal",
    "aside": "aside author-box bio complementary promo recommended related sidebar sidebar-left sidebar-right side widget widgets read-more teaser trending popular tags",
    "notice": "alert consent cookie cookies gdpr info-bar modal newsletter notice overlay popup subscribe subscription paywall warning toast login signup",
    "advert": "ad ads advert adverts advertisement adsense sponsor sponsored sponsors doubleclick",
    "comments": "comment comment-list comments discussion disqus replies reply respond responses reviews comment-body thread",
    "share": "facebook share sharing social twitter follow",
}
_HINT_OF = {w: name for name, words in HINTS.items() for w in words.split()}

KINDS = {
    "root": "html body", "article": "article", "main": "main", "section": "section", "div": "div center", "p": "p pre blockquote figure figcaption details summary address",
    "head": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu dir", "item": "li dt dd", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form fieldset button select option optgroup legend input dialog output", "table": "table thead tbody tfoot tr td th caption",
}
_KIND_OF = {t: kind for kind, tags in KINDS.items() for t in tags.split()}
PLAIN = frozenset(("div", "p", "head", "list", "item", "table", "section", "other"))
FEATURES = ("bias", *(f"kind {k}" for k in (*KINDS, "other")), *(f"hint {h}" for h in HINTS), "no text", "short", "medium", "long", "linked", "half linked", "ends like a sentence")
_NUMBER = {f: i for i, f in enumerate(FEATURES)}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_VALUE = re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_SENTENCE_END = tuple(".!?…。」”\"")


@dataclass
class Node:
    """A block element; text of its own is in parts, each ``(order, pieces)``."""

    tag: str
    parent: int
    hints: frozenset[str]
    blocks: list[tuple[int, list[str]]]
    linked: int = 0


class Tags:
    """The markup of a page, in order, in time that is linear in its length.

    A quote opens a value only where it follows an equals sign, and only if it is
    closed somewhere; elsewhere it is a character like others.
    """

    def __init__(self, html: str) -> None:
        self._html = html
        self._absent: set[str] = set()  # what wasn't found once isn't found farther on

    def _find(self, what: str, at: int) -> int:
        if what in self._absent:
            return -1
        found = self._html.find(what, at)
        if found < 0:
            self._absent.add(what)
        return found

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends, after its ``>``; -1: it doesn't."""
        while True:
            close = self._find(">", at)
            if close < 0:
                return -1
            quoted = _VALUE.search(self._html, at, close)
            if quoted is None:
                return close + 1
            end = self._find(quoted[1], quoted.end())
            at = end + 1 if end >= 0 else quoted.end()

    def after(self, tag: str, at: int) -> int:
        """After the end tag of an element whose content isn't markup; the page's end where there is none."""
        html = self._html
        while (at := self._find("</", at)) >= 0:
            if html[at + 2 : at + 2 + len(tag)].lower() == tag and html[at + 2 + len(tag) : at + 3 + len(tag)] in (">", "/", "", " ", "\t", "\n", "\r", "\f"):
                close = self._find(">", at)
                return close + 1 if close >= 0 else len(html)
            at += 2
        return len(html)

    def next(self, at: int) -> tuple[int, int, str | None, str] | None:
        """From ``at`` on: where the next markup begins and ends, its name in lower case (with / before it: an end tag; None: a comment or the like), its attributes."""
        html = self._html
        while (start := self._find("<", at)) >= 0:
            at = start + 1
            if html.startswith("!--", at):
                end = self._find("-->", at + 3)
                return start, end + 3 if end >= 0 else len(html), None, ""
            if html[at : at + 1] in ("!", "?"):
                end = self._find(">", at)
                if end >= 0:
                    return start, end + 1, None, ""
                continue
            name = _NAME.match(html, at)
            if name is not None and (end := self._end(name.end())) >= 0:
                return start, end, name[0].lower(), html[name.end() : end - 1]
        return None


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> frozenset[str]:
    found = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            found.add("notice")
        for word in _WORD.findall(value):
            for w in (word, *word.split("-")):
                if w in _HINT_OF:
                    found.add(_HINT_OF[w])
    return frozenset(found)


def parse(html: str) -> list[Node]:
    """The tree of block elements, parents first."""
    nodes = [Node("html", -1, frozenset(), [])]
    open_: list[tuple[str, int]] = [("html", 0)]  # block elements only
    order, links, fresh, at = 0, 0, True, 0

    def text(piece: str) -> None:
        nonlocal order, fresh
        if not piece:
            return
        node = nodes[open_[-1][1]]
        if fresh or not node.blocks:
            if piece.isspace():
                return
            node.blocks.append((order, []))
            order += 1
            fresh = False
        if "&" in piece:
            piece = unescape(piece)
        node.blocks[-1][1].append(piece)
        if links:
            node.linked += len(piece)

    places: dict[str, list[int]] = {}  # where each tag is open, and where scopes are
    scopes: list[int] = []

    def close(tags: tuple[str, ...] | frozenset[str], beyond: bool) -> None:
        nonlocal fresh
        k = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if not k or (not beyond and scopes and scopes[-1] > k):
            return
        while len(open_) > k:
            gone, _ = open_.pop()
            places[gone].pop()
            if gone in SCOPES:
                scopes.pop()
        fresh = True

    tags = Tags(html)
    while (found := tags.next(at)) is not None:
        start, end, tag, attributes = found
        if start > at:
            text(html[at:start])
        at = end
        if tag is None:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag not in VOID and tag not in ("html", "body"):
                close((tag,), True)
            continue
        if tag == "br":
            text(" ") if not fresh else None
            continue
        if tag in RAW:
            if not (tag == "svg" and attributes.endswith("/")):
                at = tags.after(tag, end)
            continue
        if tag in VOID:
            if tag == "hr":
                close(("p",), False)
                fresh = True
            continue
        if tag == "a":
            links += 1
            continue
        if tag in INLINE or attributes.endswith("/"):
            continue
        links = 0
        if tag in ENDS_P:
            close(("p",), False)
            if tag[0] == "h" and tag[1:].isdigit():
                close(("h1", "h2", "h3", "h4", "h5", "h6"), False)
        if tag in ENDS:
            close(ENDS[tag], False)
        if tag in ("head", "html"):
            continue
        nodes.append(Node(tag, open_[-1][1], _hints(attributes) if attributes else frozenset(), []))
        open_.append((tag, len(nodes) - 1))
        places.setdefault(tag, []).append(len(open_) - 1)
        if tag in SCOPES:
            scopes.append(len(open_) - 1)
        fresh = True
    if at < len(html):
        text(html[at:])
    return nodes


def _joined(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def describe(nodes: list[Node]) -> tuple[list[list[int]], list[int], list[bool], list[tuple[int, int, str]]]:
    """Feature numbers and parents of the nodes, whether each is plain, and the blocks (order, node, text)."""
    features, plain, blocks = [], [], []
    for k, node in enumerate(nodes):
        texts = [(order, _joined(pieces)) for order, pieces in node.blocks]
        texts = [(order, t) for order, t in texts if t]
        blocks += [(order, k, t) for order, t in texts]
        size = sum(len(t) for _, t in texts)
        kind = _KIND_OF.get(node.tag, "other")
        mine = [0, _NUMBER["kind " + kind], *(_NUMBER["hint " + h] for h in node.hints)]
        if not size:
            mine.append(_NUMBER["no text"])
        else:
            mine.append(_NUMBER["short" if size < 40 else "medium" if size < 160 else "long"])
            if node.linked > 0.9 * size:
                mine.append(_NUMBER["linked"])
            elif node.linked > 0.4 * size:
                mine.append(_NUMBER["half linked"])
            if texts[-1][1].endswith(_SENTENCE_END):
                mine.append(_NUMBER["ends like a sentence"])
        features.append(mine)
        plain.append(kind in PLAIN and not node.hints)
    return features, [n.parent for n in nodes], plain, blocks


@dataclass(frozen=True)
class Model:
    """Log potentials: ``unary`` by feature, for content against not; ``pair[plain][parent state][child state]``."""

    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, features: list[list[int]], parents: list[int], plain: list[bool]) -> tuple[list[float], list[list[list[float]] | None]]:
        """By sum-product: the chance of content for each node, and of each combination of a node's parent and itself."""
        weights, pots = self.unary.tolist(), np.exp(self.pair).tolist()
        n = len(parents)
        local = []
        for mine in features:
            z = sum(weights[f] for f in mine)
            p = 1 / (1 + np.exp(-z)) if -500 < z < 500 else float(z > 0)
            local.append((1 - float(p), float(p)))
        below = [list(x) for x in local]  # the node's own potential times the messages of its children
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            a, b = below[k]
            s = a + b
            a, b = a / s, b / s
            below[k] = [a, b]
            t = pots[plain[k]]
            up[k] = (t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b)
            q = below[parents[k]]
            q[0] *= up[k][0]
            q[1] *= up[k][1]
            s = q[0] + q[1]
            q[0] /= s
            q[1] /= s
        belief = [[0.0, 0.0]] * n
        pairs: list[list[list[float]] | None] = [None] * n
        s = sum(below[0])
        belief[0] = [below[0][0] / s, below[0][1] / s]
        for k in range(1, n):
            q, t = belief[parents[k]], pots[plain[k]]
            out = (q[0] / up[k][0] if up[k][0] else 0.0, q[1] / up[k][1] if up[k][1] else 0.0)  # the parent without this child
            joint = [[out[i] * t[i][j] * below[k][j] for j in (0, 1)] for i in (0, 1)]
            s = sum(map(sum, joint)) or 1.0
            joint = [[x / s for x in row] for row in joint]
            pairs[k] = joint
            belief[k] = [joint[0][0] + joint[1][0], joint[0][1] + joint[1][1]]
        return [b[1] for b in belief], pairs

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        features, parents, plain, blocks = describe(parse(html))
        content, _ = self.marginals(features, parents, plain)
        return "\n\n".join(t for _, k, t in sorted(blocks) if content[k] >= 0.5)


def train(pages: list[tuple[str, set[str]]], *, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Maximum likelihood from pages and the texts of their content blocks.

    A node is content when it holds a content block, or, having no text of its own,
    when most of the text below it is content.
    """
    examples = []
    for html, wanted in pages:
        features, parents, plain, blocks = describe(parse(html))
        inside, total = [0] * len(parents), [0] * len(parents)
        own: list[bool | None] = [None] * len(parents)
        for _, k, t in blocks:
            own[k] = t in wanted
            total[k] += len(t)
            inside[k] += len(t) * (t in wanted)
        for k in range(len(parents) - 1, 0, -1):
            total[parents[k]] += total[k]
            inside[parents[k]] += inside[k]
        state = [int(o if o is not None else 2 * i > t) for o, i, t in zip(own, inside, total, strict=True)]
        examples.append((features, parents, plain, state))
    unary, pair = np.zeros(len(FEATURES)), np.zeros((2, 2, 2))
    squares, pair_squares = np.full(len(FEATURES), 1e-8), np.full((2, 2, 2), 1e-8)
    nodes = sum(len(e[1]) for e in examples)
    for _ in range(epochs):
        g, h, model = np.zeros(len(FEATURES)), np.zeros((2, 2, 2)), Model(unary, pair)
        for features, parents, plain, state in examples:
            content, pairs = model.marginals(features, parents, plain)
            for k, mine in enumerate(features):
                off = state[k] - content[k]
                for f in mine:
                    g[f] += off
                if k:
                    h[int(plain[k]), state[parents[k]], state[k]] += 1
                    h[int(plain[k])] -= pairs[k]
        g, h = g / nodes - decay * unary, h / nodes - decay * pair
        squares, pair_squares = squares + g * g, pair_squares + h * h
        unary, pair = unary + rate * g / np.sqrt(squares), pair + rate * h / np.sqrt(pair_squares)
    return Model(unary, pair)


def labelled_pages(n: int = 120, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages of varied layouts made for training: html, and the texts of the blocks that are content."""
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni or pu ra se ti vo xa ze".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 6, hi: int = 18) -> str:
        return words(lo, hi).capitalize() + "."

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    pages = []
    for _ in range(n):
        wanted: set[str] = set()

        def keep(text: str) -> str:
            wanted.add(text)  # noqa: B023
            return text

        def body_part() -> str:
            kind, out = rng.random(), ""
            if kind < 0.2:
                out = f"<p>{keep(sentence(1, 8))}" + rng.choice(("</p>", "</p>", "<br>\n"))
            elif kind < 0.7:
                out = f"<p>{keep(' '.join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 8)))))}" + rng.choice(("</p>", "</p>", "\n"))
            elif kind < 0.78:
                out = f"<h2>{keep(words(1, 6))}</h2>"
            elif kind < 0.86:
                out = "<ul>" + "".join(f"<li>{keep(sentence(3, 9))}</li>" for _ in range(3)) + "</ul>"
            elif kind < 0.91:
                out = f"<blockquote><p>{keep(sentence())}</p></blockquote>"
            elif kind < 0.95:
                out = "<table>" + "".join(f"<tr><td>{keep(words(1, 2))}</td><td>{keep(words(1, 3))}</td></tr>" for _ in range(2)) + "</table>"
            else:
                out = f"<p>{keep(words(1, 3))}.</p>".replace(".</p>", "</p>")
            return out

        parts = []
        if rng.random() < 0.4:
            parts.append(rng.choice((f"<header><p>{words(2, 5)}</p></header>", f'<div class="header"><h1>{words(1, 3)}</h1><p>{sentence()}</p></div>', f'<header id="masthead"><a href="/">{words(1, 2)}</a></header>')))
        if rng.random() < 0.8:
            parts.append(rng.choice(("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="navigation">{}</ul>', "<ul>{}</ul>")).format(links(rng.randint(3, 8))))
        clutter = [
            lambda: f'<div class="{rng.choice(("ad", "ads", "advert", "sponsored"))}">{sentence()} {sentence()}</div>',
            lambda: f'<div class="{rng.choice(("cookie-notice", "alert", "newsletter", "consent", "notice"))}"><p>{sentence()}</p></div>',
            lambda: f"<form><label>{words(1, 2)}</label><p>{sentence()}</p><button>{words(1, 1)}</button></form>",
            lambda: f"<aside><h3>{words(1, 3)}</h3><p>{sentence()}</p><ul>{links(3)}</ul></aside>",
            lambda: f'<div class="{rng.choice(("sidebar", "related", "widget", "promo"))}"><p>{sentence()}</p><p>{sentence()} {sentence()}</p></div>',
            lambda: f'<div class="{rng.choice(("share", "social"))}"><a href="#">{words(1, 1)}</a> <a href="#">{words(1, 1)}</a></div>',
        ]
        comments = [
            lambda: f'<section class="comments"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{sentence()} {sentence()}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
            lambda: '<div id="comments"><ol>' + "".join(f"<li><p>{sentence()}</p><p>{sentence()}</p></li>" for _ in range(rng.randint(1, 4))) + "</ol></div>",
            lambda: '<ul class="replies">' + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>",
        ]
        parts += [rng.choice(clutter)() for _ in range(rng.choice((0, 1, 1, 2)))]
        title = f"<h1>{keep(words(2, 9))}</h1>"
        inner = [title, *(body_part() for _ in range(rng.choice((1, 1, 1, 2, 3, 5, 9))))]
        if rng.random() < 0.3:
            inner.insert(rng.randint(1, len(inner)), rng.choice(clutter)())
        if rng.random() < 0.15:
            inner.append(rng.choice(comments)())
        opening, closing = rng.choice((("<article>", "</article>"),) * 4 + (("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post">', "</div></div>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"), ("<section>", "</section>")))
        parts.append(opening + "".join(inner) + closing)
        if rng.random() < 0.3:
            parts.append(rng.choice(comments)())
        parts += [rng.choice(clutter)() for _ in range(rng.choice((0, 0, 1, 2)))]
        if rng.random() < 0.8:
            parts.append(rng.choice((f"<footer>&copy; {words(1, 2)} &middot; {sentence()} {sentence()}</footer>", f'<div class="footer"><p>{sentence()}</p><ul>{links(3)}</ul></div>', f"<footer><p>{sentence()}</p></footer>")))
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{''.join(parts)}</body></html>", wanted))
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def main_text(html: Column | str, model: Model | None = None) -> Column:
    """The main text of a page; empty if none."""
    model = model or default_model()

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([model.extract(h.as_py()) for h in column], type=pa.string())

    return of(html)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(html_col, model).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
