"""Main text of web pages by gradient-boosted trees over DOM-node features.

A page is parsed into block-level nodes. Each gets features of its subtree (text, links,
density), its tag and attribute tokens, its depth and its siblings; boosted trees give it
the odds of being a container (around the article), main text or boilerplate. Decoding is
hierarchical: the labels of the whole tree are chosen together so that nothing below
boilerplate is main text and nothing below main text is a container.

The trees are fitted in numpy on labelled pages drawn from a seeded generator of page
layouts (semantic tags or classed divs; menus, headers, footers, sidebars, notices,
adverts, forms, related links, reader comments), so no outside data are needed.

Text of a block has its character references decoded and its white space (as Unicode
knows it) collapsed; ``br`` is white space. Defined cases: null, empty and text-less pages
give an empty text; unclosed, stray and deeply nested tags are accepted; markup that isn't
closed reaches to the page's end and isn't text; repeated rows yield repeated rows. Extra
columns are ignored; page_id may be of any type.
"""

from __future__ import annotations

import html
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trawl.shipping import ship

ship(__name__)

CONTAINER, MAIN, BOILER = 0, 1, 2
TRAINING_PAGES, SEED = 800, 5
#: each round sees this share of the nodes
ROUNDS, DEPTH, BINS, SHRINK, LAMBDA, SHARE = 60, 4, 32, 0.25, 1.0, 0.4

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: what ends a tag, or opens a quoted value in it
_STOPS = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECES = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}(?:\s[^>]*)?>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}

# HTML's element classes.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: a start tag of the key closes an open element of the value
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: tags that share a feature
TAGS = {
    "article": 0, "main": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "p": 2, "blockquote": 2, "pre": 2,
    "ul": 3, "ol": 3, "dl": 3, "li": 4, "dt": 4, "dd": 4, "nav": 5, "menu": 5, "header": 6, "footer": 7, "aside": 8,
    "form": 9, "fieldset": 9, "button": 9, "select": 9, "option": 9, "dialog": 9, "div": 10, "section": 10, "html": 11, "body": 11, "head": 12,
    "table": 13, "thead": 13, "tbody": 13, "tr": 13, "td": 14, "th": 14, "caption": 14, "figure": 15, "figcaption": 15, "#text": 16,
}
N_TAGS = 17
#: words in class, id and role attributes that share a feature
TOKENS = {
    0: "content article main post entry story body text blog page",
    1: "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    2: "header masthead topbar top logo branding",
    3: "footer bottom copyright legal colophon",
    4: "sidebar aside rail widget related recommended trending popular tags",
    5: "ad ads advert advertisement adverts sponsor sponsored promo promotion banner",
    6: "notice cookie cookies consent gdpr popup modal alert message overlay privacy",
    7: "comment comments respond reply replies disqus discussion reader",
    8: "form login signup newsletter subscribe search contact share social follow",
    9: "container wrap wrapper outer site layout row",
}
_TOKEN_OF = {w: k for k, ws in TOKENS.items() for w in ws.split()}
N_TOKENS = len(TOKENS)
#: bits of the words that speak of boilerplate
SPEAKING = sum(1 << k for k in range(1, 9))


#: tags whose loose text, where blocks stand beside it, is a block of its own
LOOSE = "#text"


def _tags(source: str):
    """(start, end, name, closing, attributes) of the markup of a page in one pass; name is empty for comments and the like.

    Markup that nothing ends reaches to the page's end. A quote that isn't closed doesn't quote.
    """
    at, size = 0, len(source)
    last = source.rfind(">")
    closed = {'"': True, "'": True}
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, "", False, ""
        elif m := _NAME.match(source, at + 1):
            i = m.end()
            if at > last:
                yield at, size, "", False, ""
                return
            while (stop := _STOPS.search(source, i)) and stop[1]:
                quote = stop[1]
                end = source.find(quote, stop.end()) if closed[quote] else -1
                closed[quote] = end >= 0
                i = stop.end() if end < 0 else end + 1
            if not stop:
                # a closed quote held the last end: there is none after it
                yield at, size, "", False, ""
                return
            end = stop.end()
            name = m[0].lower()
            yield at, end, name.lstrip("/"), name[0] == "/", source[m.end() : end - 1]
        elif source[at + 1 : at + 2] in ("!", "?", "/"):
            end = source.find(">", at)
            end = size if end < 0 else end + 1
            yield at, end, "", False, ""
        else:
            at += 1
            continue
        at = end


class Page:
    """Block nodes (parents first) and the pieces of text with their node, in page order; None is a break.

    Text that stands loose beside blocks, or in no block at all, gets nodes of its own behind the others.
    """

    __slots__ = ("parent", "tag", "names", "pieces", "links")

    def __init__(self, source: str | None):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.names: list[str] = [""]
        self.pieces: list[tuple[int, str] | None] = []
        self.links: list[bool] = []
        source = source or ""
        at, open_, anchor, names = 0, [0], 0, {}
        for start, end, name, closing, attributes in _tags(source):
            if start < at:  # within a script or the like
                continue
            if start > at:
                self._text(open_[-1], source[at:start], anchor > 0)
            at = end
            if not name:
                continue
            if name in INLINE:
                if name == "a":
                    anchor = 0 if closing else 1
                continue
            if name in VOID:
                if not closing:
                    self._text(open_[-1], " ", False)
                continue
            if closing:
                if names.get(name):
                    while self.tag[open_[-1]] != name:
                        names[self.tag[open_.pop()]] -= 1
                    names[self.tag[open_.pop()]] -= 1
                self._break()
                anchor = 0
                continue
            if name in _RAW:
                if not attributes.endswith("/"):
                    at = _RAW[name].search(source, at).end()
                continue
            if self.tag[open_[-1]] in CLOSES.get(name, ()) or self.tag[open_[-1]] == "p":
                names[self.tag[open_.pop()]] -= 1
            self._break()
            anchor = 0
            self.parent.append(open_[-1])
            self.tag.append(name)
            self.names.append(attributes)
            open_.append(len(self.tag) - 1)
            names[name] = names.get(name, 0) + 1
        if at < len(source):
            self._text(open_[-1], source[at:], anchor > 0)
        self._settle()

    def _settle(self) -> None:
        """Gives runs of loose text their own nodes."""
        blocks = {0, *self.parent, *(i for i, t in enumerate(self.tag) if t in ("html", "body"))}
        run = -1
        for i, piece in enumerate(self.pieces):
            if piece is None:
                run = -1
            elif piece[0] in blocks:
                if run < 0 or self.parent[run] != piece[0]:
                    if not piece[1].strip():
                        continue
                    run = len(self.tag)
                    self.parent.append(piece[0])
                    self.tag.append(LOOSE)
                    self.names.append("")
                self.pieces[i] = (run, piece[1])

    def _text(self, node: int, raw: str, linked: bool) -> None:
        self.pieces.append((node, html.unescape(raw) if "&" in raw else raw))
        self.links.append(linked)

    def _break(self) -> None:
        self.pieces.append(None)
        self.links.append(False)

    def text(self, labels: list[int]) -> str:
        """Blocks of main text, in page order."""
        blocks, now = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif labels[piece[0]] == MAIN:
                now.append(piece[1])
        return "\n".join(b for b in blocks if b)


def node_features(page: Page) -> np.ndarray:
    """(nodes, features); the last columns look at ancestors and siblings."""
    n = len(page.tag)
    parent = page.parent
    chars, linked, tags = [0] * n, [0] * n, [1] * n
    for piece, link in zip(page.pieces, page.links, strict=True):
        if piece is not None:
            size = len(piece[1].strip())
            chars[piece[0]] += size
            if link:
                linked[piece[0]] += size
    own_tag = [TAGS.get(t, -1) for t in page.tag]
    own_token = [0] * n
    for i, attributes in enumerate(page.names):
        if attributes:
            bits = 0
            for m in _NAMES.finditer(attributes):
                for w in _PIECES.findall((m[1] or m[2] or m[3] or "").lower()):
                    k = _TOKEN_OF.get(w, -1)
                    bits |= 1 << k if k >= 0 else 0
            own_token[i] = bits
    depth, above_tag, above_token, kids, paragraphs = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    place, direct = [0] * n, list(chars)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above_tag[i] = above_tag[p] | (1 << own_tag[p] if own_tag[p] >= 0 else 0)
        above_token[i] = above_token[p] | own_token[p]
        place[i] = kids[p]
        kids[p] += 1
        paragraphs[p] += own_tag[i] == 2
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        tags[p] += tags[i]
    same: dict[tuple[int, str], int] = {}  # children of one tag
    for i in range(1, n):
        same[parent[i], page.tag[i]] = same.get((parent[i], page.tag[i]), 0) + 1
    alike = [0] + [same[parent[i], page.tag[i]] for i in range(1, n)]
    x = np.zeros((n, 2 * (N_TAGS + N_TOKENS) + 17), np.float32)
    a = {k: np.array(v) for k, v in (("tag", own_tag), ("token", own_token), ("above_tag", above_tag), ("above_token", above_token))}
    for k in range(N_TAGS):
        x[:, k] = a["tag"] == k
        x[:, N_TAGS + k] = (a["above_tag"] >> k) & 1
    at = 2 * N_TAGS
    for k in range(N_TOKENS):
        x[:, at + k] = (a["token"] >> k) & 1
        x[:, at + N_TOKENS + k] = (a["above_token"] >> k) & 1
    at += 2 * N_TOKENS
    c, li, tg, par = (np.array(v, dtype=np.float64) for v in (chars, linked, tags, parent))
    up = np.maximum(par, 0).astype(int)
    rest = np.array(kids, dtype=np.float64)
    for k, v in enumerate(
        (
            np.log1p(c), li / np.maximum(c, 1), c / tg, np.log1p(tg), np.minimum(depth, 30), np.array(place), rest[up],
            np.array(place) / np.maximum(rest[up], 1), c / np.maximum(c[up], 1), c / max(c[0], 1), np.minimum(paragraphs, 20), np.log1p(direct),
            a["tag"][up], a["token"][up] & SPEAKING, (li / np.maximum(c, 1))[up], np.log1p(c)[up], np.minimum(alike, 30),
        )
    ):
        x[:, at + k] = v
    return x


def decode(parent: list[int], logp: np.ndarray) -> list[int]:
    """The best labels of a tree under: below MAIN no CONTAINER, below BOILER only BOILER."""
    n = len(parent)
    best = logp.tolist()
    for i in range(n - 1, 0, -1):
        c, m, b = best[i]
        mb = m if m > b else b
        p = best[parent[i]]
        p[CONTAINER] += c if c > mb else mb
        p[MAIN] += mb
        p[BOILER] += b
    out = [CONTAINER] * n
    for i in range(1, n):
        c, m, b = best[i]
        above = out[parent[i]]
        if above == BOILER:
            out[i] = BOILER
        elif above == MAIN or c < m or c < b:
            out[i] = MAIN if m >= b else BOILER
    return out


# --- boosted trees -------------------------------------------------------------------------


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree of DEPTH levels over binned features: feature and bin of each split, value of each leaf."""
    inner = 2**DEPTH - 1
    feature, cut, where = np.zeros(inner, np.int32), np.full(inner, BINS, np.int32), np.zeros(len(x), np.int64)
    n_f = x.shape[1]
    offsets = np.arange(n_f) * BINS
    for node in range(inner):
        rows = np.flatnonzero(where == node)
        if len(rows):
            flat = (x[rows] + offsets).ravel()
            sg = np.bincount(flat, np.repeat(g[rows], n_f), n_f * BINS).reshape(n_f, BINS).cumsum(axis=1)
            sh = np.bincount(flat, np.repeat(h[rows], n_f), n_f * BINS).reshape(n_f, BINS).cumsum(axis=1)
            tg, th = sg[:, -1:], sh[:, -1:]
            gain = sg**2 / (sh + LAMBDA) + (tg - sg) ** 2 / (th - sh + LAMBDA) - tg**2 / (th + LAMBDA)
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, b] > 1e-6:
                feature[node], cut[node] = f, b
            where[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    leaf = where - inner
    sg, sh = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
    return feature, cut, (-SHRINK * sg / (sh + LAMBDA)).astype(np.float32)


def _apply(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, cut, value = tree
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
    return value[at - (2**DEPTH - 1)]


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, BINS)[1:-1])) for f in x.T]
    binned = _bin(edges, x)
    z, trees, rng = np.zeros((len(x), 3), np.float32), [], np.random.default_rng(SEED)
    for _ in range(ROUNDS):
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        r = np.flatnonzero(rng.random(len(x)) < SHARE)
        grown = [_grow(binned[r], p[r, k] - (y[r] == k), p[r, k] * (1 - p[r, k])) for k in range(3)]
        for k, tree in enumerate(grown):
            z[:, k] += _apply(tree, binned)
        trees.append(grown)
    return {"edges": edges, "trees": trees}


def _bin(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T, strict=True)], axis=1)


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    binned = _bin(model["edges"], x)
    z = np.zeros((len(x), 3))
    for grown in model["trees"]:
        for k, tree in enumerate(grown):
            z[:, k] += _apply(tree, binned)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


# --- labelled layouts ----------------------------------------------------------------------


#: Begins loose text of a training page, followed by its label.
MARK = "\ue000"


def layout(rng: random.Random) -> str:
    """A page whose elements carry their label in a ``y`` attribute, which features don't see."""

    def word() -> str:
        return "".join(rng.choice("ba ce di fo gu la me ni ro tu sa en th er".split()) for _ in range(rng.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + ("." if rng.random() < 0.8 else "")

    def unknown() -> str:
        """Names that say nothing: grids, generated classes, words of any language."""
        return rng.choice(("row", "col", f"col-md-{rng.randint(1, 12)}", f"col-{rng.randint(1, 12)}", f"css-{rng.randint(100, 9999)}", "inner", "box", "block", "grid", f"g{rng.randint(1, 99)}", word(), f"{word()}-{word()}"))

    # a page names its blocks, or it doesn't
    named = rng.random() < 0.6

    def element(tag: str, label: int, inner: str, *names: str) -> str:
        name = rng.choice(names) if names else ""
        if name and not (named or rng.random() < 0.2):
            name = rng.choice(("", unknown()))
        attribute = f' {rng.choice(("class", "id"))}="{name}"' if name else ""
        return f'<{tag}{attribute} y="{label}">{inner}</{tag}>'

    def links(label: int, low: int = 2, high: int = 8) -> str:
        link = lambda: f"<a href='/'>{word()} {word() if rng.random() < 0.5 else ''}</a>"
        n = rng.randint(low, high)
        if rng.random() < 0.2:
            return "".join(element(rng.choice(("div", "p")), label, link()) for _ in range(n))
        return element(rng.choice(("ul", "ul", "ol")), label, "".join(element("li", label, link()) for _ in range(n)))

    def classed(tag: str, label: int, inner: str, *names: str) -> str:
        """The semantic tag, with or without a name, or a div or section with a name."""
        if tag != "div" and rng.random() < 0.55:
            return element(tag, label, inner, *((*names, "") if rng.random() < 0.5 else ("",)))
        return element(rng.choice(("div", "section", "div")), label, inner, *names)

    b, m = BOILER, MAIN
    para = lambda label, low=1, high=60: element("p", label, prose(low, high))

    def text_block(label: int) -> str:
        return prose(2, 40) if rng.random() < 0.4 else "".join(para(label, 3, 40) for _ in range(rng.randint(1, 4)))

    extras = {
        "nav": lambda: classed("nav", b, links(b), "nav", "menu", "navbar", "breadcrumb", "main-menu"),
        "header": lambda: classed("header", b, prose(1, 6) + (links(b) if rng.random() < 0.5 else ""), "header", "masthead", "topbar"),
        "footer": lambda: classed("footer", b, text_block(b) if rng.random() < 0.6 else links(b), "footer", "site-footer", "copyright"),
        "aside": lambda: classed("aside", b, (element(rng.choice(("h3", "h4")), b, prose(1, 3)) if rng.random() < 0.4 else "") + links(b) + (text_block(b) if rng.random() < 0.4 else ""), "sidebar", "widget", "related"),
    }
    keyed = {
        "ad": lambda: f'<div {rng.choice(("class", "id"))}="{rng.choice(("ad", "ads", "advert", "sponsored", "promo-banner", "ad-slot"))}" y="{b}">{text_block(b)}</div>',
        "notice": lambda: f'<{(t := rng.choice(("div", "section", "aside")))} class="{rng.choice(("cookie-notice", "notice", "consent", "alert"))}" y="{b}">{text_block(b)}</{t}>',
        "form": lambda: element("form", b, f"<label>{word()}</label><input>{prose(1, 9)}" + element("button", b, word()), "search", "newsletter", ""),
        "comments": lambda: f'<{(t := rng.choice(("div", "section", "ol")))} class="{rng.choice(("comments", "comment-list", "discussion"))}" y="{b}">' + "".join(element("div", b, text_block(b), "comment", "reply", "") for _ in range(rng.randint(1, 6))) + f"</{t}>",
    }
    extras |= keyed

    def table(label: int) -> str:
        rows = [element("tr", label, "".join(element(rng.choice(("td", "td", "th")), label, prose(1, 5)) for _ in range(rng.randint(1, 4)))) for _ in range(rng.randint(1, 5))]
        body = "".join(rows)
        return element("table", label, element("tbody", label, body) if rng.random() < 0.5 else body)

    def figure(label: int) -> str:
        return element("figure", label, "<img src='x'>" + element("figcaption", label, prose(2, 15)))

    def linked() -> str:
        """A paragraph of an article with links in it."""
        return element("p", m, f"{prose(2, 30)} <a href='/'>{prose(1, 4)}</a> {prose(2, 30)}")

    def body_of_article() -> str:
        inner = ""
        for _ in range(rng.choice((1, 1, 2, 2, 3, 5, 8, 14, 25))):
            kind = rng.random()
            if kind < 0.62:
                inner += para(m, 1, 120)
            elif kind < 0.68:
                inner += linked()
            elif kind < 0.73:
                inner += element(rng.choice(("h2", "h3")), m, prose(1, 6))
            elif kind < 0.78:
                inner += element(rng.choice(("blockquote", "pre")), m, prose(3, 40))
            elif kind < 0.83:
                inner += element(rng.choice(("ul", "ol")), m, "".join(element("li", m, prose(1, 15)) for _ in range(rng.randint(2, 6))))
            elif kind < 0.86:
                inner += element("div", m, text_block(m), "", "figure", "caption")
            elif kind < 0.89:
                inner += rng.choice((table, figure))(m)
            elif kind < 0.91:
                inner += element("dl", m, "".join(element("dt", m, prose(1, 3)) + element("dd", m, prose(2, 15)) for _ in range(rng.randint(1, 4))))
            else:
                inner += extras[rng.choice(("ad", "ad", "aside", "notice", "form", "nav"))]()
        return inner + (prose(5, 60) if rng.random() < 0.1 else "")

    def article() -> str:
        inner = element(rng.choice(("h1", "h1", "h2")), m, prose(1, 12)) if rng.random() < 0.85 else ""
        # paragraphs, or plain text and line ends only
        inner += body_of_article() if rng.random() < 0.93 else "<br>".join(prose(10, 60) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.15:
            inner += extras["comments"]()
        if rng.random() < 0.12:
            inner = element("header", m, element("h1", m, prose(2, 9))) + inner
        return classed(rng.choice(("article", "article", "main", "div")), m, inner, "content", "post", "entry-content", "article-body", "story", "main")

    def columns() -> str:
        """A grid whose columns hold the article and links, in either order, perhaps under a heading of their own."""
        column = lambda inner, label: element("div", label, inner, unknown())
        inner = body_of_article()
        heading = element(rng.choice(("h1", "h2")), m, prose(1, 12))
        above = rng.random() < 0.3
        own = column(inner if above else heading + inner, m) if rng.random() < 0.6 else column(article(), CONTAINER)
        side = column(links(b, 3, 10) if rng.random() < 0.6 else extras["aside"](), b)
        both = own + side if rng.random() < 0.7 else side + own
        row = element("div", CONTAINER, (extras["comments"]() if rng.random() < 0.05 else "") + both, unknown(), "row")
        return (heading if above else "") + row

    def bare() -> str:
        """Headings and paragraphs, or nothing but text, without an element around the article."""
        if rng.random() < 0.25:
            return f"{MARK}{m}{prose(5, 60)}<br>{prose(3, 40)}"
        return element("h1", m, prose(1, 9)) + body_of_article()

    kind = rng.random()
    if kind < 0.04:  # nothing but text
        return f"{MARK}{m}{prose(8, 60)}" + f"<br>{prose(3, 40)}" * rng.randint(0, 2)
    main = article() if kind < 0.55 else columns() if kind < 0.85 else bare()
    before = [rng.choice(("nav", "header", "ad", "notice", "form", "aside", "nav")) for _ in range(rng.randint(0, 4))]
    after = [rng.choice(("footer", "comments", "aside", "ad", "form", "notice", "footer")) for _ in range(rng.randint(0, 4))]
    loose = lambda: f"{MARK}{b}{prose(1, 4)}" if rng.random() < 0.06 else ""
    page = loose() + "".join(extras[k]() for k in before) + main + "".join(extras[k]() for k in after) + loose()
    for _ in range(rng.choice((0, 0, 0, 1, 2, 3))):
        page = element("div", CONTAINER, page, "container", "wrapper", "page", "site", "", "layout row", unknown())
    if rng.random() < 0.06:  # a fragment
        return page
    head = f'<head y="{b}"><title>{prose(1, 8)}</title><style>p{{}}</style></head>'
    return f'<!DOCTYPE html><html y="{CONTAINER}">{head}<body y="{CONTAINER}">{page}</body></html>'


_LABEL = re.compile(r'\by="(\d)"')


def labelled(source: str) -> tuple[Page, list[int]]:
    """A training page and its nodes' labels; marks of loose text are taken out."""
    page = Page(source)
    y = [CONTAINER] + [int(m[1]) if (m := _LABEL.search(a)) else -1 for a in page.names[1:]]
    for i, piece in enumerate(page.pieces):
        if piece and (k := piece[1].find(MARK)) >= 0:
            y[piece[0]] = int(piece[1][k + 1])
            page.pieces[i] = (piece[0], piece[1][:k] + piece[1][k + 2 :])
    for i, label in enumerate(y):
        if label < 0:
            y[i] = y[page.parent[i]]
    return page, y


@cache
def train() -> dict:
    """The model; it depends on this module's constants only, so a session fits it once."""
    rng, xs, ys = random.Random(SEED), [], []
    for _ in range(TRAINING_PAGES):
        page, y = labelled(layout(rng))
        xs.append(node_features(page)[1:])
        ys += y[1:]
    return boost(np.concatenate(xs), np.array(ys))


def main_texts(model: dict, sources: list[str | None]) -> list[str]:
    pages = [Page(s) for s in sources]
    logp = log_odds(model, np.concatenate([node_features(p) for p in pages]))
    at, out = 0, []
    for p in pages:
        n = len(p.tag)
        out.append(p.text(decode(p.parent, logp[at : at + n])))
        at += n
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, one row per row of ``pages``."""
    model = train()

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = main_texts(model, part.column(2).to_pylist())
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(apply, f"page_id {kind}, url string, text string, n_chars long")
