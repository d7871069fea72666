"""HTML main text by minimum-cut labelling.

A page becomes a row of text blocks. A logistic classifier, fitted here to generated pages, prices each label of a
block; the prices are the capacities from and to the terminals. Neighbouring blocks, and successive blocks of one
parent, are joined by smoothness edges that weaken with their distance in the document tree. The minimum cut, by
maximum flow, separates content from boilerplate.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections import defaultdict, deque
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

ADJACENT = 0.6
SIBLING = 0.4
#: Innermost elements that tell where a block lies in the tree; deeper trees are compared by these alone.
DEPTH = 24
#: Pages generated for the classifier, and rounds of its fit.
TRAIN_PAGES = 400
ROUNDS = 300

#: Elements whose content is no text of the page; to the end of the page, as in browsers, only those of RAW where no closing tag follows.
SKIPPED = frozenset("script style noscript template svg iframe object title textarea annotation annotation-xml canvas audio video".split())
RAW = frozenset(["script", "style"])
#: A tag as browsers end it: a quote hides > only after =. Possessive, so that a tag is read once.
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|))*+)>")
_unquoted_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_closing = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in SKIPPED}
_named = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mpadded mphantom menclose mstyle merror mtable mtr mtd semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What the words of an element's class, id or role say of the text in it.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense adslot banner outbrain taboola",
    "comment": "comment comments commentlist commenter disqus respond replies reply discussion responses",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription paywall toast overlay announcement signup disclaimer privacy",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side widget widgets related share sharing social tags pagination pager toc recommended trending popular skip search login toolbar tools complementary",
    "foot": "footer foot copyright colophon contentinfo legal",
    "head": "header masthead topbar logo branding",
    "content": "article content post entry main story body text",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
#: Words at the head or end of a name that make it say what a page has, allows or is filed under, not what the element is.
STATES = frozenset("has with without no not is js hide show category enabled disabled open opened closed free on off active inactive by page layout template loaded ready".split())
#: Elements that hold the page or its article; names on them say what else the page has.
OUTER = frozenset(["html", "body", "main", "article"])
ZONES = ["nav", "header", "footer", "aside", "form", "ad", "comment", "notice", "menu", "foot", "head", "hidden"]
_ZONE_OF_TAG = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "select": "form", "option": "form", "label": "form", "fieldset": "form", "dialog": "notice"}
_BIT = {z: 1 << k for k, z in enumerate(ZONES)}
_IN_ARTICLE, _IN_CONTENT = 1 << len(ZONES), 1 << (len(ZONES) + 1)
_STICKY = _BIT["footer"] | _BIT["foot"] | _BIT["comment"] | _BIT["ad"] | _BIT["notice"] | _BIT["aside"] | _BIT["nav"] | _BIT["menu"] | _BIT["form"]
TAGS = ["p", "heading", "li", "cell", "other"]
#: A page of which no block of SEEN characters is kept is read again if it has so many paragraphs of so many characters.
SEEN, LONG, PARAGRAPHS = 40, 80, 2
N_FEATURES = len(ZONES) + 2 + len(TAGS) + 5


def _kind(tag: str) -> int:
    if tag in ("p", "blockquote", "pre", "figcaption", "dd", "dt"):
        return 0
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        return 1
    return 2 if tag == "li" else 3 if tag in ("td", "th", "caption") else 4


def _hints(tag: str, attrs: str) -> set[str]:
    """What the names in class, id, role and label say of the element.

    A name of several words counts by its first and last one, unless one of its words tells a state (`has-sidebar`,
    `comments-open`, `side-by-side`). On the elements of OUTER only a name that is one word counts, on an article and
    to say that it is a comment, an advert or content.
    """
    out = set()
    for m in _named.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _parts.findall(name)]
            if tag in OUTER and (tag != "article" or len(words) != 1):
                words = [w for w in words if _HINT.get(w) == "content"]
            elif tag == "article":
                words = [w for w in words if _HINT.get(w) in ("content", "comment", "ad")]
            elif not STATES.isdisjoint(words) or (words[:1] == ["tag"] and len(words) > 1):
                continue
            out |= {_HINT[w] for w in (*words[:1], *words[-1:]) if w in _HINT}
    return out


def _flags(tag: str, attrs: str, above: int) -> int:
    own = _BIT[_ZONE_OF_TAG[tag]] if tag in _ZONE_OF_TAG else 0
    inside = above & (_IN_ARTICLE | _IN_CONTENT)
    if own == _BIT["header"] and inside:
        own = 0  # the heading of the article itself
    if tag in ("article", "main"):
        own |= _IN_ARTICLE
        above &= ~(_STICKY if tag == "main" else _BIT["form"] | _BIT["notice"])  # a form or notice around an article is a frame
    if attrs and not attrs.isspace():
        for hint in _hints(tag, attrs):
            if hint == "content":
                own |= _IN_CONTENT
            elif not (hint == "head" and inside):
                own |= _BIT[hint]
        if tag not in ("html", "body") and _hidden.search(attrs):
            own |= _BIT["hidden"]
    if own & _STICKY:
        own &= ~(_IN_ARTICLE | _IN_CONTENT)
        above &= ~(_IN_ARTICLE | _IN_CONTENT)
    elif above & _STICKY:
        own &= ~(_IN_ARTICLE | _IN_CONTENT)
    return above | own


def _markup_end(page: str, at: int) -> int:
    """Where the comment, declaration or other markup that is no tag ends; `at` itself if it is text."""
    if page.startswith("<!--", at):
        end = page.find("-->", at + 2)
        return len(page) if end < 0 else end + 3
    if page.startswith("<![CDATA[", at):
        end = page.find("]]>", at)
        return len(page) if end < 0 else end + 3
    return page.index(">", at) + 1 if page[at + 1 : at + 2] in ("!", "?", "/") else at


def _skipped_end(page: str, tag: str, at: int, closed: bool, unclosed: set[str]) -> int:
    """Where the skipped element's content ends. Without a closing tag it has none, so that the page goes on; it is looked for once a page."""
    if closed and tag not in RAW:
        return at
    if tag not in unclosed:
        end = _closing[tag].search(page, at)
        if end:
            stop = page.find(">", end.end())
            return len(page) if stop < 0 else stop + 1
        unclosed.add(tag)
    return len(page) if tag in RAW and not closed else at


_SCOPES = ("ul", "ol", "table", "select", "dl")
_ITEMS = frozenset(["li", "tr", "td", "th", "option", "dd", "dt"])


class _Tree:
    """The open elements: (tag, flags, number, kind, place of the innermost block), with the places of each tag, so that no closing tag walks the stack."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, int, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.n = self.links = 0

    def cut(self, at: int) -> None:
        """Close the elements from `at` on."""
        for x in self.stack[at:]:
            self.places[x[0]].pop()
            if x[0] == "a":
                self.links = 0
        del self.stack[at:]

    def open(self, tag: str, attrs: str, inline: bool) -> None:
        self.n += 1
        _, flags, _, kind, block = self.stack[-1] if self.stack else ("", 0, 0, 4, -1)
        self.places[tag].append(len(self.stack))
        if not inline:
            kind, block = _kind(tag), len(self.stack)
        self.stack.append((tag, _flags(tag, attrs, flags), self.n, kind, block))

    def close(self, tag: str, inline: bool) -> None:
        """Close the innermost such element; an inline one below an open block was closed too late, and the block stays open."""
        at = self.places[tag]
        if at and not (inline and at[-1] < self.stack[-1][4]):
            self.cut(at[-1])

    def make_room(self, tag: str) -> None:
        """A block ends an open paragraph, an item its forerunner in the same list or table."""
        if self.places["p"]:
            self.cut(self.places["p"][-1])
        if tag in _ITEMS and self.places[tag]:
            at = self.places[tag][-1]
            if at > max(self.places[x][-1] if self.places[x] else -1 for x in _SCOPES):
                self.cut(at)


def blocks(page: str | None) -> list[tuple[str, int, int, int, tuple[int, ...]]]:
    """(text, flags, kind, characters of links, path of element numbers) of each block with text, in page order; in time linear in the page."""
    out: list = []
    if not page:
        return out
    tree = _Tree()
    text: list[str] = []
    linked = pos = 0
    flags, kind = 0, 4

    def close_block() -> None:
        nonlocal linked
        if text:
            t = " ".join(htmllib.unescape("".join(text)).split())
            if t:
                path = tuple(x[2] for x in tree.stack[-DEPTH:] if x[0] not in INLINE)
                out.append((t, flags, kind, min(linked, len(t)), path))
            text.clear()
        linked = 0

    unclosed: set[str] = set()  # skipped elements without a closing tag from here on
    last = page.rfind(">")
    pattern = _tag
    while pos < len(page):
        at = page.find("<", pos)
        if at < 0 or at > last:  # no tag can end any more
            at = page.find("<!--", pos)
            at = len(page) if at < 0 else at
        words = page[pos:at]
        m = None
        pos = at
        if at < len(page):
            m = pattern.match(page, at)
            if m is None and page[at + 1 : at + 3].lstrip("/")[:1].isalpha() and page[at + 1 : at + 3].isascii():
                pattern = _unquoted_tag  # a quote without its fellow: from here on quotes hide nothing
                m = pattern.match(page, at)
            if m is None:
                pos = _markup_end(page, at)
                if pos == at:
                    words += "<"
                    pos += 1
            else:
                pos = m.end()
        if words:
            text.append(words)
            if tree.links:
                linked += len(words)
        if m is None:
            continue
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if tag in SKIPPED and not closing:
            pos = _skipped_end(page, tag, pos, attrs.endswith("/"), unclosed)
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                close_block()
            continue
        inline = tag in INLINE
        if not inline:
            close_block()
        if closing:
            if tag == "a":
                tree.links = max(0, tree.links - 1)
            tree.close(tag, inline)
        else:
            if not inline:
                tree.make_room(tag)
            if tag == "a":
                tree.links += 1
            if not attrs.endswith("/"):
                tree.open(tag, attrs, inline)
        if tree.stack:
            flags = tree.stack[-1][1]
            if not inline or closing:
                kind = tree.stack[-1][3]
        else:
            flags = 0
            if not inline or closing:
                kind = 4
    close_block()
    return out


def features(found: list[tuple]) -> np.ndarray:
    rows = np.zeros((len(found), N_FEATURES))
    z = len(ZONES) + 2
    for r, (t, flags, kind, linked, _) in zip(rows, found, strict=True):
        for k in range(z):
            if flags >> k & 1:
                r[k] = 1
        r[z + kind] = 1
        n = t.count(" ") + 1
        r[z + len(TAGS) :] = (linked / len(t), min(np.log1p(n), 4) / 4, t[-1] in ".!?:;\"'", n < 4, 1)
    return rows


def _generated(draw: random.Random) -> list[tuple[str, bool]]:
    """(html, is content) of the parts of one page; parts without a label of their own carry text that is ignored."""
    word = lambda: "".join(draw.choice(["ka", "ro", "mi", "ten", "sul", "vor", "ane", "qui", "bel"]) for _ in range(draw.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))
    item = lambda: f"<li><a href='/{word()}'>{say(1, 4)}</a></li>"
    pick = draw.choice
    wrap = lambda how, inner: f"<{how}>{inner}</{how.split()[0]}>"
    links = lambda: "<ul>" + "".join(item() for _ in range(draw.randint(2, 7))) + "</ul>"
    said = lambda: pick(["{0}.", "<p>{0}.</p>", "<p>{0}.</p>", "<div>{0}.</div>", "<span>{0}</span>", "<h3>{1}</h3><p>{0}.</p>", "<ul><li>{0}.</li><li>{1}</li></ul>"]).format(say(*pick([(2, 8), (6, 40)])), say(1, 3))
    zones = [
        (["nav", "div class='menu'", "nav class='navbar'", "div class='breadcrumbs'", "ul class='nav-menu'"], lambda: pick([links(), f"<a href='/'>{say(1, 2)}</a> <a href='/x'>{say(1, 2)}</a>", said()])),
        (["header", "div id='header'", "header class='masthead'", "div class='topbar'"], lambda: pick([f"<a href='/'>{say(1, 3)}</a>", f"<h2>{say(1, 4)}</h2>{said()}", said()])),
        (["div class='ad'", "div class='advert'", "section class='sponsored'", "div id='promo'", "div class='banner'"], said),
        (["aside", "div class='sidebar'", "aside class='related'", "div class='widget'", "section class='recommended'"], lambda: pick([links(), said(), said()])),
        (["div class='cookie-notice'", "div class='alert'", "div class='newsletter'", "section id='consent'", "div hidden", "div style='display:none'"], said),
        (["form", "form class='search'"], lambda: pick([f"<label>{say(1, 3)}</label><input type='text'><button>{say(1, 2)}</button>", said()])),
        (["section class='comments'", "div id='comments'", "ol class='commentlist'"], lambda: "".join(f"<div class='comment'>{said()}</div>" for _ in range(draw.randint(1, 4)))),
        (["footer", "div class='footer'", "div id='footer'", "footer class='copyright'"], lambda: pick([said(), links(), f"{say(2, 4)} {say(3, 12)}."])),
    ]

    def bad(k: int | None = None) -> str:
        hows, inner = zones[k] if k is not None else pick(zones)
        return wrap(pick(hows), inner())

    def para() -> str:
        how = pick(["p"] * 8 + ["blockquote", "h2", "h3", "list", "div", "div"])
        if how == "list":
            return "<ul>" + "".join(f"<li>{say(1, 20)}.</li>" for _ in range(draw.randint(2, 4))) + "</ul>"
        body = say(1, 5) if how[0] == "h" else say(*pick([(1, 3), (8, 40), (30, 120)])) + "."
        if draw.random() < 0.15:
            body += f" <a href='#'>{say(1, 3)}</a>"
        return wrap(how, body)

    holder = pick(["article", "article", "main", "div class='content'", "div id='main-content'", "div class='post-body'", "section class='entry'", "div", "div", "div class='wrap'", "section"])
    title = f"<h1>{say(3, 9)}</h1>"
    head = wrap("header", title) if draw.random() < 0.3 else title
    parts = [(bad(), False) for _ in range(draw.randint(1, 4))]
    inner: list[tuple[str, bool]] = [(head, True)]
    for _ in range(draw.randint(2, 12)):
        inner.append((para(), True))
        if draw.random() < 0.08:
            inner.append((bad(pick([2, 3, 4, 5])), False))
    parts += [(f"<{holder}>", True), *inner, (f"</{holder.split()[0]}>", True)]
    return parts + [(bad(), False) for _ in range(draw.randint(1, 4))]


def training_pages(n: int = TRAIN_PAGES, seed: int = 3) -> list[tuple[str, list[bool]]]:
    """Generated pages and the label of each of their blocks."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        parts = _generated(draw)
        page, labels, count = "<!DOCTYPE html><html><body>", [], 0
        for h, good in parts:
            page += h
            now = len(blocks(page))
            labels += [good] * (now - count)
            count = now
        out.append((page + "</body></html>", labels))
    return out


@cache
def classifier(n: int = TRAIN_PAGES, rounds: int = ROUNDS) -> tuple[float, ...]:
    """Logistic weights, fitted by gradient steps with a small ridge."""
    pages = training_pages(n)
    x = np.concatenate([features(blocks(p)) for p, _ in pages])
    y = np.concatenate([np.array(v, float) for _, v in pages])
    w = np.zeros(N_FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(N_FEATURES)
        step = np.linalg.solve(hess, x.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def minimum_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (true: content) of least cost: content[i] or boilerplate[i] for each node, plus w for each edge cut.

    Dinic's maximum flow from a source on the content side. Nodes reached in the residual graph are content; where
    both sides cost alike, nodes not reached are boilerplate.
    """
    n = len(content)
    excess = [b - c for b, c in zip(boilerplate, content, strict=True)]  # what both terminals share flows at once
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[float] = []
    for a, b, w in edges:
        head[a].append(len(to))
        to.append(b)
        cap.append(w)
        head[b].append(len(to))
        to.append(a)
        cap.append(w)
    source = [max(0.0, e) for e in excess]
    sink = [max(0.0, -e) for e in excess]
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if source[i] > tiny)
        for i in queue:
            level[i] = 0
        ends = False
        while queue:
            i = queue.popleft()
            ends = ends or sink[i] > tiny
            for e in head[i]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not ends:
            return [v >= 0 for v in level]
        at = [0] * n
        for s in range(n):
            while source[s] > tiny and level[s] == 0:
                path: list[int] = []
                i = s
                while True:
                    if sink[i] > tiny:
                        flow = min([source[s], sink[i], *[cap[e] for e in path]])
                        source[s] -= flow
                        sink[i] -= flow
                        for e in path:
                            cap[e] -= flow
                            cap[e ^ 1] += flow
                        break
                    while at[i] < len(head[i]):
                        e = head[i][at[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        at[i] += 1
                    else:
                        level[i] = -2  # nothing leaves here in this phase
                        if not path:
                            break
                        e = path.pop()
                        i = to[e ^ 1]
                        at[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if level[s] == -2:
                    break


def smoothness(found: list[tuple]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between successive blocks of one parent, weaker with tree distance."""
    out = []
    last: dict[tuple[int, ...], int] = {}
    for i, (_, _, _, _, path) in enumerate(found):
        parent = path[:-1]
        if i:
            before = found[i - 1][4]
            same = 0
            for a, b in zip(before, path, strict=False):
                if a != b:
                    break
                same += 1
            out.append((i - 1, i, ADJACENT / (1 + max(0, len(before) + len(path) - 2 * same - 2))))
        if parent in last and last[parent] < i - 1:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def _labels(found: list[tuple], weights: np.ndarray) -> list[bool]:
    score = features(found) @ weights
    return minimum_cut(np.logaddexp(0, -score).tolist(), np.logaddexp(0, score).tolist(), smoothness(found))


def main_text(page: str | None, weights: tuple[float, ...]) -> str:
    """Content blocks joined by an empty line; null, empty and textless pages give an empty text.

    Where all is cut away though the page has PARAGRAPHS paragraphs, the zones that these have in common say nothing,
    as they are those of a frame around the page; the cut is made once more without them.
    """
    found = blocks(page)
    if not found:
        return ""
    w = np.array(weights)
    keep = _labels(found, w)
    if not any(k and len(f[0]) >= SEEN for f, k in zip(found, keep, strict=True)):
        long = [f[1] for f in found if len(f[0]) >= LONG and 3 * f[3] < len(f[0]) and not f[1] & _BIT["hidden"]]
        common = (1 << len(ZONES)) - 1
        for flags in long:
            common &= flags
        if len(long) >= PARAGRAPHS and common:
            found = [(f[0], f[1] & ~common, *f[2:]) for f in found]
            keep = _labels(found, w)
    return "\n\n".join(f[0] for f, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars), a row a page, repeated rows too; other columns are ignored."""
    weights = classifier()

    def run(ids: list, urls: list, htmls: list) -> list:
        texts = [main_text(h, weights) for h in htmls]
        return [ids, urls, texts, [len(t) for t in texts]]

    return map_rows(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
