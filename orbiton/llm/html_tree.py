"""Main text of HTML pages by a tree-structured graphical model over the DOM (operator 7).

A page is parsed into a tree of block elements whose leaves are runs of text. Each node is content or
not. Unary potentials weigh a node's features; a potential for each kind of child couples it with its
parent. Sum-product messages go up and then down the tree, level by level for a whole batch of pages at
once, and give each node's exact marginal. The weights maximise the likelihood of labelled pages, whose
gradient is observed less expected counts. Leaves with a marginal of a half or more are the text.
"""

from __future__ import annotations

import html as _html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# Elements that break a line of text, those whose contents are raw to the end of the page if
# need be, those that hold no text of the page if they end, those that never have an end, and those that a
# like element closes.
BLOCKS = frozenset("html head body title main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend label select option button textarea blockquote pre figure figcaption address details summary hr menu dialog center noscript iframe svg".split())
RAW = frozenset("script style textarea".split())
HELD = RAW | frozenset("template noscript iframe svg select object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_LIKE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words of class, id and role attributes, by what they tell.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs topnav",
    "advert": "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion doubleclick",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay privacy disclaimer",
    "comment": "comment comments commentlist reply replies disqus respond discussion feedback",
    "side": "sidebar aside widget widgets related recommended trending popular rail secondary",
    "foot": "footer foot copyright legal colophon",
    "head": "header masthead topbar branding logo hero site",
    "share": "share sharing social follow likes tools toolbar meta byline tags",
    "form": "newsletter subscribe subscription signup login form search contact",
    "text": "content article post entry story main body text page prose maintext",
}
_HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:\b(?:class|id|role|itemprop|aria-label)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")


class Page:
    """A parsed page: of each node its parent (-1: none), tag ("#text": a leaf), attributes and, of a leaf, text and the share that links hold."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attributes, self.text, self.linked = [-1], ["html"], [""], [""], [0.0]
        stack = [0]
        run: list[str] = []
        link = linked = 0

        def close_run():
            nonlocal linked
            if run:
                text = _SPACE.sub(" ", _html.unescape("".join(run))).strip()
                if text:
                    self._add(stack[-1], "#text", "", text, min(1.0, linked / max(1, len(text))))
                run.clear()
            linked = 0

        at = 0
        while True:
            m = _TOKEN.search(source, at)
            piece = source[at : m.start() if m else len(source)]
            if piece:
                run.append(piece)
                if link:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            ending = bool(m[1] or m[4])
            attributes = m[3] or m[6] or ""
            if name == "a":
                link = 0 if ending else 1
            if name == "br":
                run.append(" ")
            if not ending and name in HELD and not attributes.endswith("/"):
                end = re.compile(f"</{name}\\s*>", re.I).search(source, at)
                if end or name in RAW:
                    at = end.end() if end else len(source)
                    continue
            if name not in BLOCKS:
                continue
            close_run()
            if ending:
                if name in (self.tag[i] for i in stack[1:]):
                    while self.tag[stack.pop()] != name:
                        pass
                continue
            if self.tag[stack[-1]] == "p":
                stack.pop()
            stops = CLOSED_BY_LIKE.get(name)
            if stops:
                like = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
                for k in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[k]]
                    if tag in like:
                        del stack[k:]
                        break
                    if tag in stops:
                        break
            if name == "html":
                self.attributes[0] += attributes
            elif name not in VOID:
                stack.append(self._add(stack[-1], name, attributes, "", 0.0))
        close_run()

    def _add(self, parent: int, tag: str, attributes: str, text: str, linked: float) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


_TAGS = {t: i for i, t in enumerate(sorted(BLOCKS))}
_NAMES = [f"tag {t}" for t in _TAGS] + [f"hint {h}" for h in HINTS] + ["any", "leaf", "leaf in links", "leaf mostly links", "leaf under 25", "leaf under 80", "leaf under 200", "leaf longer", "leaf ends a sentence", "leaf with copyright"]
_INDEX = {n: i for i, n in enumerate(_NAMES)}
_SECTIONS = frozenset("nav aside header footer form section article main dialog fieldset".split())


def _features(page: Page, i: int) -> list[int]:
    tag = page.tag[i]
    out = [_INDEX["any"]]
    if tag == "#text":
        text, n = page.text[i], len(page.text[i])
        out.append(_INDEX["leaf"])
        if page.linked[i] > 0.1:
            out.append(_INDEX["leaf mostly links" if page.linked[i] > 0.5 else "leaf in links"])
        out.append(_INDEX["leaf under 25" if n < 25 else "leaf under 80" if n < 80 else "leaf under 200" if n < 200 else "leaf longer"])
        if text[-1] in ".!?…\"»”:":
            out.append(_INDEX["leaf ends a sentence"])
        if "©" in text:
            out.append(_INDEX["leaf with copyright"])
        return out
    out.append(_TAGS[tag])
    if page.attributes[i]:
        found = {_HINT_OF[w] for a in _ATTRIBUTE.findall(page.attributes[i]) for w in map(str.lower, _PART.findall("".join(a))) if w in _HINT_OF}
        out += [_INDEX[f"hint {h}"] for h in found]
    return out


class Forest:
    """The nodes of several pages as arrays, with their features, kinds of edge and levels."""

    def __init__(self, pages: list[Page]):
        base, parents, which, active, kinds, depth = 0, [], [], [], [], []
        for page in pages:
            level = [0] * len(page.tag)
            for i, p in enumerate(page.parent):
                parents.append(p + base if p >= 0 else -1)
                if p >= 0:
                    level[i] = level[p] + 1
                f = _features(page, i)
                active += f
                which += [base + i] * len(f)
                tag = page.tag[i]
                kinds.append(0 if tag == "#text" else 2 if tag in _SECTIONS or len(f) > 2 else 1)
            depth += level
            base += len(page.tag)
        self.parent, self.kind = np.array(parents), np.array(kinds)
        self.which, self.active = np.array(which), np.array(active)
        depth = np.array(depth)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))

    def infer(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content, and of each (parent, child) edge its table (zeros at roots).

        weights: of the features; pairs[kind, parent label, child label]: log potentials.
        """
        n = len(self.parent)
        belief = np.zeros((n, 2))
        belief[:, 1] = np.bincount(self.which, weights[self.active], n)
        up = np.zeros((n, 2))
        for nodes in reversed(self.levels[1:]):
            t = pairs[self.kind[nodes]] + belief[nodes][:, None, :]
            up[nodes] = np.logaddexp(t[:, :, 0], t[:, :, 1])
            np.add.at(belief, self.parent[nodes], up[nodes])
        total = belief.copy()  # of a root this is all there is
        edges = np.zeros((n, 2, 2))
        for nodes in self.levels[1:]:
            above = total[self.parent[nodes]] - up[nodes]
            t = pairs[self.kind[nodes]] + above[:, :, None]
            down = np.logaddexp(t[:, 0], t[:, 1])
            total[nodes] = belief[nodes] + down
            t = t + belief[nodes][:, None, :]
            t = np.exp(t - t.max(axis=(1, 2), keepdims=True))
            edges[nodes] = t / t.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), edges


def train(pages: list[Page], labels: list[list[int]], rounds: int = 500, shrink: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials of greatest penalised likelihood, by Adam steps."""
    forest = Forest(pages)
    y = np.concatenate([np.array(x) for x in labels])
    n = len(y)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    at = np.zeros(len(_NAMES) + 12)
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, rounds + 1):
        weights, pairs = at[: len(_NAMES)], at[len(_NAMES) :].reshape(3, 2, 2)
        p, edges = forest.infer(weights, pairs)
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, forest.kind[child], edges[child])
        up = np.concatenate((np.bincount(forest.active, (y - p)[forest.which], len(_NAMES)), (seen - expected).ravel())) / n - shrink * at
        first, second = 0.9 * first + 0.1 * up, 0.99 * second + 0.01 * up * up
        at = at + 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return at[: len(_NAMES)], at[len(_NAMES) :].reshape(3, 2, 2)


def labelled_pages(count: int = 300, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Made pages of many layouts: the source and the texts that are content, each marked by a word of its own."""
    r = random.Random(seed)
    serial = [0]

    def words(low, high, end=None):
        n = r.randint(low, high)
        out = " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize()
        return out + (r.choice("..!?") if end is None else end)

    def mark(text, good):
        serial[0] += 1
        kept.append(f"k{serial[0]}k") if good else None
        return f"{text} k{serial[0]}k" if text[-1].isalnum() else f"{text[:-1]} k{serial[0]}k{text[-1]}"

    def bad(low=1, high=12, end=None):
        return mark(words(low, high, end), False)

    def good(low=1, high=60, end=None):
        return mark(words(low, high * 4 if high == 60 and r.random() < 0.2 else high, end), True)

    def attr(kind):
        return r.choice(("class", "id", "class")) + f'="{r.choice(HINTS[kind].split())}{r.choice(("", "", "-" + r.choice(("box", "wrap", "inner", "area", "1"))))}"'

    def links(n):
        return "".join(f'<li><a href="/x">{bad(1, 3, "")}</a></li>' for _ in range(n))

    def clutter():
        return r.choice((
            lambda: f"<div {attr('advert')}>{bad()}</div>",
            lambda: f"<div {attr('advert')}><p>{bad()}</p><p>{bad(1, 30)}</p></div>",
            lambda: f"<div {attr('notice')}><p>{bad(5, 30)}</p><button>{bad(1, 2, '')}</button></div>",
            lambda: f"<aside><h3>{bad(1, 4, '')}</h3><p>{bad(4, 40)}</p><ul>{links(3)}</ul></aside>",
            lambda: f"<div {attr('side')}><h4>{bad(1, 3, '')}</h4><ul>{links(r.randint(2, 6))}</ul></div>",
            lambda: f"<form><label>{bad(1, 3, '')}</label><input name=q><button>{bad(1, 2, '')}</button><p>{bad(3, 20)}</p></form>",
            lambda: f"<div {attr('form')}><p>{bad(3, 20)}</p><form><input></form></div>",
            lambda: f"<div {attr('share')}><a href=#>{bad(1, 2, '')}</a> <a href=#>{bad(1, 2, '')}</a></div>",
            lambda: f"<nav><ul>{links(r.randint(2, 7))}</ul></nav>",
            lambda: f"<ul {attr('menu')}>{links(r.randint(2, 7))}</ul>",
            lambda: f"<header><p>{bad(1, 8, '')}</p></header>",
            lambda: f"<footer><p>{bad(3, 15)}</p></footer>",
        ))()

    def comments():
        items = "".join(r.choice((f"<li><p>{bad(3, 60)}</p></li>", f"<div class=\"comment\"><b>{bad(1, 2, '')}</b><p>{bad(3, 60)}</p></div>", f"<article class=\"comment\"><p>{bad(3, 50)}</p></article>")) for _ in range(r.randint(1, 5)))
        return r.choice(("<section {}>{}</section>", "<div {}>{}</div>", "<ol {}>{}</ol>")).format(attr("comment"), f"<h3>{bad(1, 3, '')}</h3>{items}")

    def part():
        return r.choice((
            lambda: f"<p>{good()}</p>", lambda: f"<p>{good()}</p>", lambda: f"<p>{good(1, 60, '')}</p>", lambda: f"<p>{good(1, 6)}</p>", lambda: f"<p>{good()}", lambda: f"<p><b>{good(3, 40)}<br>",
            lambda: f"<h2>{good(1, 7, '')}</h2>", lambda: f"<blockquote><p>{good(4, 40)}</p></blockquote>", lambda: f"<ul><li>{good(1, 15)}</li><li>{good(1, 15, '')}</li></ul>",
            lambda: f"<table><tr><th>{good(1, 3, '')}</th><td>{good(1, 5, '')}</td></tr></table>", lambda: f"<pre>{good(3, 20, '')}</pre>",
            lambda: f"<figure><figcaption>{good(3, 15)}</figcaption></figure>", lambda: f"<div>{good(5, 60)}</div>", lambda: f"<p>{good(5, 30)} <a href=/y>{words(1, 4, '')}</a> {words(2, 9)}</p>",
            lambda: f"<section><h3>{good(1, 6, '')}</h3><p>{good()}</p></section>",
        ))()

    out = []
    for _ in range(count):
        kept: list[str] = []
        body = "".join(clutter() if r.random() < 0.08 else part() for _ in range(r.choice((1, 1, 2, 3, 6, 10, 15))))
        title = f"<h1>{good(2, 9, '')}</h1>" if r.random() < 0.8 else ""
        discuss = comments() if r.random() < 0.35 else ""
        inside = discuss if r.random() < 0.4 else ""
        main = r.choice(("<article data-y>{}</article>",) * 4 + ("<main data-y>{}</main>", "<main data-y><article data-y>{}</article></main>", "<div data-y " + attr("text") + ">{}</div>", "<div data-y " + attr("text") + "><div data-y>{}</div></div>", "<section data-y " + attr("text") + ">{}</section>")).format(title + body + inside)
        before = "".join(clutter() for _ in range(r.randint(0, 3)))
        after = ("" if inside else discuss) + "".join(clutter() for _ in range(r.randint(0, 2)))
        foot = r.choice((f"<footer>&copy; {bad(2, 12)}</footer>", f"<div {attr('foot')}>&copy; {bad(2, 8)} &middot; {words(1, 9)}</div>", ""))
        top = r.choice((f"<nav><ul>{links(r.randint(2, 7))}</ul></nav>", f"<header><div {attr('head')}>{bad(1, 3, '')}</div><nav>{links(4)}</nav></header>", f"<div {attr('menu')}><ul>{links(4)}</ul></div>"))
        wrap = r.choice(("{}", "{}", "<div id=wrapper>{}</div>", "<div class=container><div class=row>{}</div></div>"))
        out.append((f"<!DOCTYPE html><html><head><title>{bad(1, 9, '')}</title><script>var a='<p>';</script></head><body>" + wrap.format(top + before + main + after + foot) + "</body></html>", kept))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The model of labelled_pages(). The element around a page's content (marked data-y there) is content, as is one that little but content is in."""
    pages, labels = [], []
    for source, kept in labelled_pages(count):
        page = Page(source)
        marks = set(kept)
        y = [int(t == "#text" and any(w.strip(".!?") in marks for w in x.split())) for t, x in zip(page.tag, page.text)]
        size, held = [0] * len(y), [0] * len(y)
        for i in range(len(y) - 1, -1, -1):
            if page.tag[i] == "#text":
                size[i] = len(page.text[i])
                held[i] = size[i] * y[i]
            if page.parent[i] >= 0:
                size[page.parent[i]] += size[i]
                held[page.parent[i]] += held[i]
        y = [v if t == "#text" else int("data-y" in a or "data-y" in page.attributes[max(0, q)] and h > 0.5 * s or q > 0 and page.tag[q] not in ("html", "body") and h > 0.9 * s) for v, t, h, s, a, q in zip(y, page.tag, held, size, page.attributes, page.parent)]
        pages.append(page)
        labels.append(y)
    return train(pages, labels)


def texts_of(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page's source."""
    parsed = [Page(x or "") for x in pages]
    if not parsed:
        return []
    marginal, _ = Forest(parsed).infer(*model)
    out, at = [], 0
    for page in parsed:
        n = len(page.tag)
        out.append("\n".join(t for t, k, p in zip(page.text, page.tag, marginal[at : at + n]) if k == "#text" and p >= 0.5))
        at += n
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text string, n_chars long of every row of pages (page_id, url, html).

    A null or empty html, or one without content, has an empty text. Nothing is cut from a long page. Repeated
    rows give the same each; other columns are ignored; an empty table gives no rows. No shuffle.
    """
    small_batches(pages.sparkSession)
    weights, pairs = trained()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = texts_of(part.column(2).to_pylist(), (weights, pairs))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
