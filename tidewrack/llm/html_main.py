"""HTML extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

Each page is parsed into its block elements, and those inline ones whose class, id or role names what isn't main text
(an advert within a line). Two boosted models of symmetric trees look at every node: is all of its
text main text or none of it (keep), and does it hold both (mixed). Features are subtree text and link density, tags,
tokens of class, id and role, depth, sibling statistics, and what stands above and below. Decoding takes the likeliest choice
for the whole tree in which a kept node has only kept, and a dropped one only dropped descendants.

The tables have no labels for this, so the models learn from pages made here (seeded; many layouts, text of random
words, every node's label known) and from at most SAMPLE pages of the table that mark their text themselves (one
<article> or <main>): the other parts of these pages teach what the site's own surroundings look like. What stands
in such an <article> under a name of adverts, comments, forms and the like isn't taken for main text there either.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most pages of the table, and pages made here, that the models learn from.
SAMPLE, MADE = 150, 400
TREES, DEPTH, RATE, BINS, SEED = 40, 4, 0.2, 32, 11

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TERM = re.compile(r"[a-z]+")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style".split())
#: Elements whose text isn't a page's text.
HIDDEN = frozenset("head title template noscript iframe object svg math button select option textarea datalist audio video canvas map".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: What can stand in a head; any other start ends it.
HEAD = frozenset("base link meta noscript script style template title head html".split())
#: A start of the first closes an open one of the others, up to the nearest of the last.
_CLOSES = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
TAGS = ("h1 h2 h3 h4 h5 h6", "p", "ul ol dl menu", "li dd dt", "nav", "header", "footer", "aside", "article", "main", "section", "div", "table tbody thead tr td th", "form fieldset", "blockquote pre", "figure figcaption", "body html")
_TAG = {t: n for n, group in enumerate(TAGS) for t in group.split()}
TERMS = (
    "article content post entry main story text body page", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager", "ad ads adv advert advertisement sponsor sponsored promo banner",
    "comment comments reply replies respond disqus discussion", "sidebar side widget related share social recommend tags", "cookie cookies consent notice alert popup modal newsletter subscribe gdpr", "footer foot copyright header masthead logo top bottom contentinfo", "form login search signup",
)
_TERMS = {t: n for n, group in enumerate(TERMS) for t in group.split()}
#: Of TERMS those that name what isn't main text.
CLUTTER = ((1 << len(TERMS)) - 1) & ~1
ASIDE = frozenset("aside footer form nav".split())
_PLAIN = 15
FEATURES = _PLAIN + 4 * len(TAGS) + 4 * len(TERMS)


@dataclass
class Page:
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    terms: list[int] = field(default_factory=list)  # bits
    inline: list[int] = field(default_factory=list)  # tags inside that are no nodes
    block: list[int] = field(default_factory=list)  # the block a node belongs to: itself, or of an inline one its parent's
    runs: list[tuple[int, str, bool]] = field(default_factory=list)  # node, text, in a link; in page order
    breaks: set[int] = field(default_factory=set)  # numbers of runs before which a block begins or ends


def boxed(page: Page) -> Page:
    """Gives the text beside inline nodes a node of its own, so that a block can drop an advert within its text and keep the rest."""
    beside: dict[int, int] = {b: -1 for n, b in enumerate(page.block) if b != n}
    for k, (node, text, link) in enumerate(page.runs if beside else ()):
        if node in beside:
            if beside[node] < 0:
                beside[node] = len(page.tag)
                page.tag.append(page.tag[node])
                page.parent.append(node)
                page.terms.append(0)
                page.inline.append(0)
                page.block.append(node)
            page.runs[k] = (beside[node], text, link)
    return page


def parse(source: str) -> Page:
    page = Page()
    stack: list[int] = []
    hidden: list[str] = []
    link, at = 0, 0

    def named(attrs: str) -> int:
        bits = 0
        if attrs and "=" in attrs:
            for groups in _ATTR.findall(attrs):
                for term in _TERM.findall("".join(groups).lower()):
                    if (n := _TERMS.get(term)) is not None:
                        bits |= 1 << n
        return bits

    def open_(tag: str, bits: int, is_block: bool = True) -> None:
        node = len(page.tag)
        page.tag.append(tag)
        page.parent.append(stack[-1] if stack else -1)
        page.terms.append(bits)
        page.inline.append(0)
        page.block.append(node if is_block else page.block[stack[-1]])
        if is_block:
            page.breaks.add(len(page.runs))
        if tag not in VOID:
            stack.append(node)

    def close(until: int) -> None:
        del stack[until:]
        page.breaks.add(len(page.runs))

    open_("html", 0)
    while True:
        found = _TOKEN.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text and not hidden and not text.isspace():
            page.runs.append((stack[-1], html.unescape(text), link > 0))
        elif text and not hidden:
            page.runs.append((stack[-1], " ", False))
        if not found:
            return boxed(page)
        at = found.end()
        shut, name, attrs = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if hidden:
            if shut and name in hidden:
                while hidden.pop() != name:
                    pass
            elif not shut and name == "body" and hidden[0] == "head":
                hidden.clear()
            elif not shut and name in HIDDEN and not attrs.endswith("/"):
                hidden.append(name)
            elif not shut and hidden == ["head"] and name not in HEAD:
                hidden.clear()
            if hidden and (name not in RAW or shut):
                continue
            if shut:
                continue
        if name in RAW:
            if not shut:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
        elif name in HIDDEN:
            if not shut and not attrs.endswith("/"):
                hidden.append(name)
        elif name not in BLOCKS:
            page.inline[stack[-1]] += not shut
            if shut:
                for i in range(len(stack) - 1, 0, -1):
                    if page.block[stack[i]] == stack[i]:
                        break
                    if page.tag[stack[i]] == name:
                        del stack[i:]
                        break
            elif not attrs.endswith("/") and (bits := named(attrs)) & CLUTTER:
                open_(name, bits, False)
            if name == "a":
                link = 0 if shut else 1
            elif name == "br":
                page.runs.append((stack[-1], " ", False))
        elif shut:
            for i in range(len(stack) - 1, 0, -1):
                if page.tag[stack[i]] == name:
                    close(i)
                    break
        elif name != "html":
            link = 0
            while page.block[stack[-1]] != stack[-1]:
                stack.pop()
            if len(stack) > 1 and page.tag[stack[-1]] == "p":
                close(len(stack) - 1)
            if name in _CLOSES:
                own, stop = _CLOSES[name]
                for i in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[i]] in stop:
                        break
                    if page.tag[stack[i]] in own:
                        close(i)
                        break
            open_(name, named(attrs))


def blocks(page: Page, kept: np.ndarray) -> list[str]:
    """Texts of the kept nodes' blocks in page order, white space made one space; empty ones go."""
    out, own = [], []
    last = -1
    for n, (node, text, _) in enumerate(page.runs):
        if n in page.breaks or page.block[node] != last:
            if own:
                out.append(" ".join("".join(own).split()))
            own, last = [], page.block[node]
        if kept[node]:
            own.append(text)
    if own:
        out.append(" ".join("".join(own).split()))
    return [t for t in out if t]


@dataclass
class Forest:
    """The trees of several pages in one numbering: parents (-1 for roots) and, by depth, the nodes."""

    first: np.ndarray  # each page's first node, and the end
    parent: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, pages: list[Page]) -> Forest:
        first = np.cumsum([0, *(len(p.tag) for p in pages)])
        parent = np.concatenate([np.where((q := np.array(p.parent)) < 0, -1, q + a) for p, a in zip(pages, first, strict=False)])
        levels, depth = [], np.zeros(len(parent), np.int64)
        here = np.flatnonzero(parent < 0)
        order = np.argsort(parent, kind="stable")
        starts = np.searchsorted(parent[order], np.arange(len(parent) + 1))
        while len(here):
            levels.append(here)
            size = starts[here + 1] - starts[here]
            ends = np.cumsum(size)
            here = order[np.repeat(starts[here] - ends + size, size) + np.arange(ends[-1])] if ends[-1] else here[:0]
            depth[here] = len(levels)
        return cls(first, parent, levels)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each node and all below it."""
        x = x.copy()
        for nodes in self.levels[:0:-1]:
            np.add.at(x, self.parent[nodes], x[nodes])
        return x


def features(pages: list[Page], forest: Forest | None = None) -> np.ndarray:
    """A row of FEATURES for each node of all pages."""
    forest = forest or Forest.of(pages)
    first_node, parent = forest.first, forest.parent
    n = len(parent)
    node, size, link, points, place, seen = [], [], [], [], [], np.zeros(len(pages))
    for k, (page, base) in enumerate(zip(pages, first_node.tolist(), strict=False)):
        at = 0
        for own, t, in_link in page.runs:
            if t != " ":
                node.append(own + base)
                size.append(len(t))
                link.append(in_link)
                points.append(t.count(".") + t.count(","))
                place.append(at)
                at += len(t)
        seen[k] = at
    node, size = np.array(node, np.int64), np.array(size, np.float64)
    own = np.bincount(node, size, n)
    summed = forest.sums(np.stack([own, np.bincount(node, size * np.array(link, bool), n), np.bincount(node, points, n), np.bincount(node, minlength=n), 1.0 + np.concatenate([p.inline for p in pages])], axis=1))
    text, linked, dots, runs, tags = summed.T
    start = np.full(n, np.inf)
    np.minimum.at(start, node, np.array(place, np.float64))
    for nodes in forest.levels[:0:-1]:
        np.minimum.at(start, parent[nodes], start[nodes])
    seen = np.repeat(seen, np.diff(first_node))
    start = np.where(np.isinf(start), seen, start)
    up = np.maximum(parent, 0)
    child = parent >= 0
    children = np.bincount(parent[child], minlength=n).astype(float)
    order = np.argsort(parent, kind="stable")
    sorted_ = parent[order]
    index = np.zeros(n)
    index[order] = np.arange(n) - np.searchsorted(sorted_, sorted_)
    index[~child] = 0
    depth = np.zeros(n)
    one = np.zeros((n, len(TAGS)), np.float32)
    one[np.arange(n), [_TAG.get(t, _TAG["div"]) for p in pages for t in p.tag]] = 1
    terms = ((np.concatenate([p.terms for p in pages])[:, None] >> np.arange(len(TERMS))) & 1).astype(np.float32)
    both = np.concatenate([one, terms], axis=1)
    above = np.zeros_like(both)
    for d, nodes in enumerate(forest.levels[1:], 1):
        depth[nodes] = d
        above[nodes] = np.maximum(above[parent[nodes]], both[parent[nodes]])
    below = np.zeros_like(both)
    for nodes in forest.levels[:0:-1]:
        np.maximum.at(below, parent[nodes], np.maximum(below[nodes], both[nodes]))
    beside = np.where(child, np.maximum(children[up], 1), 1)
    mean = np.where(child, text[up] - own[up], text) / beside
    plain = np.stack([depth, np.log1p(own), np.log1p(text), linked / np.maximum(text, 1), np.log1p(text / tags), np.log1p(children), index / beside, np.log1p(beside), np.log1p(mean), dots / np.maximum(text, 1), np.log1p(text / np.maximum(runs, 1)), start / np.maximum(seen, 1), text / np.maximum(seen, 1), np.log1p(seen), np.where(child, text / np.maximum(text[up], 1), 1)], axis=1)
    return np.concatenate([plain, both, both[up] * child[:, None], above, below], axis=1, dtype=np.float32)


class Boosted:
    """Gradient-boosted symmetric trees (one split for each level) on the logistic loss."""

    def __init__(self) -> None:
        self.base, self.trees = 0.0, []

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for splits, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for column, limit in splits:
                at = at * 2 + (x[:, column] > limit)
            out += leaves[at]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
        limits = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(x.shape[1])]
        binned = np.stack([np.searchsorted(limits[c], x[:, c], "left") for c in range(x.shape[1])], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            at, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                best = (0.0, None, None)
                size = 1 << level
                for c in range(x.shape[1]):
                    if not len(limits[c]):
                        continue
                    key = at * BINS + binned[:, c]
                    gs, hs = (np.bincount(key, w, size * BINS).reshape(size, BINS) for w in (g, h))
                    gl, hl = np.cumsum(gs, axis=1)[:, :-1], np.cumsum(hs, axis=1)[:, :-1]
                    gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                    gain = (gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)).sum(axis=0)[: len(limits[c])]
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), c, k)
                if best[1] is None:
                    break
                splits.append((best[1], float(limits[best[1]][best[2]])))
                at = at * 2 + (binned[:, best[1]] > best[2])
            if not splits:
                break
            leaves = rate * np.bincount(at, g, 1 << len(splits)) / (np.bincount(at, h, 1 << len(splits)) + 1)
            self.trees.append((splits, leaves))
            margin += leaves[at]
        return self


def decode(forest: Forest, keep: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Which nodes are kept in the likeliest consistent choice; keep, mixed: log-odds of each node.

    A node is kept or dropped with all below it, or mixed and each child chooses; a node without children isn't mixed.
    """
    parent = forest.parent
    log = lambda m: -np.logaddexp(0, -m)
    inner = np.zeros(len(parent), bool)
    inner[parent[parent >= 0]] = True
    pure = np.where(inner, log(-mixed), 0)
    take, leave, split = log(keep) + pure, log(-keep) + pure, np.where(inner, log(mixed), -np.inf)
    for nodes in forest.levels[:0:-1]:
        up = parent[nodes]
        np.add.at(split, up, np.maximum(np.maximum(take[nodes], leave[nodes]), split[nodes]))
        np.add.at(take, up, take[nodes])
        np.add.at(leave, up, leave[nodes])
    own = np.stack([leave, take, split]).argmax(axis=0)  # 0 dropped, 1 kept, 2 mixed
    for nodes in forest.levels[1:]:
        over = own[parent[nodes]]
        own[nodes] = np.where(over == 2, own[nodes], over)
    return own == 1


# --- pages to learn from -------------------------------------------------------------------------------


def made_page(rng: random.Random) -> str:
    """A page whose main text stands between <x-main> marks, which no browser shows and the trainer strips."""
    syllables = [rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "n", "r", "s"]) for _ in range(40)]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        return words(5, 18).capitalize() + rng.choice(".....?!") if rng.random() < 0.8 else " ".join(word() + rng.choice(["***", "%%%", "!!", " |", ","]) for _ in range(rng.randint(4, 30)))

    def attrs(*terms: str) -> str:
        return "" if rng.random() < 0.3 else f' {rng.choice(["class", "id"])}="{rng.choice(terms)}{rng.choice(["", "-box", "-1", " wide", "-inner"])}"'

    para = lambda: "<p>" + " ".join(sentence() for _ in range(rng.randint(1, 6))) + ("</p>" if rng.random() < 0.9 else "")
    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b))) + "</ul>"
    parts = []
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        parts.append(f"<h{(k := rng.randint(2, 4))}>{words(2, 8)}</h{k}>" if kind < 0.12 else "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>" if kind < 0.2 else f"<blockquote>{para()}</blockquote>" if kind < 0.25 else f"<p><b>{sentence()}<br>" if kind < 0.32 else f"<section>{para()}{para()}</section>" if kind < 0.36 else f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>" if kind < 0.39 else para())
    ad = lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo banner"])}">{rng.choice([sentence(), links(1, 4), para()])}</div>'
    share = lambda: f"<div{attrs('share', 'social', 'related', 'tags')}>{links(2, 5)}</div>"
    title = f"<h1>{words(2, 10)}</h1>" if rng.random() < 0.85 else ""
    form = lambda: f"<form{attrs('newsletter', 'login', 'signup', 'search')}>{rng.choice([f'<p>{sentence()}</p>', f'<label>{words(1, 2)}</label>', ''])}<input>{rng.choice(['<button>Go</button>', words(1, 6), para()])}</form>"
    comments = lambda: f"<div{attrs('comments', 'replies')}><div class=\"comment\">{para()}</div></div>"
    notice = lambda: f'<div class="{rng.choice(["cookie", "notice", "alert", "newsletter"])}">{rng.choice([sentence(), para()])}</div>'
    aside = lambda: f"<aside{attrs('related', 'sidebar', 'widget')}>{rng.choice([para(), links(2, 5)])}</aside>"
    spot = lambda: f'<p>{sentence()} </x-main><{(t := rng.choice(["span", "a", "em"]))} class="{rng.choice(["ad", "sponsored", "promo", "share"])}">{rng.choice([words(1, 5), sentence()])}</{t}><x-main> {sentence()}</p>'
    for make, chance in ((ad, 0.3), (share, 0.15), (form, 0.25), (comments, 0.1), (notice, 0.15), (aside, 0.15), (lambda: f"<nav>{links(1, 5)}</nav>", 0.15)):
        if rng.random() < chance:
            parts.insert(rng.randrange(len(parts) + 1), f"</x-main>{make()}<x-main>")
    if rng.random() < 0.35:
        parts.insert(rng.randrange(len(parts) + 1), spot())
    main = f"<x-main>{title}{''.join(parts)}</x-main>"
    tag, extra = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", attrs("content", "post", "entry", "article-body", "story", "main")), ("div", attrs("post-content", "text")), ("section", attrs("content", "article")), ("", "")])
    body = (f"<{tag}{extra}>" if tag else "") + main + (f"<section{attrs('comments', 'discussion', 'replies')}><h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><p>{sentence()}</p></div>' for _ in range(rng.randint(1, 6))) + "</section>" if rng.random() < 0.2 else "") + (f"</{tag}>" if tag else "")
    before, after = [], []
    nav = lambda: rng.choice([f"<nav>{links(3, 9)}</nav>", f"<div{attrs('nav', 'menu', 'navbar')}>{links(3, 9)}</div>", f'<nav class="breadcrumb"><a href="/">{word()}</a> &gt; <a href="/x">{word()}</a></nav>'])
    for chance, make in ((0.4, lambda: f"<header>{rng.choice(['', f'<h2>{words(1, 4)}</h2>'])}<p>{words(2, 8)}</p></header>"), (0.8, nav), (0.25, lambda: f"<div{attrs('cookie', 'notice', 'consent', 'alert')}><p>{sentence()}</p><button>OK</button></div>"), (0.4, ad), (0.15, lambda: f'<form action="/s"><label>{word()}</label><input></form>')):
        if rng.random() < chance:
            before.append(make())
    for chance, make in ((0.3, lambda: f"<section{attrs('comments', 'replies')}>" + "".join(f"<div{attrs('comment', 'reply')}><p>{' '.join(sentence() for _ in range(rng.randint(1, 3)))}</p></div>" for _ in range(rng.randint(1, 8))) + "</section>"), (0.35, lambda: f"<aside{attrs('sidebar', 'widget')}><h3>{words(1, 3)}</h3>{rng.choice([links(2, 8), para()])}</aside>"), (0.25, share), (0.25, ad), (0.15, lambda: f"<form{attrs('newsletter', 'login', 'signup')}><p>{sentence()}</p><input></form>"), (0.85, lambda: f"<footer>&copy; {word()}.example &middot; {sentence()}{rng.choice(['', links(2, 5)])}</footer>")):
        if rng.random() < chance:
            after.append(make())
    if rng.random() < 0.1:
        before, after = [], []
    inner = "".join([*before, body, *after])
    if rng.random() < 0.3:
        inner = f"<div{attrs('page', 'wrap', 'container')}>{inner}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var a='<p>';</script></head><body>{inner}</body></html>"


_MARK, _INSIDE = re.compile(r"(</?x-main>)"), "\ue000"


def labelled(marked: str, made: bool) -> tuple[Page, np.ndarray, np.ndarray]:
    """The page without its marks; characters of main text and of all text below each node.

    Of pages that were not made here, what stands under a name of clutter in an <article> or <main> isn't main text.
    """
    on, plain = False, []
    for part in _MARK.split(marked):
        if part in ("<x-main>", "</x-main>"):
            on = part == "<x-main>"
        else:
            plain.append(re.sub(r"(^|>)([^<]*[^<\s])", r"\1" + _INSIDE + r"\2", part) if on else part)
    page = parse("".join(plain))
    main, total = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for n, (node, text, link) in enumerate(page.runs):
        bare = text.replace(_INSIDE, "")
        size = len(bare.strip())
        total[node] += size
        main[node] += size if len(bare) < len(text) else 0
        page.runs[n] = (node, bare, link)
    if not made:
        within, clutter = [False] * len(page.tag), [False] * len(page.tag)
        for i in range(1, len(page.tag)):
            up = page.parent[i]
            within[i] = within[up] or page.tag[up] in ("article", "main")
            clutter[i] = clutter[up] or within[i] and (bool(page.terms[i] & CLUTTER) or page.tag[i] in ASIDE)
        main[np.array(clutter)] = 0
    for i in range(len(page.tag) - 1, 0, -1):
        main[page.parent[i]] += main[i]
        total[page.parent[i]] += total[i]
    return page, main, total


def self_marked(source: str) -> str | None:
    """The page with marks around its only <article> or <main>, if it has just one of them."""
    for tag in ("article", "main"):
        opens, shuts = (list(re.finditer(rf"<{tag}\b[^>]*>", source)), list(re.finditer(rf"</{tag}>", source)))
        if len(opens) == len(shuts) == 1 and opens[0].end() <= shuts[0].start():
            a, b = opens[0].end(), shuts[0].start()
            return f"{source[:a]}<x-main>{source[a:b]}</x-main>{source[b:]}"
    return None


def fit(sources: list[str], made: int = MADE, seed: int = SEED) -> tuple[Boosted, Boosted]:
    """The models (keep, mixed)."""
    rng = random.Random(seed)
    own = [labelled(made_page(rng), True) for _ in range(made)]
    pages, main, total = zip(*own, *(labelled(m, False) for s in sources if (m := self_marked(s))), strict=True)
    main, total = np.concatenate(main), np.concatenate(total)
    x, share = features(list(pages))[total > 0], main[total > 0] / total[total > 0]
    pure = (share == 0) | (share == 1)
    return Boosted().fit(x[pure], share[pure]), Boosted().fit(x, (~pure).astype(float))


def main_texts(pages: list[Page], models: tuple[Boosted, Boosted]) -> list[str]:
    forest = Forest.of(pages)
    x = features(pages, forest)
    kept = decode(forest, models[0].margin(x), models[1].margin(x))
    return ["\n".join(blocks(page, kept[a:b])) for page, a, b in zip(pages, forest.first[:-1].tolist(), forest.first[1:].tolist(), strict=True)]


def extract(pages: DataFrame, sample: int = SAMPLE, made: int = MADE) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html, ...).

    Null and empty html have an empty text; html without any block is judged like one. Repeated rows each give a row,
    nulls in page_id or url stay, an empty table gives an empty result; further columns are not read.
    """
    chosen = pages.where("html is not null and page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    seen = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    models = fit([r.html for r in seen.orderBy("page_id").collect() if r.html], made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                texts = main_texts([parse(h or "") for h in batch.column("html").to_pylist()], models)
                yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
