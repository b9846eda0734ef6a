"""Main text of web pages by a graphical model on the tree of their block elements.

Every block element is a node with a hidden label, content or not. A node's own potential is
log-linear in its tag, the words of its class, id and role, and its text (length, links, sentence ends);
each parent-child pair has a potential by their kinds of tags. Sum-product messages go up and then down
the tree, which gives exact marginals; texts of nodes whose content marginal is at least 1/2 are kept.
Weights are trained by gradient steps on the likelihood of labelled pages, whose exact gradient the
same messages give. A batch of pages is one forest, and a message step is a numpy step a tree level.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import first_by_hash

#: Fixed by the HTML standard: elements without content, and with text that is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Ends are looked for no further out than these.
SCOPE = frozenset("ul ol dl table body html select article section div".split())
KINDS = {t: k for k, tags in {"text": "p h1 h2 h3 h4 h5 h6 blockquote pre figcaption", "item": "li dt dd td th tr ul ol dl table tbody thead", "main": "article main", "edge": "nav header footer aside menu", "form": "form fieldset button select option label legend dialog", "page": "html body"}.items() for t in tags.split()}
KIND_IDS = {k: n for n, k in enumerate(["other", "text", "item", "main", "edge", "form", "page"])}
#: A comment, a declaration, or a tag without quoted values; a tag with them begins like OPEN and ends where Tags says.
TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)([^>\"'<]*+)>", re.S)
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
MARK = re.compile(r"<(?=[!?/a-zA-Z])")
STOP = re.compile(r"[>\"']")
#: Elements deeper than this hang on the one at this depth of their branch.
DEEPEST = 256
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
KEPT = "data-kept"


@dataclass
class Page:
    """Nodes in page order (parents before children), and the texts of nodes in page order."""

    parent: list[int]
    tags: list[str]
    names: list[frozenset[str]]
    labels: list[int]
    texts: list[tuple[int, str]]
    linked: list[int]


class Tags:
    """The tags of a source in order, in linear time however many of them never end."""

    def __init__(self, source: str):
        self.source = source
        self.open: set[int] = set()  # marks outside quotes from which no end is reached
        self.without = {c: len(source) + 1 for c in "\"'"}  # from where on there is no such quote
        self.no_stop = len(source) + 1

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """Begin, end, "/" of an end tag, lower-case name ("" for a comment) and attributes of the next tag; begin is the source's length where there is none."""
        source = self.source
        while m := MARK.search(source, at):
            if tag := TAG.match(source, m.start()):
                return tag.start(), tag.end(), tag[1] or "", (tag[2] or "").lower(), tag[3] or ""
            name = OPEN.match(source, m.start())
            if name and (end := self.end(name.end())):
                return m.start(), end, name[1], name[2].lower(), source[name.end() : end - 1]
            at = m.end()
        return len(source), len(source), "", "", ""

    def end(self, at: int) -> int:
        """Where a tag whose attributes begin at `at` ends, quoted values passed over; 0 where it does not."""
        passed = []
        while at < self.no_stop:
            stop = STOP.search(self.source, at)
            if not stop:
                self.no_stop = at
                break
            if stop[0] == ">":
                return stop.end()
            if stop.start() in self.open:
                break
            passed.append(stop.start())
            close = self.source.find(stop[0], stop.end()) if stop.end() < self.without[stop[0]] else -1
            if close < 0:
                self.without[stop[0]] = min(self.without[stop[0]], stop.end())
                break
            at = close + 1
        self.open.update(passed)
        return 0


class Branch:
    """The open elements, with how deep those of each tag lie."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["html"]
        self.depths: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]

    def push(self, node: int, tag: str) -> None:
        self.depths.setdefault(tag, []).append(len(self.tags))
        if tag in SCOPE:
            self.scopes.append(len(self.tags))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, depth: int) -> None:
        """Close the element at a depth and all inside it."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.nodes.pop()
            self.depths[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def deepest(self, tag: str) -> int:
        """The depth of the innermost open element of a tag; 0 where there is none."""
        found = self.depths.get(tag)
        return found[-1] if found else 0


def parse(source: str | None) -> Page:
    """The block elements of a page, however broken its markup is; node 0 is the page itself.

    The time is linear in the page's length. Elements deeper than DEEPEST hang on the one at that depth;
    none is left out.
    """
    page = Page([-1], ["html"], [frozenset()], [0], [], [0])
    branch = Branch()
    parts: list[str] = []
    links = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.texts.append((branch.nodes[-1], text))
            parts.clear()

    source, at = source or "", 0
    tags, no_end = Tags(source), {}
    while at < len(source):
        begin, end_at, slash, tag, attributes = tags.next(at)
        text = source[at:begin]
        if text:
            parts.append(text)
            if links:
                page.linked[branch.nodes[-1]] += len(text)
        if begin == len(source):
            break
        at = end_at
        if not tag:
            continue
        if not slash and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at) if not attributes.endswith("/") else None
            at = end.end() if end else at if attributes.endswith("/") else len(source)
            continue
        if tag in VOID:
            if tag != "wbr" and not slash:
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if slash else 1
            continue
        flush()
        links = 0
        if tag in ("html", "body"):
            continue
        if slash:
            if depth := branch.deepest(tag):
                branch.cut(depth)
            continue
        if branch.tags[-1] == "p":
            branch.cut(len(branch.tags) - 1)
        depth = max((branch.deepest(t) for t in ENDS.get(tag, ())), default=0)
        scope = max((d for d in branch.scopes[-1:] if branch.tags[d] not in ENDS.get(tag, ())), default=0)
        if depth > scope:
            branch.cut(depth)
        if tag == "head":
            end = None if no_end.get(tag) else re.compile(r"</head\s*>|<body\b", re.I).search(source, at)
            no_end[tag] = not end
            at = (end.end() if source[end.start() + 1] == "/" else end.start()) if end else at
            continue
        words: set[str] = set()
        if attributes.strip("/ "):
            for name, value in NAMES.findall(attributes):
                words.update(p.lower() for p in PIECES.findall(value))
        node = len(page.tags)
        page.parent.append(branch.nodes[min(len(branch.nodes), DEEPEST) - 1])
        page.tags.append(tag)
        page.names.append(frozenset(words))
        page.labels.append(int(f'{KEPT}="1"' in attributes))
        page.linked.append(0)
        branch.push(node, tag)
    flush()
    return page


def bucket(n: int) -> int:
    return 0 if n <= 0 else min(6, n.bit_length() // 2 + 1)


def node_features(page: Page) -> list[list[str]]:
    """Names of the features that each node has."""
    n = len(page.tags)
    words, chars, ends = [0] * n, [0] * n, [0] * n
    for node, text in page.texts:
        words[node] += text.count(" ") + 1
        chars[node] += len(text)
        ends[node] += text[-1] in ".!?…。！？\"'”"
    all_words, all_chars, all_links = list(words), list(chars), list(page.linked)
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        all_words[up] += all_words[node]
        all_chars[up] += all_chars[node]
        all_links[up] += all_links[node]
    out = []
    for node in range(n):
        own = ["bias", f"tag {page.tags[node]}", f"kind {KINDS.get(page.tags[node], 'other')}", f"words {bucket(words[node])}", f"below {bucket(all_words[node])}"]
        if words[node]:
            own.append(f"ends {int(ends[node] > 0)}")
            own.append(f"links {min(3, 4 * page.linked[node] // max(1, chars[node]))}")
        if all_chars[node]:
            own.append(f"links below {min(3, 4 * all_links[node] // all_chars[node])}")
        own += [f"name {w}" for w in sorted(page.names[node])]
        out.append(own)
    return out


@dataclass
class Forest:
    """Pages as one forest: nodes level by level, each with feature numbers and the kind of its edge upward."""

    parent: np.ndarray
    level: list[np.ndarray]
    edge: np.ndarray
    node: np.ndarray
    feature: np.ndarray

    @classmethod
    def of(cls, pages: list[Page], numbers: dict[str, int], grow: bool = False) -> Forest:
        parent, edge, depth, node, feature = [], [], [], [], []
        base = 0
        for page in pages:
            for n, (up, names) in enumerate(zip(page.parent, node_features(page), strict=True)):
                parent.append(up + base if up >= 0 else -1)
                depth.append(depth[up + base] + 1 if up >= 0 else 0)
                above = KIND_IDS[KINDS.get(page.tags[up], "other")] if up >= 0 else 0
                edge.append(above * len(KIND_IDS) + KIND_IDS[KINDS.get(page.tags[n], "other")])
                for f in names:
                    k = numbers.setdefault(f, len(numbers)) if grow else numbers.get(f)
                    if k is not None:
                        node.append(base + n)
                        feature.append(k)
            base += len(page.parent)
        depth_array = np.array(depth)
        order = np.argsort(depth_array, kind="stable")
        level = np.split(order, np.cumsum(np.bincount(depth_array))[:-1]) if base else []
        return cls(np.array(parent), level, np.array(edge), np.array(node), np.array(feature))

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of nodes, and P(label of parent, own label) of nodes with a parent."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = np.bincount(self.node, weights[self.feature], n)
        pair = pairs[self.edge]
        sent = np.zeros((n, 2))
        for nodes in self.level[:0:-1]:
            sent[nodes] = np.logaddexp(*(up[nodes, None, :] + pair[nodes]).transpose(2, 0, 1))
            for label in (0, 1):
                up[:, label] += np.bincount(self.parent[nodes], sent[nodes, label], n)
        down = np.zeros((n, 2))
        both = np.zeros((n, 2, 2))
        for nodes in self.level[1:]:
            above = self.parent[nodes]
            rest = up[above] + down[above] - sent[nodes]
            joint = rest[:, :, None] + pair[nodes]
            down[nodes] = np.logaddexp(joint[:, 0], joint[:, 1])
            both[nodes] = joint + up[nodes, None, :]
        total = up + down
        content = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60)))
        inner = self.parent >= 0
        flat = both[inner].reshape(-1, 4)
        flat = np.exp(flat - flat.max(axis=1, keepdims=True))
        return content, (flat / flat.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)


@dataclass(frozen=True)
class Model:
    numbers: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def texts(self, pages: list[Page]) -> list[str]:
        """Kept texts of the pages, in page order, with a space between blocks."""
        if not pages:
            return []
        content, _ = Forest.of(pages, self.numbers).marginals(self.weights, self.pairs)
        out, base = [], 0
        for page in pages:
            out.append(" ".join(text for node, text in page.texts if content[base + node] >= 0.5))
            base += len(page.parent)
        return out


def train(pages: list[Page], rounds: int = 200, rate: float = 0.1, l2: float = 2e-3) -> Model:
    """Weights of greatest penalized likelihood of the pages' labels (Adam steps on the exact gradient)."""
    numbers: dict[str, int] = {}
    forest = Forest.of(pages, numbers, grow=True)
    label = np.concatenate([np.array(p.labels) for p in pages])
    inner = forest.parent >= 0
    kinds = len(KIND_IDS) ** 2
    weights, pairs = np.zeros(len(numbers)), np.zeros((kinds, 2, 2))
    seen = np.zeros((kinds, 2, 2))
    np.add.at(seen, (forest.edge[inner], label[forest.parent[inner]], label[inner]), 1)
    state = [np.zeros_like(x) for x in (weights, weights, pairs, pairs)]
    for step in range(1, rounds + 1):
        content, joint = forest.marginals(weights, pairs)
        gradient = np.bincount(forest.feature, (label - content)[forest.node], len(numbers)) / len(pages) - l2 * weights
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.edge[inner], joint)
        pair_gradient = (seen - expected) / len(pages) - l2 * pairs
        for g, x, m, v in ((gradient, weights, state[0], state[1]), (pair_gradient, pairs, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(numbers, weights, pairs)


class Layouts:
    """Labelled pages in the layouts that sites use, with invented words."""

    CONTENT = "article content post entry story main text body page single".split()
    BOXES = {
        "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs toc links",
        "header": "header masthead top site head logo brand",
        "footer": "footer bottom foot copyright legal colophon",
        "side": "sidebar side aside widget rail related recommended popular more trending author bio tags",
        "ad": "ad ads advert advertisement banner promo sponsor sponsored adsense promotion",
        "notice": "cookie notice consent gdpr alert warning popup modal overlay paywall message",
        "comments": "comments comment replies reply discussion disqus responses thread respond user",
        "form": "form search login subscribe newsletter signup register contact",
        "share": "share social sharing toolbar buttons tools meta pagination pager print",
    }

    def __init__(self, seed: int):
        self.random = np.random.default_rng(seed)

    def some(self, choices):
        return choices[int(self.random.integers(len(choices)))]

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.some("abcdefghilmnoprstu") for _ in range(int(self.random.integers(2, 9)))) for _ in range(int(self.random.integers(low, high))))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(f"{self.words(3, 14).capitalize()}{self.some(['.', '.', '.', '?', '!'])}" for _ in range(int(self.random.integers(low, high))))

    def tag(self, name: str, inner: str, kept: int, words: str = "") -> str:
        names = f" {self.some(['class', 'class', 'id'])}=\"{words}\"" if words else ""
        return f'<{name}{names} {KEPT}="{kept}">{inner}</{name}>'

    def link(self) -> str:
        return f'<a href="/x">{self.words(1, 4)}</a>'

    def name(self, words: str) -> str:
        found = words.split()
        first = self.some(found)
        return first if self.chance(0.6) else f"{self.some(['site', 'page', 'box', 'c', 'wrap', 'js'])}{self.some(['-', '_', ' '])}{first}"

    def box(self, kind: str) -> str:
        """A part that is not content."""
        words = self.name(self.BOXES[kind])
        plain = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        own = plain if self.chance(0.5) else self.some(["div", "div", "section", "ul" if kind == "nav" else "div"])
        items = int(self.random.integers(2, 7))
        if kind in ("nav", "share"):
            inner = "".join(self.tag("li", self.link(), 0) for _ in range(items))
            inner = inner if own == "ul" else self.tag("ul", inner, 0) if self.chance(0.7) else "".join(self.link() for _ in range(items))
        elif kind == "comments":
            one = lambda: self.tag(self.some(["div", "li", "article", "p"]), self.tag("p", self.sentences(1, 5), 0) if self.chance(0.7) else self.sentences(1, 4), 0, self.name(self.BOXES[kind]) if self.chance(0.7) else "")
            inner = (self.tag("h3", self.words(1, 4), 0) if self.chance(0.5) else "") + "".join(one() for _ in range(items))
        elif kind == "form":
            inner = self.tag("label", self.words(1, 4), 0) + '<input name="q">' + self.tag("button", self.words(1, 3), 0) + (self.tag("p", self.sentences(1, 3), 0) if self.chance(0.4) else "")
        else:
            inner = "".join(self.some([self.link, lambda: self.sentences(1, 3), lambda: self.words(1, 8), lambda: self.tag("p", self.sentences(1, 4), 0), lambda: self.tag("ul", "".join(self.tag("li", self.link(), 0) for _ in range(3)), 0), lambda: self.tag("h3", self.words(1, 5), 0)])() for _ in range(int(self.random.integers(1, 4))))
        return self.tag(own, inner, 0, words if own == "div" or own == "section" or own == "ul" or self.chance(0.4) else "")

    def block(self) -> str:
        """A part of an article."""
        text = self.some([lambda: self.sentences(1, 9), lambda: self.sentences(1, 3), lambda: self.sentences(6, 25), lambda: self.words(1, 12), lambda: f"<b>{self.sentences(1, 3)}</b> {self.sentences(0, 3)} {self.link()} {self.sentences(1, 3)}"])()
        kind = self.random.random()
        if kind < 0.72:
            return self.tag("p", text, 1)
        if kind < 0.8:
            return self.tag(self.some(["h2", "h3", "h4"]), self.words(1, 9), 1)
        if kind < 0.86:
            return self.tag(self.some(["ul", "ol"]), "".join(self.tag("li", self.some([self.words(1, 9), self.sentences(1, 3), f"{self.words(2, 6)} {self.link()}"]), 1) for _ in range(4)), 1)
        if kind < 0.9:
            return self.tag(self.some(["blockquote", "pre"]), self.tag("p", text, 1) if self.chance(0.5) else text, 1)
        if kind < 0.94:
            row = lambda: self.tag("tr", "".join(self.tag("td", self.words(1, 5), 1) for _ in range(3)), 1)
            return self.tag("table", row() + row(), 1)
        if kind < 0.97:
            return self.tag("figure", self.tag("figcaption", self.sentences(1, 3), 1), 1)
        return self.tag("div", text, 1)

    def page(self) -> str:
        body = [self.tag("h1", self.words(2, 12), 1)] if self.chance(0.85) else []
        body += [self.block() for _ in range(int(self.random.integers(1, 12)))]
        for kind in ("ad", "share", "side", "comments", "notice", "form"):
            if self.chance(0.12):
                body.insert(int(self.random.integers(1, len(body) + 1)), self.box(kind))
        if self.chance(0.3):
            body = [self.tag("div", "".join(body), 1, self.name(" ".join(self.CONTENT)) if self.chance(0.6) else "")]
        own = self.some(["article", "article", "main", "div", "section"])
        main = self.tag(own, "".join(body), 1, self.name(" ".join(self.CONTENT)) if own in ("div", "section") or self.chance(0.3) else "")
        before = [self.box(k) for k in ("header", "nav", "ad", "notice", "share", "form", "side") if self.chance(0.4)]
        after = [self.box(k) for k in ("comments", "side", "ad", "share", "form", "notice", "footer", "footer") if self.chance(0.4)]
        if self.chance(0.4):
            main = self.tag(self.some(["div", "main"]), main + (self.box("side") if self.chance(0.4) else ""), 0, self.some(["", "wrapper", "container", "row", "layout"]))
        return f"<html><head><title>x</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


@lru_cache(maxsize=1)
def default_model(pages: int = 400, seed: int = 7) -> Model:
    """The model of `pages` labelled layouts."""
    layouts = Layouts(seed)
    return train([parse(layouts.page()) for _ in range(pages)])


#: Elements in an article that are beside its text.
BESIDE = frozenset("nav aside header footer form".split())


def marked(page: Page) -> Page | None:
    """The page with the labels that its own markup gives it: its article element and what is below it, but for BESIDE.

    None where it doesn't have just one article.
    """
    if page.tags.count("article") != 1:
        return None
    labels: list[int] = []
    for up, tag in zip(page.parent, page.tags, strict=True):
        labels.append(int(tag == "article" or (up >= 0 and labels[up] == 1 and tag not in BESIDE)))
    return replace(page, labels=labels)


def fit(pages: DataFrame, most: int = 200, most_bytes: int = 100_000, layouts: int = 300, seed: int = 7) -> Model:
    """The model of pages of the table that label their text themselves (see marked), and of made layouts beside them.

    Of the pages that have an article element and at most most_bytes bytes, the `most` first ones by a hash are
    taken: a bounded sample, whatever the table's size. Layouts tell what those pages don't
    show; where no page is labelled, they are all there is.
    """
    labelled = pages.where(F.col("html").contains("<article") & (F.octet_length("html") <= most_bytes)).select(F.xxhash64("page_id", "url", "html").alias("key"), "html")
    rows = first_by_hash(labelled, "key", most, labelled.count()).collect()
    own = [p for p in (marked(parse(r.html)) for r in rows) if p]
    made = Layouts(seed)
    return train(own + [parse(made.page()) for _ in range(layouts)])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row, by a model of fit() or that of made layouts alone.

    Text is '' where html is null or empty or holds no content. Character references are decoded, white
    space within a block becomes one space, and blocks stand in page order with a space between. Pages
    count whole, however long, in time linear in their length. Every row gives a row, repeated ones and
    null ids too; an empty table gives none; other columns are not read.
    """
    used = model or default_model()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), 64):
                out += used.texts([parse(x) for x in batch[at : at + 64].to_pylist()])
            yield pa.array(out, pa.string())

    done = pages.select("page_id", "url", run(F.col("html")).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
