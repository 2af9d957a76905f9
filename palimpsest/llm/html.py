"""Main text of web pages by composite text density.

A page is read into a tree. Elements that can't be content by what they are (menus, footers, controls, scripts, styles,
hidden parts) are cut out by name and role; headers outside of articles, sidebars and forms are, unless they hold most of
the page's text; containers whose class or id says outright that they hold
adverts, notices, comments and the like are too, but never headings, paragraphs or a container with most of the text.
Every node left has a density: its characters per tag, adjusted by how much of both are links. A node's density sum is
that of its children's densities. The node with the greatest sum is the core; the least density on the path from it to
the body is the threshold. Going down from the body, each node that reaches the threshold gives the subtree of greatest
sum in it, and its other children are looked at alike.

What belongs to a subtree chosen is told from its surroundings. Beside a chosen block that is text itself (a paragraph, a
list, a table), the text blocks next to it join; beside a chosen container, the headings before it, and containers of its
own kind with paragraphs that reach half of the threshold. At the two ends of a chosen container, containers below the
threshold and blocks that are nothing but links go; between text they stay.

Text is decoded, white space in a block made one space, and blocks joined by one space in page order.

Nulls and odd cases: a null or empty page, or one without text, gives an empty text; unclosed and stray tags are read as
browsers do, roughly; repeated rows give the same text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
CUT_NAMES = set("nav footer script style noscript template iframe button select input option textarea svg canvas object embed head title dialog link meta map audio video".split())
CUT_ROLES = set("navigation contentinfo search alert alertdialog dialog menu menubar toolbar".split())
#: Elements and roles that are cut unless they hold most of the page's text, as a form around a whole page does.
MOSTLY_NAMES = set("header aside form menu".split())
MOSTLY_ROLES = set("banner complementary form".split())
#: Class names and ids that tell what a container is for, if they are the whole name.
CUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements adsense adslot sponsor sponsored sponsors promo promotion promoted banner sidebar sidebars aside "
    "comment comments commentlist disqus respond reply replies nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended recommendations widget widgets toolbar pagination pager skip search form".split()
)
#: Those that also tell it as the first or last part of a class name.
CUT_PARTS = set("ad ads advert adverts advertisement sponsor sponsored promo sidebar comment comments nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent newsletter subscribe share sharing social related recommended".split())
#: Elements that hold blocks and are no text block themselves.
CONTAINERS = set("div section article main center body span td".split()) | {"#root"}
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that a class or id never cuts.
NEVER_CUT = HEADINGS | INLINE | set("html body p pre blockquote li dt dd td th tr tbody".split())
#: What a start tag closes if it is open.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Elements that stop the search for what an end or start tag closes.
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Share of the threshold that containers beside a chosen one of their kind must reach.
BESIDE = 0.5
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def told_by_class(name: str, found: dict[str, str]) -> bool:
    """Whether class or id of an element say outright that it isn't content."""
    if name in NEVER_CUT:
        return False
    whole = {t.lower() for key in ("class", "id") for t in found.get(key, "").split()}
    if whole & CUT_WORDS:
        return True
    parts = [[w.lower() for w in PART.findall(t)] for t in found.get("class", "").split()]
    return any(len(p) > 1 and (p[0] in CUT_PARTS or p[-1] in CUT_PARTS) and p[0] not in ("has", "no", "with", "without") for p in parts)


class Page:
    """Nodes in page order: name, parent, class, whether cut by what it is or by class; and text with node and block."""

    def __init__(self, page: str):
        self.names, self.parents, self.classes, self.cut, self.mostly, self.worded = ["#root"], [-1], [""], [False], [False], [False]
        self.pieces: list[tuple[int, int, str]] = []
        self.last: list[int] = [0]  # the last node of each subtree
        self.held: dict[str, int] = {"#root": 1}  # how many open elements have each name
        self.open, self.block, at = [0], 0, 0
        stop = page.rfind(">") + 1
        while m := TOKEN.search(page, at, stop):
            self.text(page[at : m.start()])
            at = m.end()
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                at = len(page)
            if m[1]:
                self.end(m[1].lower())
            elif name := (m[2] or m[4] or "").lower():
                self.start(name, m[3] if m[2] else m[5])
                if name in RAW:
                    close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    at = close.end() if close else len(page)
                    self.end(name)
        self.text(page[at:])
        while self.open:
            self.pop()

    def text(self, text: str) -> None:
        if text:
            self.pieces.append((self.open[-1], self.block, text))

    def pop(self) -> None:
        node = self.open.pop()
        self.last[node] = len(self.names) - 1
        self.held[self.names[node]] -= 1
        if self.names[node] not in INLINE:
            self.block += 1

    def close(self, which: set[str], until: set[str] | None) -> None:
        """Close the innermost open element of these names, and all in it, unless one of `until` (None: any but inline
        ones) is in between."""
        if not any(self.held.get(name) for name in which):
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.names[self.open[k]]
            if name in which:
                while len(self.open) > k:
                    self.pop()
                return
            if name not in INLINE if until is None else name in until:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body", "head"):
            if self.held.get(name):
                return
            if name == "body":
                self.close({"head"}, set())
        if name not in INLINE:
            if name != "br":
                self.close({"p"}, {"table", "td", "th", "button", "object", "li", "div", "section", "article", "main", "body"} if name not in ("table",) else {"td", "th", "button"})
            self.block += 1
        if name in CLOSES:
            self.close(CLOSES[name], HOLDS[name])
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes or "")} if attributes and attributes.strip(" /") else {}
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
        self.names.append(name)
        self.parents.append(self.open[-1])
        self.classes.append(found.get("class", ""))
        self.cut.append(name in CUT_NAMES or found.get("role", "").lower() in CUT_ROLES or (hidden and name not in ("html", "body")))
        # a header in an article is the article's: its title, its byline
        page_s = name != "header" or not self.held.get("article")
        self.mostly.append((name in MOSTLY_NAMES and page_s) or found.get("role", "").lower() in MOSTLY_ROLES)
        self.worded.append(told_by_class(name, found))
        self.last.append(len(self.names) - 1)
        if name not in VOID:
            self.open.append(len(self.names) - 1)
            self.held[name] = self.held.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name in INLINE:
            self.close({name}, None)
        else:
            if name not in ("html", "body", "br"):
                self.close({name}, HOLDS.get(name, set()))
            self.block += 1

    def subtree_counts(self, own: list[int]) -> list[int]:
        """own, each added to all nodes above it."""
        total = own[:]
        for k in range(len(own) - 1, 0, -1):
            total[self.parents[k]] += total[k]
        return total

    def main_text(self) -> str:
        n = len(self.names)
        link, cut = [False] * n, [False] * n
        for k in range(1, n):
            p = self.parents[k]
            cut[k], link[k] = cut[p] or self.cut[k], link[p] or self.names[k] == "a"
        texts = [(k, b, html.unescape(t)) for k, b, t in self.pieces if not cut[k]]
        own = [0] * n
        for k, _, t in texts:
            own[k] += len("".join(t.split()))
        every = self.subtree_counts(own)
        for k in range(1, n):
            cut[k] = cut[self.parents[k]] or cut[k] or self.mostly[k] and 2 * every[k] <= every[0]
        every = self.subtree_counts([0 if cut[k] else own[k] for k in range(n)])
        holds = self.subtree_counts([int(self.names[k] in ("article", "main", "h1") and not cut[k]) for k in range(n)])
        gone = cut
        for k in range(1, n):  # by class: not what holds most of the text beside what may be the title or the article
            gone[k] = gone[self.parents[k]] or cut[k] or self.worded[k] and not (holds[k] and 2 * every[k] > every[0])
        kept = [(k, b, t) for k, b, t in texts if not gone[k]]
        chars = self.subtree_counts([0 if gone[k] else own[k] for k in range(n)])
        link_chars = self.subtree_counts([own[k] if link[k] and not gone[k] else 0 for k in range(n)])
        tags, link_tags = [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            if not gone[k]:
                p = self.parents[k]
                tags[p] += tags[k] + 1
                link_tags[p] += link_tags[k] + (self.names[k] == "a")
        body = next((k for k in range(n) if self.names[k] == "body"), 0)
        if not chars[body]:
            body = 0
        ratio = link_chars[body] / max(1, chars[body])
        density, sums = [0.0] * n, [0.0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(n - 1, -1, -1):
            if chars[k] and not gone[k]:
                density[k] = composite_density(chars[k], tags[k], link_chars[k], link_tags[k], ratio)
                if k:
                    sums[self.parents[k]] += density[k]
                    children[self.parents[k]].append(k)
        for c in children:
            c.reverse()
        inside = self.content(body, density, sums, chars, link_chars, children)
        blocks: dict[int, list[str]] = {}
        for k, b, t in kept:
            if inside[k]:
                blocks.setdefault(b, []).append(t)
        return " ".join(x for b in sorted(blocks) if (x := " ".join("".join(blocks[b]).split())))

    def content(self, body: int, density: list[float], sums: list[float], chars: list[int], link_chars: list[int], children: list[list[int]]) -> list[bool]:
        """Which nodes are content: the subtrees chosen by density, with what belongs to them, without weak ends."""
        n = len(self.names)
        inside = [False] * n
        if not chars[body]:
            return inside
        chosen, threshold = self.subtrees(body, density, sums, chars, children)
        linked = lambda k: self.names[k] not in INLINE and link_chars[k] == chars[k]
        container = lambda k: self.names[k] in CONTAINERS and self.names[k] not in INLINE
        paragraphs = lambda k: any(not container(c) and self.names[c] not in INLINE for c in children[k])

        def take(k: int, on: bool = True) -> None:
            inside[k : self.last[k] + 1] = [on] * (self.last[k] + 1 - k)

        for k in chosen:
            up = k
            while up != body and self.names[up] in INLINE:
                up = self.parents[up]
            take(up)
            self.trim(up, density, threshold, children, linked, container, take)
            if up == body or up == 0:
                continue
            beside = children[self.parents[up]]
            at = beside.index(up)
            if not container(up):
                joined = [c for c in beside if not container(c) and not linked(c)]
                ends = [at, *(beside.index(c) for c in joined)]
                for c in beside[min(ends) : max(ends) + 1]:  # what stands between the text blocks stays, containers only if they are dense
                    if not container(c) or density[c] >= threshold:
                        take(c)
                inside[self.parents[up]] = True  # text of the parent itself
            else:
                for c in beside:
                    if c != up and self.names[c] == self.names[up] and self.classes[c] == self.classes[up] and paragraphs(c) and not linked(c) and density[c] >= BESIDE * threshold:
                        take(c)
            while up != body and up > 0:  # headings before it, at every level
                beside = children[self.parents[up]]
                at = beside.index(up)
                while at and self.names[beside[at - 1]] in HEADINGS:
                    at -= 1
                    take(beside[at])
                up = self.parents[up]
        return inside

    def trim(self, k: int, density: list[float], threshold: float, children: list[list[int]], linked, container, take) -> None:
        """Take weak children off both ends of the chosen container k, down through its only children. What is marked as
        an article is left whole; so are short containers beside dense ones where both stand for paragraphs."""
        leaf = lambda c: all(self.names[x] in INLINE for x in children[c])
        while container(k) and self.names[k] not in ("article", "main"):
            own = children[k]
            dense_leaf = any(container(c) and leaf(c) and density[c] >= threshold for c in own)
            weak = [linked(c) or container(c) and density[c] < threshold and not (leaf(c) and dense_leaf) for c in own]
            if all(weak):
                return
            strong = [j for j, w in enumerate(weak) if not w]
            for c in [*own[: strong[0]], *own[strong[-1] + 1 :]]:
                take(c, False)
            if len(own) > 1:
                return
            k = own[0]

    def subtrees(self, body: int, density: list[float], sums: list[float], chars: list[int], children: list[list[int]]) -> tuple[list[int], float]:
        """(nodes, threshold): under each node whose density reaches the threshold, the subtree of greatest density sum;
        then the same for its children that are not in a subtree taken before."""
        n = len(self.names)
        below = [(-1.0, 0)] * n  # the greatest sum under each node, the first of equals
        for j in range(n - 1, 0, -1):
            if density[j] or chars[j]:
                p = self.parents[j]
                below[p] = max(below[p], below[j], (sums[j], -j))

        def core(k: int) -> int:
            return -max((sums[k] or density[k], -k), below[k])[1]

        up = best = core(body)
        threshold = density[best]
        while up != body and up > 0:
            up = self.parents[up]
            threshold = min(threshold, density[up])
        chosen, marked, at = [], [False] * n, [body]
        while at:
            k = at.pop()
            if marked[k] or density[k] < threshold:
                continue
            c = core(k)
            if not marked[c]:
                chosen.append(c)
                marked[c : self.last[c] + 1] = [True] * (self.last[c] + 1 - c)
            at += children[k]
        return chosen, threshold


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Characters per tag, times a logarithm that falls as links make up more of both; ratio is the body's share of
    linked characters. What would divide by zero counts as 1."""
    tags, links, anchors, plain = max(1, tags), max(1, link_chars), max(1, link_tags), max(1, chars - link_chars)
    base = math.log(chars / plain * links + ratio * chars + math.e)
    return chars / tags * max(0.0, math.log(chars / links * tags / anchors)) / math.log(base)


def main_text(page: str | None) -> str:
    return Page(page).main_text() if page else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html")).mapInArrow(work, "page_id long, url string, text string")
