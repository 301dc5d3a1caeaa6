"""Main text of web pages by composite text density.

Each page becomes a small tree. For every node: characters, tags, characters and tags inside links below it; the
composite density is characters per tag, adjusted by the share of links against that of the whole body. The sum
of its children's densities tells how much of a node is running text. The node of the largest sum is the core of the
text; the smallest density on its path to the body is the threshold: going down from the body, every node whose
density reaches it and that is no part of the core belongs to the text too, with the headings before them.

Elements that are never part of an article (menus, footers, sidebars, forms, scripts, styles, hidden ones; told by
element, role, style or `hidden`) are left out before anything is counted. Class and id words never decide alone: they
multiply the density of a container by `NOISE_WEIGHT`, and a node inside the text goes only if its weighted density
stays below the threshold. They do not count for a container with most of the page's plain text (for one that names
readers' comments: with all of it), nor is a form of that size left out. `<article>` and `<main>` have no part in the
choice.

Defined results: null and empty pages, and pages without text, give ''. Broken markup is read as far as it goes
(open paragraphs and list items end where browsers end them; unmatched end tags are ignored). Of nodes with the
same density sum the first in page order counts. Repeated rows are extracted row by row. The work is linear in the
length of the page, however deeply its elements are nested.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head script style noscript template nav footer aside button select textarea input iframe object embed svg canvas audio video map menu dialog title noembed noframes".split())
#: An opening tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag ends an open one of these, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
P_SCOPE = frozenset("html body table td th caption button object template marquee".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Containers whose class or id words weigh; a paragraph or an inline element is never judged by its name.
NAMED = frozenset("div section ul ol dl table article header details blockquote fieldset figure center".split())
#: Words of class or id that stand alone, and words that make one together with a word of the second set.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent privacy gdpr newsletter subscribe subscription "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social popup modal overlay toolbar pagination pager login signup copyright".split()
)
#: Words of class or id for what readers wrote.
READER_WORDS = frozenset("comment comments commentlist disqus replies discussion discussions responses respond reviews".split())
#: Words that say of a paragraph that it is an advert.
AD_WORDS = frozenset("ad ads advert advertisement sponsored promo".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
NOISE_PAIRS = frozenset("related recommended popular latest more side site page skip top bottom search notice header read up".split())
PAIRED = frozenset("post posts article articles link links story stories bar menu nav navigation header footer box banner form widget widgets notice notices list next".split())
NOISE_WEIGHT = 0.02
#: A named container, or a form, that holds so much of the page's plain text is the page's text, whatever its name.
MOST_OF_PAGE = 0.8
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Tree:
    """Nodes in page order: parents stand before their children."""

    def __init__(self, page: str):
        self.tag, self.parent, self.dropped, self.weight = ["#root"], [-1], [False], [1.0]
        self.named: dict[int, bool] = {}  # containers of a noise word, and whether it is one for what readers wrote
        self.block = [0]  # of each node the nearest one, itself or above, that is a block
        self.text: list[tuple[int, str, int]] = []  # node, text, nodes opened so far
        self.stack, self.open_p, self.in_text, self.n_open = [0], [-1], [False], {}
        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            if m is None:
                self.add_text(page[at:])
                break
            if m.start() > at:
                self.add_text(page[at : m.start()])
            at, name = m.end(), m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self.close(name)
                continue
            self.open(name, m[3])
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                self.cut(len(self.stack) - 1)
            elif name in VOID or m[3].endswith("/") and name not in ENDS_P and name not in INLINE:
                self.cut(len(self.stack) - 1)
        self.judge_names()

    def add_text(self, raw: str) -> None:
        self.text.append((self.stack[-1], html.unescape(raw) if "&" in raw else raw, len(self.tag)))

    def cut(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        for node in self.stack[k:]:
            self.n_open[self.tag[node]] -= 1
        del self.stack[k:], self.open_p[k:], self.in_text[k:]

    def close(self, name: str) -> None:
        if not self.n_open.get(name):
            return
        if name == "p":
            if self.open_p[-1] >= 0:
                self.cut(self.open_p[-1])
            return
        k = len(self.stack) - 1
        while self.tag[self.stack[k]] != name:
            k -= 1
        self.cut(k)

    def open(self, name: str, attributes: str) -> None:
        if name in ENDS_P and self.open_p[-1] >= 0:
            self.cut(self.open_p[-1])
        if name in ENDS:
            ended, scope = ENDS[name]
            last, k = None, len(self.stack) - 1
            while k > 0 and self.tag[self.stack[k]] not in scope:
                if self.tag[self.stack[k]] in ended:
                    last = k
                k -= 1
            if last is not None:
                self.cut(last)
        parent, node = self.stack[-1], len(self.tag)
        hints = {a[0].lower(): (a[1] or a[2] or a[3]).lower() for a in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        self.tag.append(name)
        self.parent.append(parent)
        self.dropped.append(self.dropped[parent] or self.is_dropped(name, hints))
        self.weight.append(1.0)
        if name in NAMED and (kind := noise_kind(hints)) is not None:
            self.named[node] = kind
        self.block.append(self.block[parent] if name in INLINE else node)
        self.open_p.append(len(self.stack) if name == "p" else -1 if name in P_SCOPE else self.open_p[-1])
        self.in_text.append(self.in_text[-1] or name in ("article", "main"))
        self.stack.append(node)
        self.n_open[name] = self.n_open.get(name, 0) + 1

    def is_dropped(self, name: str, hints: dict[str, str]) -> bool:
        if name in DROPPED or "hidden" in hints or hints.get("aria-hidden") == "true" or hints.get("role") in ROLES or HIDING.search(hints.get("style", "")):
            return True
        if name == "p" and not AD_WORDS.isdisjoint(f"{hints.get('class', '')} {hints.get('id', '')}".split()):
            return True
        return name == "header" and not self.in_text[-1]  # a page's header; an article's own holds its title

    def judge_names(self) -> None:
        """Drops forms and weighs containers by their names, but none that holds most of the page's plain text.

        What readers wrote stays beside the text unless the page has no other.
        """
        n = len(self.tag)
        plain, in_link = [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for node, text, _ in self.text:
            if not self.dropped[node] and not in_link[node]:
                plain[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
        for i in range(1, n):
            p = self.parent[i]
            self.dropped[i] = self.dropped[i] or self.dropped[p] or self.tag[i] == "form" and plain[i] < MOST_OF_PAGE * plain[0]
            least = (plain[0] if self.named[i] else MOST_OF_PAGE * plain[0]) if i in self.named else 0
            self.weight[i] = self.weight[p] * (NOISE_WEIGHT if i in self.named and plain[i] < least else 1.0)

    def path(self, node: int) -> Iterator[int]:
        while node > 0:
            yield node
            node = self.parent[node]


def noise_kind(hints: dict[str, str]) -> bool | None:
    """Whether a class or id names what readers wrote; None if it names nothing beside the text: no noise word, alone, doubled, or before one of PAIRED."""
    found = None
    for word in f"{hints.get('class', '')} {hints.get('id', '')}".split():
        parts = [p for p in re.split(r"[-_]+", word) if p]
        if parts and (parts[0] in READER_WORDS or parts[-1] in READER_WORDS):
            return True
        if parts and (parts[0] in NOISE_WORDS or parts[-1] in NOISE_WORDS or len(parts) > 1 and parts[0] in NOISE_PAIRS and parts[-1] in PAIRED):
            found = False
    return found


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_links: int) -> float:
    """Composite text density of a node."""
    if not chars:
        return 0.0
    tags, link_tags = max(tags, 1), max(link_tags, 1)
    plain, linked = max(chars - link_chars, 1), max(link_chars, 1)
    base = math.log(chars / plain * link_chars + body_links / max(body_chars, 1) * chars + math.e)
    return chars / tags * max(math.log(chars / linked * tags / link_tags), 0.0) / base


def densities(tree: Tree) -> tuple[int, list[int], list[float], list[float]]:
    """The body, and of every node its characters, its weighted composite density, and the sum of its children's."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
    for node, text, _ in tree.text:
        if not tree.dropped[node]:
            own = len("".join(text.split()))
            chars[node] += own
            link_chars[node] += own * in_link[node]
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    own = list(chars)
    for i in range(n - 1, 0, -1):  # children stand after their parents
        if tree.dropped[i]:
            continue
        p = tree.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    dense = [0.0 if tree.dropped[i] else tree.weight[i] * density(chars[i], tags[i], link_chars[i], link_tags[i], chars[body], link_chars[body]) for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        if tree.tag[i] not in INLINE:
            total[tree.parent[i]] += dense[i]
    for i in range(n):  # text that stands in a node itself, between its blocks, is a child without a tag
        if own[i] and not tree.dropped[i] and tree.tag[i] not in INLINE and total[i]:
            total[i] += tree.weight[i] * density(own[i], 1, 0, 0, chars[body], link_chars[body])
        elif own[i] and not tree.dropped[i] and tree.tag[i] not in INLINE:
            total[i] = dense[i] / 2
    return body, chars, dense, total


def chosen(tree: Tree) -> list[bool]:
    """Of each node whether its text belongs to the main text."""
    n = len(tree.tag)
    body, chars, dense, total = densities(tree)
    core = max((i for i in range(body, n) if not tree.dropped[i]), key=lambda i: (total[i], -i), default=0)
    path = list(tree.path(core))
    if body in path:
        path = path[: path.index(body) + 1]
    threshold, above = min((dense[i] for i in path if dense[i] > 0), default=0.0), {body, *path}
    own_text, after = [False] * n, [0] * n  # after: the next child of the same parent, 0 without one
    for node, text, _ in tree.text:
        own_text[node] = own_text[node] or bool(text.strip())
    newest = [0] * n
    for i in range(n - 1, 0, -1):
        after[i], newest[tree.parent[i]] = newest[tree.parent[i]], i
    keep, headings = [False] * n, []
    for i in range(body, n):
        p = tree.parent[i]
        if tree.dropped[i]:
            continue
        if i == core:
            keep[i] = True
        elif i in above:  # its children are judged one by one; its own text, if any, with it
            keep[i] = own_text[i] and dense[i] >= threshold and tree.tag[i] not in ("body", "html")
        elif p in above and p != core:
            keep[i] = bool(chars[i]) and dense[i] >= threshold > 0
            if not keep[i] and chars[i] and tree.tag[i] in ("h1", "h2", "h3") and tree.weight[i] == 1.0:
                headings.append(i)
        elif p >= body and keep[p]:
            keep[i] = tree.weight[i] == tree.weight[p] or dense[i] >= threshold
    beside = set()
    for h in reversed(headings):  # a heading goes with what follows it
        if keep[after[h]] or after[h] in above or after[h] in beside:
            beside.add(h)
    for i in range(body, n):
        if i in beside or tree.parent[i] in beside and not tree.dropped[i]:
            keep[i] = True
            beside.add(i)
    return keep


def extract(page: str | None) -> str:
    """The main text of one page."""
    tree = Tree(page or "")
    keep = chosen(tree)
    out, last, seen = [], 0, 1
    for node, text, opened in tree.text:
        if keep[node]:
            if tree.block[last] != tree.block[node] or any(t not in INLINE for t in tree.tag[seen:opened]):
                out.append(" ")
            out.append(text)
            last, seen = node, opened
    return " ".join("".join(out).split())


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """key, url, text (the main text) and n_chars (its code points) of every page."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(text).alias("html"))
    schema = pages.select(F.col(key), F.col(url).alias("url")).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                found = [extract(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[key, "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
