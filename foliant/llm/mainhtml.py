"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text.  For each root-to-leaf tag path (tags with their classes)
the text length and the punctuation of its blocks are summed up and divided by the number of its
nodes, text of links for a fifth.  The logarithms of the two ratios are smoothed over neighbouring
paths in page order and fused by a product into one score.  What a path's tags and labels say is part of the
fusion: it adds to the score inside an article, and takes from it inside menus, adverts, comments
and so on, more for what is around a block than for the block's own label.  Paths whose score is
positive and above a share of the best are content; their blocks are the main text, wherever they
are, with the headings right before them.

Cases: null or empty html gives the empty text; broken markup, missing end tags and truncated
character references are read as browsers read them, in the main; hidden and textless elements are
no blocks; a page with menus only gives the empty text; equal pages give equal texts; an empty table
gives no rows; other columns are not looked at.  Pages of any length and depth are read in whole, in
time that follows their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import column_values, map_arrow

SHARE = 0.35
LINK_WEIGHT = 0.2
NEIGHBOUR = 1 / 8
IN_ARTICLE, LABELLED, AROUND = 15.0, -10.0, -60.0
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
WORD = re.compile(r"[a-z]+")

#: Element names by their part in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SILENT = set("script style template noscript iframe".split())  # hidden, but no end of a block
NEVER = set("head button select option svg canvas audio video object dialog map".split()) | RAW
BOILERPLATE = set("nav footer aside form menu".split())
CONTENT = {"article", "main"}
LEAVES = set("p figure figcaption blockquote pre li td th dd dt h1 h2 h3 h4 h5 h6".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
#: Words in a class, id or role that mark what is no content.
NOISE = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer foot masthead topbar cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe subscription signup comment comments reply replies respond disqus discussion share sharing social related recommended recommendations widget toolbar pagination pager login search skip contentinfo complementary".split())


class Page:
    """The blocks of a page: their tag path, text, number of characters in links, and whether they are headings."""

    def __init__(self, source: str) -> None:
        # By element: name, path number, the element of its block, whether it is in an article, in a link, in a heading.
        self.name, self.path, self.block, self.inside, self.linked, self.titled = ["#"], [0], [0], [False], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.prior = [0.0]  # by path: what its tags and labels add
        self.around = [0.0]  # the same for what lies below it
        self.blocks: list[tuple[int, str, int, bool]] = []
        self.open, self.hidden = [0], 0  # hidden: the depth at which content stopped, 0 if it goes on
        self.count: Counter[str] = Counter()
        self.text: list[str] = []
        self.links = 0
        at, end = 0, len(source)
        for token in iter(lambda: TOKEN.search(source, at), None):
            if token.start() > at:
                self.characters(source[at : token.start()])
            at = token.end()
            if token[0].startswith("<![CDATA["):
                self.characters(token[0][9:].removesuffix("]]>"), escaped=False)
            if not token[2]:
                continue
            name = token[2].lower()
            if token[1]:
                self.close(name)
                continue
            self.start(name, token[3])
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                self.close(name)
        if at < end:
            self.characters(source[at:])
        self.flush()

    def characters(self, text: str, escaped: bool = True) -> None:
        if not self.hidden:
            text = html.unescape(text) if escaped and "&" in text else text
            self.text.append(text)
            if self.linked[self.open[-1]]:
                self.links += len(text.strip())

    def flush(self) -> None:
        """End the block: its white space becomes single spaces."""
        if self.text:
            block = " ".join("".join(self.text).split())
            self.text.clear()
            if block:
                element = self.block[self.open[-1]]
                self.blocks.append((self.path[element], block, min(self.links, len(block)), self.titled[element]))
        self.links = 0

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self.count[name]:
            return
        if name == "br":
            self.characters(" ")
            return
        if name not in INLINE and name not in SILENT:
            self.flush()
            if name not in VOID:
                self.close_implied("p", {"button", "table", "td", "th", "caption"})
        if name in ENDS:
            for ended in ENDS[name][0].split():
                self.close_implied(ended, ENDS[name][1])
        if name in VOID:
            return
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        if name == "body":
            self.close("head")
        element, parent = len(self.name), self.open[-1]
        self.name.append(name)
        self.path.append(self.path_below(parent, name, found))
        self.block.append(self.block[parent] if name in INLINE else element)
        self.inside.append(self.inside[parent] or name in CONTENT)
        self.linked.append(self.linked[parent] or name == "a")
        self.titled.append(self.titled[parent] or name in HEADINGS)
        self.open.append(element)
        self.count[name] += 1
        gone = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
        if not self.hidden and (name in NEVER or gone):
            if name not in SILENT:
                self.flush()
            self.hidden = len(self.open)

    def path_below(self, parent: int, name: str, found: dict) -> int:
        """The number of the path one tag further down; a new one gets its prior."""
        labels = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
        above = self.path[parent]
        key = (above, f"{name} {labels}" if labels else name)
        if key not in self.paths:
            self.paths[key] = len(self.prior)
            own = around = self.around[above]
            if name in CONTENT and not self.inside[parent]:
                own = around = own + IN_ARTICLE
            elif name in BOILERPLATE or (name == "header" and not self.inside[parent]):
                own = around = own + AROUND
            elif labels and name not in ("html", "body", *CONTENT) and not NOISE.isdisjoint(WORD.findall(labels)):
                # A container's label says more than that of a paragraph, which may be an article's own.
                own, around = own + (LABELLED if name in LEAVES else AROUND), around + AROUND
            self.prior.append(own), self.around.append(around)
        return self.paths[key]

    def close_implied(self, name: str, scope: set[str]) -> None:
        if not self.count[name]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.name[self.open[k]] == name:
                self.cut(k)
                return
            if self.name[self.open[k]] in scope:
                return

    def close(self, name: str) -> None:
        if name not in INLINE and name not in SILENT:
            self.flush()
        if not self.count[name]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.name[self.open[k]] == name:
                self.cut(k)
                return

    def cut(self, depth: int) -> None:
        """Close all open elements from a depth on."""
        closed = [self.name[e] for e in self.open[depth:]]
        if any(n not in INLINE and n not in SILENT for n in closed):
            self.flush()
        self.count.subtract(closed)
        del self.open[depth:]
        if self.hidden > len(self.open):
            self.hidden = 0


def path_scores(page: Page) -> dict[int, float]:
    """The fused score of each path, in page order: smoothed ratios of length and punctuation, and what the tags say."""
    sums: dict[int, list[float]] = {}
    for path, text, links, _ in page.blocks:
        own = sums.setdefault(path, [0, 0.0, 0.0])
        plain = 1 - (1 - LINK_WEIGHT) * links / len(text)
        own[0] += 1
        own[1] += plain * len(text)
        own[2] += plain * len(PUNCTUATION.findall(text))
    paths = list(sums)
    ratios = [[log1p(sums[p][k] / sums[p][0]) for p in paths] for k in (1, 2)]
    smooth = [[(1 - 2 * NEIGHBOUR) * r[i] + NEIGHBOUR * (r[max(0, i - 1)] + r[min(len(r) - 1, i + 1)]) for i in range(len(r))] for r in ratios]
    return {p: length * (1 + marks) + page.prior[p] for p, length, marks in zip(paths, *smooth)}


def content_paths(page: Page, share: float = SHARE) -> set[int]:
    """The paths whose score is positive and above a share of the best."""
    scores = path_scores(page)
    bound = share * max(scores.values(), default=0.0)
    return {p for p, score in scores.items() if score > 0 and score >= bound}


def main_text(source: str, share: float = SHARE) -> str:
    """The main text of a page, one line for each block: those on content paths, and the headings right before them."""
    page = Page(source)
    chosen = content_paths(page, share)
    kept, content = [], False
    for path, text, _, heading in reversed(page.blocks):
        content = path in chosen or (heading and content and page.prior[path] > LABELLED)
        if content:
            kept.append(text)
    return "\n".join(reversed(kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """The id, url, main text and its number of code points of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, share) for h in column_values(batch, "_html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    return map_arrow(rows, f"{id_col} long, {url_col} string, text string, n_chars long", run)
