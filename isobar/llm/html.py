"""Main text of web pages by tag-path ratios.

The text nodes of a page are grouped by their root-to-leaf path of tags (with class and id names). Per path, text length and
punctuation are summed; inline paths are summed with their block. The path prefix that holds most of the strong paths' text
is the page's container: ratios of paths inside it are smoothed with its own. The smoothed ratios, the share of text outside
links and a factor for the place (0 in page furniture, more inside article and main) are fused by multiplication, and
paths above a share of the container's own hold content.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from isobar.llm.common import extended, query, table

OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
# A tag's end outside quoted values; without backtracking. A quote that is never closed counts as a plain character.
TAG_END = re.compile(r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+>")
CLOSERS = {"<!--": "-->", "<![CDATA[": "]]>"}
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"[\s​]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")
# HTML vocabulary: fixed values.
RAW = {"script", "style", "noscript", "textarea", "template", "title", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "select", "head", "menu", "dialog"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span",
          "strong", "sub", "sup", "time", "u", "var", "wbr", "ins", "del", "img", "label", "big", "tt"}
TEXT_LEVEL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tr", "td",
              "th", "caption", "figure", "figcaption"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
# Words of furniture's class and id names. A name counts if each of its words stands in one of the two sets, and one in the first.
FURNITURE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu",
                   "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "sidebar", "comment", "comments", "replies", "disqus", "cookie",
                   "cookies", "consent", "gdpr", "notice", "newsletter", "subscribe", "share", "sharing", "social", "related", "popup", "modal", "login"}
NEUTRAL_WORDS = {"site", "page", "main", "top", "bottom", "left", "right", "bar", "box", "list", "block", "area", "section", "wrapper", "container",
                 "links", "link", "item", "items", "global", "primary", "secondary", "user", "reader", "form", "buttons", "widget", "slot", "unit"}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# How much more a path inside article or main weighs.
MARKED = 3.0


def furniture_name(name: str) -> bool:
    words = {w.lower() for w in WORD.findall(name)}
    return bool(words & FURNITURE_WORDS) and words <= FURNITURE_WORDS | NEUTRAL_WORDS


class Paths:
    """Distinct tag paths of a page as numbers with parent pointers; 0 is the root."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.tag, self.block = [0], [""], [0]
        self.link, self.marked = [False], [False]
        # The nearest furniture path at or above a path, or 0.
        self.furniture = [0]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        names, named = [], False
        for kind, a, b, c in NAMED.findall(attributes):
            value = a or b or c
            names.append(value)
            named = named or (value.strip().lower() in ROLES if kind.lower() == "role" else any(map(furniture_name, value.split())))
        step = f"{tag}.{' '.join(names)}" if names else tag
        at = self.number.get((parent, step))
        if at is None:
            at = self.number[parent, step] = len(self.parent)
            inside = self.marked[parent]
            bad = tag in FURNITURE and not (tag == "header" and inside) or named and tag not in ("html", "body", "main", "article")
            self.parent.append(parent)
            self.tag.append(tag)
            self.block.append(self.block[parent] if tag in INLINE else at)
            self.link.append(self.link[parent] or tag == "a")
            self.marked.append(inside or tag in ("article", "main"))
            self.furniture.append(self.furniture[parent] or (at if bad else 0))
        return at

    def open_forms(self) -> None:
        """A form around the page's heading or article is no furniture (some sites wrap whole pages in one)."""
        kept = {self.furniture[k] for k in range(1, len(self.tag)) if self.tag[k] in ("h1", "article", "main")}
        kept = {k for k in kept if k and self.tag[k] == "form"}
        if kept:
            for k in range(1, len(self.tag)):
                if self.furniture[k] in kept:
                    up = self.furniture[self.parent[k]]
                    bad = k not in kept and self.tag[k] in FURNITURE - {"form"}
                    self.furniture[k] = up or (k if bad else 0)


def text_nodes(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """Paths, and (path, raw text, block number) of every text in page order; time in proportion to the page."""
    paths, out = Paths(), []
    stack: list[int] = [0]
    blocks: list[int] = []  # places of block elements in the stack
    opened: Counter[str] = Counter()
    block = at = 0
    end, quotes = len(page), True

    def cut(k: int) -> None:
        for path in stack[k:]:
            opened[paths.tag[path]] -= 1
        del stack[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()

    while at < end:
        m = OPEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            out.append((stack[-1], page[at:stop], block))
        if not m:
            break
        at = m.end()
        if page[stop + 1] in "!?":
            close = CLOSERS.get(m[0], ">")
            found = page.find(close, at)
            at = found + len(close) if found >= 0 else end
            continue
        closing = page[stop + 1] == "/"
        name = NAME.match(page, stop + 1 + closing)
        rest = TAG_END.match(page, name.end()) if quotes else None
        after = rest.end() if rest else page.find(">", name.end()) + 1
        if not rest:
            quotes = False  # no later tag ends outside quotes either
            if not after:  # no tag ends any more: the rest is text
                out.append((stack[-1], page[stop:], block))
                break
        attributes, tag, at = page[name.end():after - 1], name[0].lower(), after
        if tag not in INLINE:
            block += 1
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while paths.tag[stack[k]] != tag:
                    k -= 1
                cut(k)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag not in INLINE:
            # A block ends an open paragraph, and with it the inline tags left open inside.
            if blocks and (paths.tag[stack[blocks[-1]]] == "p" or paths.tag[stack[blocks[-1]]] == tag == "li"):
                cut(blocks[-1])
        if not attributes.rstrip().endswith("/"):
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append(paths.child(stack[-1], tag, attributes))
            opened[tag] += 1
    return paths, out


def content_paths(paths: Paths, nodes: list[tuple[int, str, int]], share: float = 0.25) -> set[int]:
    """Block paths whose smoothed, fused ratio reaches `share` of that of the container's strong paths."""
    paths.open_forms()
    totals: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, text, _ in nodes:
        size = len(text.strip())
        if size and not paths.furniture[path]:
            total = totals[paths.block[path]]
            total[0] += 1
            total[1] += size
            total[2] += len(PUNCTUATION.findall(text))
            total[3] += size * paths.link[path]
    if not totals:
        return set()

    def fused(path, length, marks):
        return length * marks * (1 - totals[path][3] / totals[path][1]) * (MARKED if paths.marked[path] else 1.0)

    ratio = {p: (length / n, (marks + 0.5) / n) for p, (n, length, marks, _) in totals.items()}
    own = {p: fused(p, *r) for p, r in ratio.items()}
    size = sum(t[1] for t in totals.values())
    mean = sum(own[p] * t[1] for p, t in totals.items()) / size
    # Text of strong paths under every prefix, children before parents; then down while one child holds most of it.
    mass = [0.0] * len(paths.parent)
    for p, t in totals.items():
        if own[p] >= share * mean:
            mass[p] = t[1] * (MARKED if paths.marked[p] else 1.0)
    best = [0] * len(paths.parent)
    for p in range(len(mass) - 1, 0, -1):
        up = paths.parent[p]
        mass[up] += mass[p]
        if paths.tag[p] not in TEXT_LEVEL and paths.tag[p] not in INLINE and (not best[up] or mass[p] > mass[best[up]]):
            best[up] = p
    home = 0
    while best[home] and mass[best[home]] >= 0.6 * mass[0]:
        home = best[home]
    inside = [False] * len(mass)
    inside[home] = True
    for p in range(home + 1, len(mass)):
        inside[p] = inside[paths.parent[p]]
    strong = [p for p in totals if inside[p] and own[p] >= share * mean] or list(totals)
    weight = sum(totals[p][1] for p in strong)
    ground = [sum(ratio[p][k] * totals[p][1] for p in strong) / weight for k in (0, 1)]
    # A page's first heading may stand before its container.
    headed = any(inside[p] and paths.tag[p] == "h1" for p in totals)

    def smooth(p):
        if not inside[p] and (headed or paths.tag[p] != "h1"):
            return [2 * x / 3 for x in ratio[p]] if paths.marked[p] else [x / 3 for x in ratio[p]]
        part = 1 / 3 if paths.tag[p] in TEXT_LEVEL else 2 / 3
        return [part * x + (1 - part) * g for x, g in zip(ratio[p], ground)]

    limit = share * ground[0] * ground[1]
    return {p for p in totals if fused(p, *smooth(p)) >= limit * (MARKED if paths.marked[home] and paths.marked[p] else 1.0)}


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by a line end; empty for null, empty and contentless pages.

    Broken markup: what never closes ends with the page, an unfinished last tag is text, an open comment or script runs to the end.
    """
    paths, nodes = text_nodes(page or "")
    wanted = content_paths(paths, nodes)
    blocks: dict[int, list[str]] = defaultdict(list)
    for path, text, block in nodes:
        if not paths.furniture[path] and (paths.block[path] in wanted or not text.strip()):
            blocks[block].append(entities.unescape(text))
    lines = (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text`, the main text of the whole html column. An input column of that name is replaced; repeated rows stay."""
    rows = pages.drop("text")
    names, at = rows.columns, rows.columns.index(html)

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, extended(rows.schema, "text string"))


@query()
def op6_html_text(spark, sf):
    rows = extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return rows.selectExpr("page_id", "url", "text", "cast(length(text) as long) as n_chars")
