"""Operator 4: main text of web pages by consensus paths of their hosts.

A page is read once into blocks (runs of text that block-level tags end), each with the containers it
stands in; a container's generalised path is its ancestors' tags and classes with digits made ``#``,
and is known by a hash that grows from the parent's. Containers are scored by the text of their
paragraphs and headings, whole for the one directly above and by half for the one above that, less the
text of links. Each page votes for its best container's path with its share of the page's score; Spark
sums the votes of each host and path, the path of most votes wins the host, and every page is
extracted again from the containers on its host's path. A page that has none, or whose containers
there are empty, takes its own best container, else all blocks outside what is left out.

Left out with all they hold: menus, headers (but one that begins an article), footers, sidebars,
scripts, styles, hidden elements and others that are not text. Left out, too, are forms, and elements
whose class, id or role says menu, advert, notice, share bar, sidebar or reader comments: a name says
so as a whole, by its last part (``site-footer``), or by its first where the others only describe a
box (``ad-wrapper``); not where a part denies it (``no-sidebar``, ``ad-free``). One of these that
holds the article or its title, or, where these stand nowhere, nearly all paragraphs (``MOST``;
comments: all text) is no such thing and stays. Character references are decoded, white space inside a block becomes one space, blocks
without text are no blocks, and blocks are joined by one line feed.

The reader takes a page in time and memory that grow as its length, whatever is unclosed, unmatched or
nested in it; it looks at whole pages. Null or empty html gives an empty text, as does a page without
any. Pages whose url is null or has no host vote together. Repeated rows vote and are extracted each;
of equal votes the path of the smaller hash wins. Other columns are ignored, whatever their names; an
empty table gives no rows. Votes are summed before they are shuffled. Hosts of many pages are dealt
apart (``split_join``), so that their pages are not shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, split_join, stage, table

#: Of all paragraph text, the share above which an element is the page's text whatever its name says.
MOST = 0.8
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTRIBUTES = re.compile(r"""([^\s=/"'<>]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
# Elements of HTML by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUT_TAGS = {"head", "nav", "footer", "aside", "button", "select", "option", "template", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "map", "datalist"}
CONTAINERS = {"html", "body", "div", "article", "section", "main", "center", "td", "th", "table", "tbody", "thead", "tfoot", "tr", "header", "hgroup", "fieldset", "figure", "details", "form"}
BLOCKS = CONTAINERS | OUT_TAGS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote", "address", "hr", "figcaption", "summary", "caption", "legend", "label"}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "pre", "blockquote", "figcaption", "caption", "td", "th"}
ENDS_P = BLOCKS - {"caption", "legend", "label", "summary", "option", "button", "select"}
#: Within these, an unclosed paragraph or item of those around them is not ended.
SCOPES = CONTAINERS | {"ul", "ol", "dl", "select"}
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
CELLS = {"td": 2, "th": 2, "tr": 1, "thead": 0, "tbody": 0, "tfoot": 0}
WHOLE_PAGE = {"html", "body", "article", "main"}
# Words of class, id and role by what they say.
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
OUT_WORDS = COMMENT_WORDS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toolbar", "pagination", "pager",
    "masthead", "footer", "sidebar", "aside", "complementary", "widget", "related", "recommended",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "disclaimer", "popup", "modal", "overlay", "newsletter", "subscribe",
    "share", "sharing", "social", "login", "signup", "search", "contentinfo",
}
DENIALS = {"no", "non", "not", "without", "with", "has", "free", "hide"}
BOX_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "column", "container", "content", "form", "group", "header", "holder", "icons", "inner", "item", "items",
    "left", "link", "links", "list", "main", "message", "module", "outer", "panel", "posts", "right", "row", "section", "site", "slot", "text", "title", "top", "unit", "wrap", "wrapper", "zone",
}
HEADER_WORDS = {"header", "site", "page", "top", "main", "global"}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
HOST = r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)"


def told(names: str, inside: bool = False) -> tuple[bool, bool]:
    """(whether names of class, id or role say that an element is no text, whether they say comments); ``inside``: of an article, whose header is text."""
    for name in names.split():
        parts = [p.lower() for p in PART.findall(name)]
        if not parts or not DENIALS.isdisjoint(parts):
            continue
        if parts[-1] in OUT_WORDS:
            return True, parts[-1] in COMMENT_WORDS
        if parts[0] in OUT_WORDS and BOX_WORDS.issuperset(parts[1:]):
            return True, parts[0] in COMMENT_WORDS
        if parts[-1] == "header" and not inside and HEADER_WORDS.issuperset(parts):
            return True, False
    return False, False


class Page:
    """The blocks of a page, its containers, and the elements that a name tells to be left out."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, int, bool, int]] = []  # container, text, characters in links, whether a paragraph, told element
        self.parents, self.steps, self.paths = [-1], [""], [0]  # of containers; a path is a hash
        self.outer, self.comments, self.holds = [-1], [False], [False]  # of told elements: the one around it, whether of comments, whether it has the article or title
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool, int]] = []  # tag, container, left out, paragraph, told element
        opened: dict[str, int] = defaultdict(int)
        scopes: list[dict[str, int]] = [{}]  # places in the stack of open paragraphs and items
        tables: list[list[int | None]] = [[None, None, None]]  # places of the open section, row and cell
        text: list[str] = []
        box, out, para, soft = 0, False, False, 0
        linked, began = 0, -1
        gone: set[str] = set()  # what does not occur any more from here on
        at, n, find = 0, len(source), source.find

        def flush() -> None:
            nonlocal linked
            if text:
                whole = " ".join("".join(text).split())
                if whole:
                    self.blocks.append((box, whole, min(linked, len(whole)), para, soft))
                text.clear()
            linked = 0

        def pop(to: int) -> None:
            nonlocal box, out, para, soft
            while len(stack) > to:
                tag = stack.pop()[0]
                opened[tag] -= 1
                if tag in SCOPES:
                    scopes.pop()
                if tag in CELLS:
                    tables[-1][CELLS[tag]] = None
                elif tag == "table":
                    tables.pop()
                elif scopes[-1].get(tag) == len(stack):
                    del scopes[-1][tag]
            _, box, out, para, soft = stack[-1] if stack else ("", 0, False, False, 0)

        def add(piece: str) -> None:
            nonlocal linked
            if piece and not out:
                piece = entities.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if opened["a"]:
                    linked += len(piece)

        def ahead(what: str, start: int) -> int:
            """As ``source.find``; what is not found once is not looked for again."""
            if what in gone:
                return -1
            k = find(what, start)
            if k < 0:
                gone.add(what)
            return k

        def tag_end(start: int) -> int:
            """The place of the ``>`` that ends a tag; those in quoted values do not."""
            k = start
            while m := STOP.search(source, k):
                k = m.start()
                if source[k] == ">":
                    return k
                if source[start:k].rstrip()[-1:] == "=" if k - start < 64 else source[k - 64 : k].rstrip()[-1:] == "=":
                    close = ahead(source[k], k + 1)
                    k = close if close >= 0 else k
                k += 1
            return -1

        while at < n:
            k = ahead("<", at)
            if k < 0:
                add(source[at:])
                break
            add(source[at:k])
            if source.startswith("<!--", k):
                at = ahead("-->", k + 4)
                if at < 0:
                    break
                at += 3
                continue
            closing = source.startswith("/", k + 1)
            m = NAME.match(source, k + 1 + closing)
            if not m and not source.startswith(("<!", "<?", "</"), k):
                add("<")
                at = k + 1
                continue
            end = ahead(">", m.end() if m else k)
            if m and end >= 0 and ('"' in (inner_text := source[m.end() : end]) or "'" in inner_text):
                closed = tag_end(m.end())  # where it finds none, quotes are characters like others
                end = closed if closed >= 0 else end
            if end < 0:  # no tag ends any more
                add(source[k:])
                break
            at = end + 1
            if not m:
                continue
            tag, rest = m[0].lower(), source[m.end() : end]
            if closing:
                if opened.get(tag):
                    j, block = len(stack) - 1, tag in BLOCKS
                    while stack[j][0] != tag:
                        block = block or stack[j][0] in BLOCKS
                        j -= 1
                    if block:
                        flush()
                    pop(j)
                elif tag in ("p", "br"):
                    flush()
                continue
            if tag in RAW:
                close = None if f"</{tag}" in gone else re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                if close is None:
                    gone.add(f"</{tag}")
                    if tag in ("script", "style", "xmp"):
                        break
                    continue  # unclosed: what follows is the page's
                end = ahead(">", close.end())
                at = end + 1 if end >= 0 else n
                continue
            if tag in BLOCKS:
                flush()
                place = None
                if tag in CELLS:
                    found = [x for x in tables[-1][CELLS[tag] :] if x is not None]
                    place = min(found, default=None)
                elif tag in ITEMS:
                    place = min((scopes[-1][t] for t in ITEMS[tag] if t in scopes[-1]), default=None)
                if place is None and tag in ENDS_P:
                    place = scopes[-1].get("p")
                if place is not None:
                    pop(place)
            if tag == "br" and not out:
                text.append(" ")
            if tag in VOID:
                continue
            names, skip, inner_soft = "", out or tag in OUT_TAGS or (tag == "header" and not (began == len(self.blocks) and opened["article"] + opened["main"])), soft
            if tag in ("article", "main", "h1") and not out:
                self._holding(soft)
            if not skip:
                say, about = tag == "form", False
                if rest:
                    given = {a.lower(): b or c or d for a, b, c, d in reversed(ATTRIBUTES.findall(rest))}
                    names = given.get("class", "").lower()
                    skip = "hidden" in given or "none" in given.get("style", "").lower().partition("display")[2].replace(" ", "")[:5]
                    if not say and tag not in WHOLE_PAGE:
                        say, about = told(f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}", opened["article"] + opened["main"] > 0)
                if say and tag not in BLOCKS:  # part of a run of text
                    skip = True
                if say and not skip:
                    self.outer.append(soft)
                    self.comments.append(about)
                    self.holds.append(False)
                    inner_soft = len(self.outer) - 1
            inner = box
            if tag in CONTAINERS and not skip:
                step = ".".join([tag, *sorted(DIGITS.sub("#", names).split())])
                inner = len(self.parents)
                self.parents.append(box)
                self.steps.append(step)
                self.paths.append(xxhash.xxh64_intdigest(f"{self.paths[box]}>{step}".encode("utf-8", "surrogatepass")) - (1 << 63))
            if rest.endswith("/") and tag not in BLOCKS:
                continue
            if tag == "p" or tag in ITEMS:
                scopes[-1][tag] = len(stack)
            elif tag in CELLS:
                tables[-1][CELLS[tag] :] = [None] * (3 - CELLS[tag])
                tables[-1][CELLS[tag]] = len(stack)
            elif tag == "table":
                tables.append([None, None, None])
            if tag in SCOPES:
                scopes.append({})
            if tag in BLOCKS:
                para = tag in PARAGRAPHS or (para and tag not in CONTAINERS)
            stack.append((tag, inner, skip, para, inner_soft))
            opened[tag] += 1
            box, out, soft = inner, skip, inner_soft
            if tag in ("article", "main"):
                began = len(self.blocks)
        flush()

    def _holding(self, soft: int) -> None:
        self.holds[0] = self.holds[0] or soft == 0
        while soft > 0 and not self.holds[soft]:
            self.holds[soft] = True
            soft = self.outer[soft]

    def _settle(self) -> None:
        """Drops the blocks of told elements that are what they say."""
        n = len(self.outer)
        if n == 1:
            return
        prose, whole = [0] * n, [0] * n
        for _, text, linked, paragraph, soft in self.blocks:
            prose[soft] += (len(text) - linked) * paragraph
            whole[soft] += len(text)
        for k in range(n - 1, 0, -1):
            prose[self.outer[k]] += prose[k]
            whole[self.outer[k]] += whole[k]
        out = [False] * n
        for k in range(1, n):
            all_of_it = whole[k] == whole[0] if self.comments[k] else prose[k] > MOST * prose[0] and not self.holds[0]
            out[k] = out[self.outer[k]] or not (all_of_it or (self.holds[k] and not self.comments[k]))
        self.blocks = [b for b in self.blocks if not out[b[4]]]

    def path(self, box: int) -> str:
        """A container's path in words."""
        steps = []
        while box > 0:
            steps.append(self.steps[box])
            box = self.parents[box]
        return ">".join(reversed(steps))

    def best(self) -> tuple[int, float]:
        """The best container and its share of all scores; container 0 if none has any."""
        score: dict[int, float] = defaultdict(float)
        for box, text, linked, paragraph, _ in self.blocks:
            worth = (len(text) - 2 * linked) * (1 if paragraph else 0.5)
            score[box] += worth
            if self.parents[box] >= 0:
                score[self.parents[box]] += worth / 2
        score.pop(0, None)
        good = {k: s for k, s in score.items() if s > 0}
        if not good:
            return 0, 0.0
        top = max(good, key=lambda k: (good[k], -k))
        return top, good[top] / sum(good.values())

    def text(self, path: int | None) -> str:
        """The text of the containers on a path; if there is none, of those on the page's own best."""
        top = self.best()[0]
        for one in (path, self.paths[top] if top else None):
            if one is None:
                continue
            inside = [False] * len(self.paths)
            for k in range(1, len(inside)):
                inside[k] = self.paths[k] == one or inside[self.parents[k]]
            found = [b[1] for b in self.blocks if inside[b[0]]]
            if found:
                return "\n".join(found)
        return "\n".join(b[1] for b in self.blocks)


def host_of(url: Column) -> Column:
    """A url's host in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, n) of each host: the hash of its winning path, null if no page has voted, and how many pages it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple[str, int | None], list[int]] = defaultdict(lambda: [0, 0])
        for batch in slices(batches, 256):
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                top, share = page.best()
                one = votes[host, page.paths[top] if top else None]
                one[0] += round(share * 1000)
                one[1] += 1
            if len(votes) > 100_000:
                yield _votes(votes)
                votes.clear()
        yield _votes(votes)

    def _votes(votes):
        kinds, rows = (pa.string(), pa.int64(), pa.int64(), pa.int64()), [(*k, *v) for k, v in votes.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names=["host", "path", "votes", "n"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = rows.mapInArrow(run, "host string, path long, votes long, n long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("n").alias("n"))
    best = F.max_by("path", F.when(F.col("path").isNotNull(), F.struct("votes", F.bitwise_not("path"))))
    return votes.groupBy("host").agg(best.alias("path"), F.sum("n").alias("n"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    winners = stage(host_paths(pages), "host_paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = split_join(rows.withColumn("host", host_of(F.col("url"))), winners, ["host"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            text = [Page(source or "").text(path) for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            cols = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
