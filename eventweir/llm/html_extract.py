"""Main text of pages by consensus of their host.

1. Each page is parsed into blocks of text. The path of an element is generalised: tags and classes, digits replaced, so that pages
   made from one template agree. The characters of running text below each path (links count little) are its score; from the root on,
   the page steps down to the path that keeps nine tenths of it, as long as no heading or paragraph is left outside, and votes for the
   innermost container so reached.
2. Votes are summed by host and path in Spark; the path with the most votes wins its host (ties: longer, then last by name).
3. Each page is extracted again from the elements on its host's path. A page that has none, or whose host has no winner, falls back
   to its own best container.

Elements that are boilerplate by tag, role or being hidden are left out. Classes and ids are weaker evidence, and so is being a form:

- A word such as "share" is ambiguous. Inside an article or main element, an element with one stays if it holds most of the running text
  there (headings are not running text); elsewhere, if no such text is beyond doubt and it holds most of the page's. Elements
  on one path, such as the pieces of a page builder, are also weighed together. An element on the host's path stays.
- A word such as "comments" names what is never the article, however long it is. Such an element stays only if it wraps an article,
  a main element or a first heading, or if next to nothing stands outside it.

A page is read in one pass; its cost is linear in its length whatever it holds, and so is memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.llm.common import chunks, sized, with_columns, written

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside button select option dialog menu head svg canvas audio video object script style textarea title noscript template iframe noembed noframes xmp math input datalist".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "foot header hidden masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion "
    "related recommended share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Of these, names of what is never the article; the others are ambiguous.
NEVER_WORDS = frozenset("comment comments disqus cookie cookies consent newsletter".split())
#: Elements that may hold a page's controls or the whole page.
WRAPPERS = frozenset("form fieldset".split())
#: Closing rules: opening one of these ends an open paragraph; and which siblings end each other.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article body div main section td".split())
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())

HEADINGS_AND_PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that siblings do not end each other across.
SCOPES = frozenset("ul ol dl table tbody thead select article body div main section".split())

#: Share of a page's running text that a step down keeps and elements of doubtful name on one path must hold to stay, and the share that
#: one of them must hold.
KEPT, TRUSTED = 0.9, 0.75
#: Running text, in characters, that stands for an article of its own.
ARTICLE = 250
AMBIGUOUS, NEVER = 1, 2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_BEGIN = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


def described(tag: str, raw: str) -> tuple[str, bool, int]:
    """The generalised name of an element, whether it is boilerplate for certain, and how its name makes it doubtful (0: not)."""
    return _described(tag, raw) if len(raw) < 256 else _described.__wrapped__(tag, raw)


@lru_cache(maxsize=20_000)
def _described(tag: str, raw: str) -> tuple[str, bool, int]:
    skip = tag in BOILERPLATE_TAGS
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(values[0] or values[1] or values[2]))
    classes = found.get("class", "").split()
    skip |= found.get("role", "").lower() in BOILERPLATE_ROLES or found.get("aria-hidden", "").lower() == "true" or "hidden" in found
    skip |= bool(_HIDDEN.search(found.get("style", "")))
    names = [*classes, found.get("id", "")]
    words = {w for n in names for w in _WORD.findall(_CASE.sub(" ", n).lower())}
    doubtful = NEVER if words & NEVER_WORDS else AMBIGUOUS if words & BOILERPLATE_WORDS or tag in WRAPPERS else 0
    if tag in ("html", "body", "main", "article"):
        doubtful = 0
    return ".".join([tag, *sorted({_DIGITS.sub("#", c).replace("/", "_") for c in classes})]), skip, doubtful


@dataclass(slots=True)
class Open:
    """An element that is open: the number of its path, and what its text inherits."""

    tag: str
    path: int
    skip: bool = False
    link: bool = False
    doubt: int = 0
    inline: bool = False


class Page:
    """The blocks of a page, and its paths and doubtful elements as trees: parents by number, a parent before its children."""

    def __init__(self, html: str):
        self.names, self.parent = [""], [-1]  # of paths
        self.child: dict[tuple[int, str], int] = {}
        self.doubt_parent, self.doubt_path, self.doubt_kind = [-1], [0], [0]  # of doubtful elements; 0 is none
        self.blocks: list[tuple[int, int, int, bool, str]] = []  # path, doubtful element, weight, heading or paragraph, text
        self.tags: list[str] = []  # of the blocks
        self._parts: list[str] = []
        self._linked = 0
        self._at = (0, 0, "")
        self._open = [Open("", 0)]
        self._counts: dict[str, int] = {}  # of open elements
        self._block_at = [0]  # places of the open elements that are not inline
        self._inline: list[dict[str, int]] = [{}]  # by such element: the inline ones opened in it
        self._siblings: list[dict[str, int]] = [{}]  # by scope: open list items, rows, cells
        self._read(html)
        self._flush()

    def _flush(self) -> None:
        if self._parts:
            if text := " ".join(unescape("".join(self._parts)).split()):
                path, doubt, tag = self._at
                linked = min(self._linked, len(text))
                self.blocks.append((path, doubt, len(text) - linked + linked // 8, tag in HEADINGS_AND_PARAGRAPHS and linked < len(text), text))
                self.tags.append(tag)
            self._parts.clear()
            self._linked = 0

    def _add(self, text: str) -> None:
        top = self._open[-1]
        if text and not top.skip:
            if not self._parts:
                block = self._open[self._block_at[-1]]
                self._at = (block.path, top.doubt, block.tag)
            self._parts.append(text)
            if top.link:
                self._linked += len(text.strip())

    def _push(self, element: Open) -> None:
        tag = element.tag
        self._open.append(element)
        self._counts[tag] = self._counts.get(tag, 0) + 1
        if element.inline:
            self._inline[-1][tag] = self._inline[-1].get(tag, 0) + 1
        else:
            self._block_at.append(len(self._open) - 1)
            self._inline.append({})
        if tag in SCOPES:
            self._siblings.append({})
        elif tag in SIBLINGS:
            self._siblings[-1][tag] = self._siblings[-1].get(tag, 0) + 1

    def _close(self, which) -> None:
        """Closes open elements up to the innermost one whose tag is in which; there is one."""
        while True:
            e = self._open.pop()
            tag = e.tag
            self._counts[tag] -= 1
            if e.inline:
                self._inline[-1][tag] -= 1
                if e.doubt != self._open[-1].doubt:
                    self._flush()
            else:
                self._flush()
                self._block_at.pop()
                self._inline.pop()
            if tag in SCOPES:
                self._siblings.pop()
            elif tag in SIBLINGS:
                self._siblings[-1][tag] -= 1
            if tag in which:
                return

    def _tag(self, tag: str, raw: str) -> None:
        if tag == "br":
            if self._parts:
                self._parts.append(" ")
            return
        if tag == "hr":
            self._flush()
        if tag in VOID:
            return
        if tag in ENDS_P and self._open[self._block_at[-1]].tag == "p":
            self._close(("p",))
        if (ended := SIBLINGS.get(tag)) and any(self._siblings[-1].get(x) for x in ended):
            self._close(ended)
        inline, up = tag in INLINE, self._open[-1]
        name, skip, doubtful = described(tag, raw)
        doubt = up.doubt
        if not inline or (skip or doubtful) and not up.skip:
            self._flush()
        path = up.path
        if not inline:
            path = self.child.setdefault((up.path, name), len(self.names))
            if path == len(self.names):
                self.names.append(name)
                self.parent.append(up.path)
        if doubtful and not skip and not up.skip:
            doubt = len(self.doubt_parent)
            self.doubt_parent.append(up.doubt)
            self.doubt_path.append(path)
            self.doubt_kind.append(doubtful)
        if not (raw.endswith("/") and tag in ("svg", "math")):
            self._push(Open(tag, path, skip or up.skip, up.link or tag == "a", doubt, inline))

    def _end_tag(self, tag: str) -> None:
        # a formatting end tag does not close blocks
        if (self._inline[-1] if tag in FORMATTING else self._counts).get(tag):
            self._close((tag,))

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        quotes = {'"', "'"}  # those that may still be closed
        while at < end:
            tag_begin = _BEGIN.search(html, at)
            if tag_begin is None:
                self._add(html[at:])
                return
            begin = tag_begin.start()
            after = html[begin + 1]
            if after in ("!", "?"):
                self._add(html[at:begin])
                comment = html.startswith("<!--", begin)
                stop = html.find("-->" if comment else ">", begin + (2 if html.startswith("<!-->", begin) else 4 if comment else 2))
                at = stop + (3 if comment else 1) if stop >= 0 else end
                continue
            closing = after == "/"
            name = _NAME.match(html, begin + 1 + closing)
            stop = name.end()
            while (m := _STOP.search(html, stop)) and m[0] != ">":
                stop = m.end()
                if m[0] in quotes and html[max(name.end(), m.start() - 64) : m.start()].rstrip().endswith("="):
                    if (stop := html.find(m[0], m.end()) + 1) == 0:
                        quotes.discard(m[0])  # an open quote is none, here and further on
                        stop = m.end()
            if m is None:
                # a tag that does not end: quotes are no more minded, and without any > the rest is text
                stop = html.find(">", name.end())
                quotes.clear()
                if stop < 0:
                    self._add(html[at:])
                    return
            else:
                stop = m.start()
            self._add(html[at:begin])
            tag, raw, at = name[0].lower(), html[name.end() : stop], stop + 1
            if closing:
                self._end_tag(tag)
            elif tag in RAW:
                ended = _raw_end(tag).search(html, at)
                at = ended.end() if ended else end
            else:
                self._tag(tag, raw)

    def path_string(self, path: int) -> str:
        names = []
        while path > 0:
            names.append(self.names[path])
            path = self.parent[path]
        return "".join(f"/{x}" for x in reversed(names))

    def path_number(self, path: str) -> int | None:
        number: int | None = 0
        for name in path.split("/")[1:]:
            number = self.child.get((number, name))
            if number is None:
                return None
        return number

    def trusted(self, host_path: int | None = None) -> list[bool]:
        """By doubtful element: whether its text stays."""
        above = set()
        while host_path is not None and host_path > 0:
            above.add(host_path)
            host_path = self.parent[host_path]
        semantic = [False] * len(self.names)
        for k in range(1, len(semantic)):
            semantic[k] = semantic[self.parent[k]] or self.names[k].partition(".")[0] in ("article", "main")
        n, up = len(self.doubt_parent), [max(k, 0) for k in self.doubt_parent]

        def summed(per_block) -> list[int]:
            total = [0] * n
            for (_, doubt, *_), x in zip(self.blocks, per_block, strict=True):
                total[doubt] += x
            for k in range(n - 1, 0, -1):
                total[up[k]] += total[k]
            return total

        out = [True] * n
        if NEVER in self.doubt_kind:
            weight = summed(b[2] for b in self.blocks)
            marked = summed(int(b[3]) for b in self.blocks)
            main = summed(int(semantic[b[0]] or tag == "h1") for b, tag in zip(self.blocks, self.tags, strict=True))
            never = [False] * n  # is, or lies in, such an element
            for k in range(1, n):
                never[k] = never[up[k]] or self.doubt_kind[k] == NEVER
            tops = [k for k in range(1, n) if never[k] and not never[up[k]]]
            outside, marks = weight[0] - sum(weight[k] for k in tops), marked[0] - sum(marked[k] for k in tops)
            alone = outside < min(ARTICLE, (1 - KEPT) * weight[0]) and not marks
            for k in range(1, n):
                if self.doubt_kind[k] == NEVER:
                    out[k] = out[up[k]] and not semantic[self.parent[self.doubt_path[k]]] and bool(main[k] and main[k] == main[0] or alone and not never[up[k]] or self.doubt_path[k] in above)
                else:
                    out[k] = out[up[k]]
        kept = [b[2] if out[b[1]] else 0 for b in self.blocks]
        weight = summed(kept)
        running = [x if semantic[b[0]] and tag not in HEADINGS else 0 for b, x, tag in zip(self.blocks, kept, self.tags, strict=True)]
        region = summed(running)  # running text of main elements
        clear = [0] * n  # that part of it which hangs on no other doubt
        for b, x in zip(self.blocks, running, strict=True):
            clear[b[1]] += x
        by_path: dict[int, list[int]] = {}
        for k in range(1, n):
            both = by_path.setdefault(self.doubt_path[k], [0, 0])
            both[0] += weight[k]
            both[1] += region[k]
        for k in range(1, n):
            path = self.doubt_path[k]
            if out[k] and self.doubt_kind[k] == AMBIGUOUS and path not in above:
                inside = semantic[path]
                own, whole = (region[k], region[up[k]]) if inside else (weight[k], weight[0])
                out[k] = (inside or not clear[up[k]]) and (own >= TRUSTED * whole or by_path[path][inside] >= KEPT * whole)
            out[k] = out[k] and out[up[k]]
            clear[k] += clear[up[k]]
        return out

    def best(self) -> int | None:
        """The path of the page's best container; None if it has none."""
        trusted = self.trusted()
        weight, marked = [0] * len(self.names), [0] * len(self.names)
        for path, doubt, n, strong, _ in self.blocks:
            if trusted[doubt]:
                weight[path] += n
                marked[path] += strong
        heaviest = [0] * len(self.names)
        for k in range(len(weight) - 1, 0, -1):
            up = self.parent[k]
            weight[up] += weight[k]
            marked[up] += marked[k]
            if not heaviest[up] or (weight[k], self.names[k]) > (weight[heaviest[up]], self.names[heaviest[up]]):
                heaviest[up] = k
        at, chosen = 0, None
        while weight[0] and (below := heaviest[at]) and weight[below] >= KEPT * weight[0]:
            tag = self.names[below].partition(".")[0]
            if marked[below] < marked[at] and tag not in ("article", "main"):
                break
            at = below
            if tag in CONTAINERS:
                chosen = at
        return chosen

    def text(self, path: int | None, host_path: int | None = None) -> str:
        """The blocks that stay below the path (None: everywhere), joined by spaces."""
        trusted = self.trusted(host_path)
        inside = [path is None] * len(self.names)
        if path is not None:
            inside[path] = True
            for k in range(path + 1, len(inside)):
                inside[k] = inside[self.parent[k]]
        return " ".join(text for p, doubt, _, _, text in self.blocks if inside[p] and trusted[doubt])


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def best_path(html: str | None) -> str | None:
    """The path that a page votes for."""
    page = Page(html or "")
    path = page.best()
    return None if path is None else page.path_string(path)


def main_text(html: str | None, host_path: str | None) -> str:
    """A page's text by its host's path, or by its own best container if nothing lies below that."""
    page = Page(html or "")
    number = page.path_number(host_path) if host_path else None
    found = page.text(number, number) if number is not None else ""
    return found or page.text(page.best())


def host_of(url):
    """Host part of a URL column, lower-cased; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def votes(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Rows (host, path): one winner per host."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            cast: dict[tuple[str, str], int] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if html and (path := best_path(html)) is not None:
                    cast[host, path] = cast.get((host, path), 0) + 1
            yield pa.RecordBatch.from_pydict({"host": [h for h, _ in cast], "path": [p for _, p in cast], "n": list(cast.values())}, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("n", pa.int64())]))

    cast = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(work, "host string, path string, n long")
    summed = cast.groupBy("host", "path").agg(F.sum("n").alias("n"))
    winner = F.max_by("path", F.struct("n", F.length("path"), "path")).alias("path")
    return summed.groupBy("host").agg(winner)


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """All rows of pages with their columns and text: the article's text, empty if there is none (null or empty html included).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one space in page order.
    Pages without a host vote among themselves. A clashing column text of pages is replaced.
    """
    winners = written(votes(pages, html_col, url_col), "host-paths")
    kept = [c for c in pages.columns if c != "text"]

    def extracted(paths: list[str | None], htmls: list[str | None]) -> tuple[list[str]]:
        return ([main_text(html, path) for path, html in zip(paths, htmls, strict=True)],)

    rows = pages.select(*kept, host_of(F.col(url_col)).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    rows = rows.join(sized(winners.select(F.col("host").alias("_host"), F.col("path").alias("_path"))), "_host", "left")
    return with_columns(rows, ["_path", "_html"], "text string", extracted).select(*kept, "text")
