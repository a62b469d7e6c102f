"""Main text of web pages with a site style tree.

Pages of a host are merged into one tree of styled nodes (tag and class along the path). For every node the entropy
of its presentation (the styles of its children) and of its content over the host's pages says how important it is:
what looks and reads the same on every page is low, inside articles as well. A page's text is what
stands in it after branches of low importance, and those whose role says so (menus, footers, forms and the like), are
removed; article and main elements are a hint, which counts where one of them holds the larger part of what is left.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import tidy, written

#: Importance below which a branch goes, pages of full importance that every node starts with (so that one seen on few
#: pages stays), weight of content against presentation.
LOW, UNSEEN, CONTENT = 0.15, 1.4, 0.9
#: The same for a branch with a doubtful class: one of the names below is a part of it.
DOUBTFUL, UNSEEN_DOUBTFUL = 0.5, 8.0
#: Rows of low nodes up to which they are broadcast; more are joined by host.
BROADCAST_ROWS = 50_000

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(>|\Z))""", re.S)
#: The same where quotes don't pair up to the end of the page: a tag ends at the next >.
_UNQUOTED = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(>))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))""")
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript", "template", "svg", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Roles that are no article.
_DROPPED = set("nav aside footer button select datalist menu dialog object canvas audio video map head".split())
#: Roles, names and these elements too, unless what they hold says otherwise.
_SOFT = {"form", "fieldset"}
_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
_NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs topbar masthead header footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus discussion related recommended widget search toolbar pagination pager copyright legal skip".split()
)
#: Names of what readers wrote.
_COMMENTS = set("comment comments reply replies respond disqus".split())
#: What may stand before or after a name in a compound one, which then says the same: site-footer, comment-list, commentlist.
_BEFORE = set("site page main global user users reader top bottom left right primary secondary mobile sticky fixed".split())
_AFTER = set(
    "list section area box block bar wrapper wrap container inner outer holder slot unit button buttons link links icon icons item items group panel thread form row column left right top bottom posts articles stories content template body".split()
)
#: Before the name of comments also what they are about.
_ABOUT = _BEFORE | set("post entry article blog story news all new latest recent".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_ROOTS = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLANK = re.compile(r"\s+")


#: Modulus and base of the rolling hash that names what a run of blocks says.
_MOD, _BASE = (1 << 61) - 1, 0x1F3D5B79A3C5E7


class _Open:
    """An element that is open: its path's hash, the element it counts as (block elements), the article it is in, the
    innermost element that goes for its role or name, and whether a link is open."""

    __slots__ = ("tag", "path", "element", "dropped", "root", "soft", "link")

    def __init__(self, tag: str, path: int, element: int, dropped: bool, root: int, soft: int, link: bool):
        self.tag, self.path, self.element, self.dropped, self.root, self.soft, self.link = tag, path, element, dropped, root, soft, link


class _Element:
    """A block element: its path's hash, the block element around it, and its blocks of text, from first to end."""

    __slots__ = ("path", "around", "first", "end")

    def __init__(self, path: int, around: int, first: int):
        self.path, self.around, self.first, self.end = path, around, first, first


class _Block:
    __slots__ = ("element", "text", "root", "soft", "prose")

    def __init__(self, element: int, text: str, root: int, soft: int, prose: int):
        self.element, self.text, self.root, self.soft, self.prose = element, text, root, soft, prose


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] for m in _ATTRIBUTE.finditer(text)} if "=" in text else {}


@lru_cache(maxsize=10_000)
def _says(name: str) -> str:
    """The name among _NAMES that a class or id is: as it stands, or compound of names and of words that only place it; else ''."""
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if len(parts) == 1:
        if name in _NAMES:
            return name
        for i in range(2, len(name) - 1):  # written as one word
            if name[:i] in _NAMES and name[i:] in _AFTER or name[i:] in _NAMES and name[:i] in _BEFORE and len(name) - i > 3:
                return name[:i] if name[:i] in _NAMES else name[i:]
        return ""
    named = [x for x in parts if x in _NAMES]
    about = any(x in _COMMENTS for x in named)
    fits = all(x in _NAMES or (i < len(parts) - 1 and x in (_ABOUT if about else _BEFORE)) or (i and x in _AFTER) for i, x in enumerate(parts))
    return next((x for x in named if x in _COMMENTS), named[-1]) if named and fits else ""


def _no_article(tag: str, own: dict[str, str], raw: str, inside: bool) -> int:
    """2 if an element's tag says that it is no part of an article, or it is hidden; 3 if a name says that readers wrote it; 1 if its role or another name does."""
    if tag in _DROPPED or (tag == "header" and not inside):
        return 2
    if tag in ("html", "body", "main"):
        return 0
    if not raw:
        return int(tag in _SOFT)
    if own.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"""=\s*("[^"]*"|'[^']*')""", "", raw)):
        return 2
    if "display:none" in own.get("style", "").replace(" ", ""):
        return 2
    names = set(own.get("class", "").lower().split())
    if tag not in _HEADINGS:
        names.add(own.get("id", "").lower())
    said = {_says(x) for x in names} - {""}
    if said & _COMMENTS:
        return 3
    if tag in _ROOTS:
        return 0
    return int(tag in _SOFT or own.get("role", "").lower() in _ROLES or bool(said - {"header"} if inside else said))


@lru_cache(maxsize=10_000)
def _doubtful(style: str) -> bool:
    """Whether a part of an element's class is one of the names that say that it is no part of an article."""
    tag, _, names = style.partition(".")
    return tag not in _HEADINGS and bool(_NAMES & set(re.split(r"[^a-z]+", names.lower())))


def _self_closed(tag: str, raw: str) -> bool:
    """Only foreign elements close themselves, and a slash that ends an unquoted attribute doesn't."""
    return tag in ("svg", "math") and raw.endswith("/") and not re.search(r"""=\s*[^\s"'=]*/$""", raw)


class Page:
    """One pass over a page: its blocks of text in order, each with the element it stands in and the article it belongs to.

    What the pass keeps grows with the page, not with its depth: elements and blocks point at what is around them.
    """

    def __init__(self, source: str):
        self.blocks: list[_Block] = []
        self.elements: list[_Element] = []
        self._looks: dict[int, int] = {}  # a hash of the styles of the children by path
        self._styles: dict[int, str] = {}  # the last style of each path
        self._within: list[int] = []  # of each outermost article and main element the innermost element that goes for its role or name, itself included
        self._soft: list[tuple[int, int]] = []  # elements that go for their role or name: the one around, what says so
        self._stack = [_Open("", 0, -1, False, -1, -1, False)]
        self._opened: Counter = Counter()
        self._link = 0  # characters of the run in links
        self._run: list[str] = []
        at, token = 0, _TOKEN
        end = source.rfind(">") + 1  # no tag ends beyond, and what begins one there is text
        while (m := token.search(source, at, end)) is not None:
            if m[2] is not None and not m[4]:  # it ran to the end within quotes; from here on no tag is tried twice
                token = _UNQUOTED
                continue
            self._words(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                at = at if at < end or not m[0].startswith("<!--") or m[0].endswith("-->") else len(source)
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                self._start(tag, m[3])
                if tag in _RAW and not _self_closed(tag, m[3]):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at, end)
                    at = close.end() if close else len(source)
        self._words(source[at:])
        while len(self._stack) > 1:
            self._close()
        self._flush()
        self._settle()

    def _settle(self) -> None:
        """Takes out the blocks of elements that go for their role or name.

        The page's main article is the longest article or main element outside what readers wrote. What is around it, or
        is itself it, stays whatever its name; so does what holds most of the text of a page without one. What readers
        wrote goes with the articles in it, unless next to nothing else is there.
        """
        size = sum(len(x.text) for x in self.blocks)
        held = [0] * len(self._soft)
        for x in self.blocks:
            if x.soft >= 0:
                held[x.soft] += len(x.text)
        readers: list[bool] = []
        for around, kind in self._soft:
            readers.append(kind == 3 or (around >= 0 and readers[around]))
        for i in range(len(self._soft) - 1, -1, -1):  # inner ones come after outer ones
            if self._soft[i][0] >= 0:
                held[self._soft[i][0]] += held[i]
        roots: Counter = Counter()
        for x in self.blocks:
            if x.root >= 0 and (x.soft < 0 or not readers[x.soft]):
                roots[x.root] += len(x.text)
        main = max(roots, key=lambda r: (roots[r], -r), default=-1)
        holds = [False] * len(self._soft)
        i = self._within[main] if main >= 0 else -1
        while i >= 0:
            holds[i], i = True, self._soft[i][0]
        gone: list[bool] = []
        for i, (around, kind) in enumerate(self._soft):
            least = 10 * held[i] <= 9 * size if kind == 3 else 2 * held[i] <= size
            gone.append((around >= 0 and gone[around]) or (not holds[i] and (main >= 0 or least)))
        kept = [x.soft < 0 or not gone[x.soft] for x in self.blocks]
        before = [0, *accumulate(kept)]
        for e in self.elements:
            e.first, e.end = before[e.first], before[e.end]
        self.blocks = [x for x, k in zip(self.blocks, kept) if k]

    def _words(self, text: str) -> None:
        top = self._stack[-1]
        if text and not top.dropped:
            self._run.append(text)
            if top.link:
                self._link += len(text)

    def _flush(self) -> None:
        if self._run:
            text = _BLANK.sub(" ", entities.unescape("".join(self._run))).strip()
            link, self._run, self._link = self._link, [], 0
            if text:
                top = self._stack[-1]
                self.blocks.append(_Block(top.element, text, top.root, top.soft, max(0, len(text) - link)))

    def _start(self, tag: str, raw: str) -> None:
        if tag in _RAW:
            return
        if tag == "br":
            self._words(" ")
            return
        if tag in _BLOCK:
            self._flush()
            if self._opened["p"]:
                self._end("p")
            if tag in _CLOSES and any(self._opened[x] for x in _CLOSES[tag]):
                for x in reversed(self._stack):
                    if x.tag in _WITHIN[tag]:
                        break
                    if x.tag in _CLOSES[tag]:
                        self._end(x.tag)
                        break
        if tag in _VOID:
            return
        own = _attributes(raw)
        top = self._stack[-1]
        style = f"{tag}.{'.'.join(sorted(own.get('class', '').split()))}"
        if top.path in self._looks:
            self._looks[top.path] = (self._looks[top.path] * _BASE + xxhash.xxh64_intdigest(style)) % _MOD
        opens = top.root < 0 and (tag in _ROOTS or own.get("role", "").lower() in ("main", "article"))
        mark = _no_article(tag, own, raw, top.root >= 0 or opens)
        dropped = top.dropped or mark == 2
        root, soft = top.root, top.soft
        if not dropped and mark:
            self._flush()
            self._soft.append((soft, mark))
            soft = len(self._soft) - 1
        if not dropped and opens:
            root = len(self._within)
            self._within.append(soft)
        if dropped and not top.dropped:
            self._flush()
        path, element = xxhash.xxh64_intdigest(style, seed=top.path), top.element
        if tag in _BLOCK and not dropped:
            self._looks.setdefault(path, 0)
            self._styles[path] = style
            self.elements.append(_Element(path, element, len(self.blocks)))
            element = len(self.elements) - 1
        self._opened[tag] += 1
        self._stack.append(_Open(tag, path, element, dropped, root, soft, top.link or tag == "a"))

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if self._opened[tag]:
            while self._stack[-1].tag != tag:
                self._close()
            self._close()

    def _close(self) -> None:
        top, around = self._stack[-1], self._stack[-2]
        if top.dropped or top.tag in _BLOCK or top.soft != around.soft:
            self._flush()
        self._stack.pop()
        self._opened[top.tag] -= 1
        if top.element != around.element:
            self.elements[top.element].end = len(self.blocks)

    def nodes(self) -> Iterator[tuple[int, str, int, int]]:
        """Path, last style, a hash of the styles of the children and one of the text of each block node that holds text, once for each path."""
        sums, powers = [0], [1]
        for x in self.blocks:
            sums.append((sums[-1] * _BASE + xxhash.xxh64_intdigest(x.text)) % _MOD)
            powers.append(powers[-1] * _BASE % _MOD)
        said: dict[int, int] = {}
        for e in self.elements:
            if e.end > e.first:
                own = (sums[e.end] - sums[e.first] * powers[e.end - e.first]) % _MOD
                said[e.path] = (said.get(e.path, 1) * _BASE + own) % _MOD
        for path, text in said.items():
            yield path, self._styles[path], self._looks[path], text

    def text(self, low: set[int]) -> str:
        """The blocks outside low branches; only those in article or main elements if the largest of these holds at least
        as much text as stands outside all of them (the text of links aside). Low branches that hold all the text of the
        page, or of its articles, stay."""
        gone: list[bool] = []
        for e in self.elements:
            gone.append((e.around >= 0 and gone[e.around]) or node_id(e.path) in low)
        high = [x for x in self.blocks if x.element < 0 or not gone[x.element]]
        sizes = Counter()
        for x in high:
            sizes[x.root] += len(x.text) if x.root >= 0 else x.prose
        if low and not any(i >= 0 for i in sizes) and any(x.root >= 0 for x in self.blocks):
            keep = set(map(id, high))
            high = [x for x in self.blocks if x.root >= 0 or id(x) in keep]
            for x in high:
                if x.root >= 0:
                    sizes[x.root] += len(x.text)
        outside = sizes.pop(-1, 0)
        if sizes and max(sizes.values()) >= outside:
            high = [x for x in high if x.root >= 0]
        return "\n".join(x.text for x in high or self.blocks)


def node_id(path: int) -> int:
    return path - (1 << 63)


def host_of(url):
    """The host of a url, in lower case; without one, the empty string."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what nodes look like and read like, summed over each batch before they are sent."""
    for batch in batches:
        counts: Counter = Counter()
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for path, style, looks, text in Page(source or "").nodes():
                node, doubt = node_id(path), 2 * _doubtful(style)
                counts[host, node, doubt, looks] += 1
                counts[host, node, doubt + 1, text] += 1
        columns = list(zip(*counts)) if counts else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((*columns, list(counts.values())), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["host", "node", "kind", "seen", "n"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance and doubtful (by its class) of every block node, over all pages of each host.

    The importance is the weighted entropy of its looks and of its content over the pages that show it (from 0, all
    alike, to 1, all different), drawn to 1 as if it stood on some more pages: UNSEEN, or UNSEEN_DOUBTFUL.
    """
    rows = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    counts = rows.mapInArrow(tidy(_merging), "host string, node long, kind int, seen long, n long").groupBy("host", "node", "kind", "seen").agg(F.sum("n").alias("n"))
    n = F.sum("n")
    entropy = F.when(n > 1, (F.log(n) - F.sum(F.col("n") * F.log("n")) / n) / F.log(n)).otherwise(1.0)
    nodes = counts.groupBy("host", "node", "kind").agg(n.alias("n"), entropy.alias("h"))
    both = nodes.groupBy("host", "node").agg(F.max("n").alias("pages"), F.max(F.when(F.col("kind") % 2 == 0, F.col("h"))).alias("look"), F.max(F.when(F.col("kind") % 2 == 1, F.col("h"))).alias("read"), (F.max("kind") >= 2).alias("doubtful"))
    unseen = F.when(F.col("doubtful"), UNSEEN_DOUBTFUL).otherwise(UNSEEN)
    seen = (1 - CONTENT) * F.col("look") + CONTENT * F.col("read")
    return both.select("host", "node", "pages", ((F.col("pages") * seen + unseen) / (F.col("pages") + unseen)).alias("importance"), "doubtful")


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = [set(x or ()) for x in batch.column(3).to_pylist()]
        text = [Page(source or "").text(x) for source, x in zip(batch.column(2).to_pylist(), low)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    pages has page_id, url and html; other columns are ignored. Blocks stand on lines of their own in page order,
    white space in a block is one space, character references are decoded. A page's text is the page less excluded roles
    and less branches of low importance in the host's tree; if an article or main element holds at least as much of it as
    stands outside all of these, it is what they hold. If only branches of low importance hold text, they stay. An element
    excluded by its role or name stays if it is or holds the page's main article or, on a page without article or main,
    most of the text; what is named for comments goes with the articles in it. Null and empty
    pages have an empty text. Rows without url form the host "". Repeated rows get a row each.
    """
    low = written(style_tree(pages).where((F.col("importance") < F.when(F.col("doubtful"), DOUBTFUL).otherwise(LOW))).groupBy("host").agg(F.collect_set("node").alias("low"), F.count("*").alias("n")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    size = low.agg(F.coalesce(F.sum("n"), F.lit(0)) + F.count("*")).first()[0]
    low = low.select("host", "low")
    both = rows.withColumn("host", host_of(F.col("url"))).join(F.broadcast(low) if size <= BROADCAST_ROWS else low, "host", "left")
    out = both.select("page_id", "url", "html", "low").mapInArrow(tidy(_extracting), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
