"""Main text of web pages by consensus of the pages of a host.

Every page is parsed and its containers (body, main, article, section, div, td) are scored by the text that stands under them; the
best one's generalised path (tags with their first class, digits as #) is the page's vote for its host. Spark counts the votes; paths
with a fifth of a host's votes or more are its winning paths, at most five. Then every page is parsed again, and its text is taken
from the best container on one of its host's winning paths: a page whose reader comments outweigh the article still gives the
article, as its host's other pages say where that stands. Only votes are shuffled, and no page: hosts with their winning paths are sent to all tasks where
they are few (``FEW`` rows of bounded length); where they are many, those of the bounded number of large hosts are, and the other pages are joined by host.

A container's score is the share of the page's text under it, less ``FADE`` for each container between, more for a title that
leads it and for an element that says it is the article. Left out are elements whose tag, role, class or id names them a menu, header, footer, sidebar,
notice, advert, form, script, style or reader comments, hidden ones, and lists of links. Of a header in an article the headings stay. Text of inline elements
runs on; blocks and line breaks are set apart by one space.

Defined cases: a null or empty html, and one without text outside of what is left out, gives an empty text; html without a tag is one block. A page whose
url is null or names no host votes for no one and takes its own best container, as does one that has none of its host's paths, or next to no
text there.
Unclosed, misnested, cut and very long pages are read to their end. References without a semicolon or of no
character are read as browsers do. Ties go to the later, inner container. Repeated rows give a row each; extra columns are not looked at.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch
from bindery.llm.words import released, slices

FADE, TITLE, NAMED, LEAD = 0.85, 0.2, 0.25, 0.95
#: Least share of a host's votes that a winning path has; rows of winning paths that are sent to all tasks; a large host has more than one in so many pages.
SHARE, FEW, LARGE = 0.2, 50_000, 2048
#: Least points that a container on a winning path has, as a share of the page's own best.
SLIGHT = 0.05
#: A name of a host has at most 253 bytes.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([A-Za-z0-9._-]{1,253})(?::[0-9]*)?(?:[/?#]|$)"
VOTES = "host string, path_id long, path string"
PAGE = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl div section table menu".split())
#: What a start tag ends if it is open, and the elements beyond which it doesn't look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS |= {"tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS |= dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"}))
NOT_IN_P = BLOCKS - {"caption", "option", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "legend", "summary", "body", "html", "head", "title"}
P_ENDS = ({"p"}, {"table", "td", "th", "caption", "button", "object", "li"})
WALLS = frozenset({"table", "td", "th", "caption", "object"})

LEFT_OUT = frozenset("script style noscript template nav footer aside form iframe svg button select textarea input dialog menu object canvas audio video title head noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status tooltip".split())
NEGATIVE = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr hidden"
    " login menu menus modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promotion recommended related replies reply"
    " respond share sharing sidebar signup social sponsor sponsored subscribe subscription taboola teaser toc toolbar topbar widget".split()
)
HEADERS = frozenset({"header", "masthead"})
POSITIVE = frozenset("article articlebody blog body content entry hentry main maincontent page post primary single story text".split())
UNLESS = frozenset({"has", "with", "no", "non", "without", "open", "closed"})

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*|'[^']*|[^\s>\"'][^\s>]*))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"[0-9]+")


def _words(token: str) -> list[str]:
    return [w.lower() for w in WORD.findall(token)]


@functools.lru_cache(8192)
def kind_of(tag: str, attributes: str) -> tuple[str, str, bool]:
    """Of a start tag: its step in a generalised path, "" or what it is left out as (out, named, form, header), and whether it says it is the article."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(value.lstrip("\"'")))
    classes = found.get("class", "").split()
    step = f"{tag}.{DIGITS.sub('#', classes[0])}" if classes else tag
    names = [_words(t) for t in [*classes, *found.get("id", "").split()]]
    positive = any(n and POSITIVE.issuperset(n) for n in names)
    says = tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody" or positive and tag in CONTAINERS
    if tag in ("html", "body"):
        return step, "", False
    if tag == "form":
        return step, "form", False
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    if tag in LEFT_OUT or hidden or found.get("role") in ROLES or found.get("itemprop") == "comment":
        return step, "out", False
    if tag == "article":
        negative = any(n and NEGATIVE.issuperset(n) for n in names)
    else:
        negative = any(NEGATIVE.intersection(n) and not UNLESS.intersection(n) for n in names)
    if negative and not positive and tag != "main":
        return step, "named", False
    if tag == "header" or tag != "main" and any(HEADERS.intersection(n) and not UNLESS.intersection(n) for n in names) and not positive:
        return step, "header", False
    return step, "", says


class Page:
    """A parsed page: elements in their order with parents before children, and blocks of text with the element they stand in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kind, self.says, self.path, self.step = [""], [-1], [""], [False], [0], [""]
        #: element, text, characters in links
        self.blocks: list[tuple[int, str, int]] = []
        self._open, self._text, self._linked = [0], [], 0
        #: how many elements of a tag are open; of each element the next one up that breaks text, and the next that lists links
        self._n_open: dict[str, int] = {}
        self._owner, self._holder, self.n_links = [0], [0], [0]
        self._read(source)
        self._judge()

    def _read(self, source: str) -> None:
        at, n, self._at = 0, len(source), 0
        while at < n:
            found = TOKEN.search(source, at)
            self._say(source[at : found.start() if found else n])
            if not found:
                break
            at = found.end()
            name = found[2]
            if not name:
                continue
            name = name.lower()
            if found[1]:
                self._end(name)
                continue
            attributes = found[3]
            empty = name in VOID
            self._start(name, attributes, empty)
            if name in RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else n
        self._flush()

    def _say(self, text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            self._text.append(text)
            if self._n_open.get("a"):
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._at, text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _start(self, tag: str, attributes: str, empty: bool) -> None:
        if tag in NOT_IN_P:
            self._close_any(*P_ENDS)
        if tag in ENDS:
            self._close_any(*ENDS[tag])
        top = self._open[-1]
        if tag in HEADINGS and self.tag[top] in HEADINGS or tag == self.tag[top] == "a":
            self._pop(len(self._open) - 1)
        if tag == "br":
            self._text.append("\n")
        if tag in BLOCKS:
            self._flush()
        if tag == "a":
            self.n_links[self._holder[self._open[-1]]] += 1
        if empty or tag in ("html", "body") and tag in self.tag:
            return
        step, kind, says = (kind_of if len(attributes) < 1000 else kind_of.__wrapped__)(tag, attributes)
        above, own = self._open[-1], len(self.tag)
        self.tag.append(tag)
        self.parent.append(above)
        self.kind.append(kind)
        self.says.append(says)
        self.step.append(step)
        self.n_links.append(0)
        self.path.append(xxhash.xxh64_intdigest(step, self.path[above]))
        self._owner.append(own if tag in BLOCKS or kind else self._owner[above])
        self._holder.append(own if tag in CONTAINERS or tag in LISTS else self._holder[above])
        self._open.append(own)
        self._n_open[tag] = self._n_open.get(tag, 0) + 1
        if self._owner[own] == own:
            self._flush()
            self._at = own

    def _close_any(self, ends: set[str], walls: set[str]) -> None:
        if not any(self._n_open.get(t) for t in ends):
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[k]]
            if tag in ends:
                self._pop(k)
                return
            if tag in walls:
                return

    def _pop(self, upto: int) -> None:
        gone = self._open[upto:]
        if any(self._owner[k] == k for k in gone):
            self._flush()
        for k in gone:
            self._n_open[self.tag[k]] -= 1
        del self._open[upto:]
        self._at = self._owner[self._open[-1]]

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text.append("\n")
        if tag in ("html", "body") or not any(self._n_open.get(t) for t in (HEADINGS if tag in HEADINGS else (tag,))):
            return
        block = tag in BLOCKS
        for k in range(len(self._open) - 1, 0, -1):
            own = self.tag[self._open[k]]
            if own == tag:
                self._pop(k)
                return
            if own in HEADINGS and tag in HEADINGS:
                self._pop(k)
                return
            if own in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot") or not block and own in BLOCKS:
                return

    def _sums(self, values: list[int]) -> list[int]:
        for k in range(len(values) - 1, 0, -1):
            values[self.parent[k]] += values[k]
        return values

    def _judge(self) -> None:
        """Which blocks are kept, and every container's score and points."""
        n = len(self.tag)
        size, linked = [0] * n, [0] * n
        for k, text, in_links in self.blocks:
            if self.tag[k] not in RAW:
                size[k] += len(text)
                linked[k] += in_links
        size, linked, links = self._sums(size), self._sums(linked), self._sums(list(self.n_links))
        # a form around most of the page is its frame; a list of links is a menu
        out = [self.kind[k] for k in range(n)]
        for k in range(1, n):
            if out[k] == "form" and 2 * size[k] > size[0]:
                out[k] = ""
            if not out[k] and self.tag[k] in LISTS and links[k] >= 3 and 10 * linked[k] >= 9 * size[k]:
                out[k] = "out"
        self.kept = self._kept(out)
        if not any(self.kept):
            self.kept = self._kept(["" if x in ("named", "header") else x for x in out])
        points = [0] * n
        for (k, text, in_links), fine in zip(self.blocks, self.kept, strict=True):
            points[k] += fine * (len(text) - in_links)
        near = [float(p) for p in points]
        for k in range(n - 1, 0, -1):
            near[self.parent[k]] += near[k] * (FADE if self.tag[k] in CONTAINERS else 1.0)
        self.points = self._sums(points)
        total = self.points[0]
        # a container is led by a title if a heading has most of its points behind it
        self.score = [0.0] * n
        if not total:
            return
        lead = self._led()
        for k in range(n):
            if self.points[k] and (k == 0 or self.tag[k] in CONTAINERS):
                self.score[k] = near[k] / total + TITLE * lead[k] + NAMED * self.says[k]

    def _kept(self, out: list[str]) -> list[bool]:
        gone, soft, inside = [False] * len(out), [False] * len(out), [False] * len(out)
        for k in range(1, len(out)):
            above = self.parent[k]
            inside[k] = inside[above] or self.tag[k] in ("article", "main") or self.says[k]
            gone[k], soft[k] = gone[above] or bool(out[k]) and out[k] != "header", soft[above]
            if out[k] == "header":
                # of an article's own header the headings stay
                soft[k], gone[k] = True, gone[above] or not inside[above] and not POSITIVE.intersection(_words(self.step[k].partition(".")[2]))
        fine = []
        for k, _, _ in self.blocks:
            title = soft[k] and self._under_heading(k)
            fine.append(not gone[k] and (title or not soft[k]))
        return fine

    def _under_heading(self, k: int) -> bool:
        return self.tag[self._owner[k]] in HEADINGS or self.tag[self._owner[self.parent[k]]] in HEADINGS

    def _led(self) -> list[bool]:
        """Whether a kept heading has most of an element's points behind it."""
        n, never = len(self.tag), self.points[0] + 1
        begun, heading = [0] * n, [never] * n
        seen = at = 0
        # blocks come in page order, and elements are numbered in that order
        for (k, text, in_links), fine in zip(self.blocks, self.kept, strict=True):
            while at <= k:
                begun[at] = seen
                at += 1
            if fine:
                if self._under_heading(k):
                    heading[k] = min(heading[k], seen)
                seen += len(text) - in_links
        begun[at:] = [seen] * (n - at)
        for k in range(n - 1, 0, -1):
            heading[self.parent[k]] = min(heading[self.parent[k]], heading[k])
        return [h < never and h - b <= (1 - LEAD) * p for h, b, p in zip(heading, begun, self.points, strict=True)]

    def best(self, paths: frozenset[int] | None = None) -> int | None:
        """The best container on one of the paths, or of all if none is given or there; None if there is none."""
        found = [None, None]
        for k, s in enumerate(self.score):
            for j in (0, 1) if s > 0 else ():
                if (j == 0 or paths and self.path[k] in paths) and (found[j] is None or s >= self.score[found[j]]):
                    found[j] = k
        own, agreed = found
        return own if agreed is None or self.points[agreed] < SLIGHT * self.points[own] else agreed

    def text(self, container: int | None) -> str:
        if container is None:
            return ""
        inside = [False] * len(self.tag)
        inside[container] = True
        for k in range(container + 1, len(inside)):
            inside[k] = inside[self.parent[k]]
        return " ".join(t for (k, t, _), fine in zip(self.blocks, self.kept, strict=True) if fine and inside[k])

    def path_text(self, container: int) -> str:
        steps = []
        while container > 0:
            steps.append(self.step[container])
            container = self.parent[container]
        return ">".join(reversed(steps))


def signed(path: int) -> int:
    return path - 2**64 if path >= 2**63 else path


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, html): host and path of the best container."""
    for batch in batches:
        for part in slices(batch, 1):
            found = []
            for host, source in zip(*(part.column(c).to_pylist() for c in (0, 1)), strict=True):
                page = Page(source or "")
                if (k := page.best()) is not None:
                    found.append((host, signed(page.path[k]), page.path_text(k)))
            if found:
                host, path, text = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(path, pa.int64()), pa.array(text)], names=["host", "path_id", "path"])


def _texts(known: dict[str, list[int]]):
    """Of (page_id, url, html, host, paths): the text from the best container on the paths, given or known of the host."""
    winning = {h: frozenset(p % 2**64 for p in paths) for h, paths in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = []
                for source, host, given in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                    page = Page(source or "")
                    paths = winning.get(host) if host is not None else None
                    if paths is None and given:
                        paths = frozenset(p % 2**64 for p in given)
                    texts.append(page.text(page.best(paths)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], names=["page_id", "url", "text", "n_chars"])

    return run


def host_of(url: Column) -> Column:
    """The lower-case host of a url, or null."""
    host = F.regexp_extract(url, HOST, 1)
    return F.when(host != "", F.lower(host))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))


def host_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """host, path_id, path, votes, pages of the winning paths of every host; pages counts the host's votes for any path."""
    votes = _pages(pages).where("host is not null").select("host", "html").mapInArrow(released(_votes), VOTES)
    votes = votes.groupBy("host", "path_id").agg(F.count(F.lit(1)).alias("votes"), F.min("path").alias("path"))
    total = votes.groupBy("host").agg(F.sum("votes").alias("pages"))
    return votes.join(total, "host").where(F.col("votes") >= F.col("pages") * share).select("host", "path_id", "path", "votes", "pages")


def extract(pages: DataFrame, share: float = SHARE, few: int = FEW, large: int = LARGE) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession, "htmltext")
    winning = scratch.save(host_paths(pages, share).select("host", "path_id", "pages"), "winning")
    rows = _pages(pages)
    sent = winning
    if winning.count() > few:
        # large hosts have more than one in ``large`` of all votes, so they are at most ``large``
        n = winning.select("host", "pages").distinct().agg(F.sum("pages")).first()[0]
        sent = winning.where(F.col("pages") * large > n)
        small = winning.where(F.col("pages") * large <= n).groupBy("host").agg(F.collect_list("path_id").alias("paths"))
        hot = {r.host for r in sent.select("host").distinct().collect()}
        key = F.when(~F.coalesce(F.col("host").isin(list(hot)), F.lit(True)), F.col("host")) if hot else F.col("host")
        rows = rows.withColumn("_key", F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64("page_id", "html").cast("string"))))
        rows = rows.join(small.withColumnRenamed("host", "_key").hint("merge"), "_key", "left").drop("_key")
    else:
        rows = rows.withColumn("paths", F.lit(None).cast("array<long>"))
    known: dict[str, list[int]] = {}
    for r in sent.select("host", "path_id").collect():
        known.setdefault(r.host, []).append(r.path_id)
    return rows.select("page_id", "url", "html", "host", "paths").mapInArrow(released(_texts(known)), PAGE)
