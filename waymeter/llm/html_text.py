"""Main text of web pages by consensus host paths.

Every page scores its containers: letters of running text inside, less what its links and boilerplate weigh. Its best container
votes, by its path of tags and generalised classes, for its host; votes are summed in Spark. Each page is then read again and the
containers on its host's winning path give the text; a page without one falls back on its own best container.

A page is parsed with one scanner over its tags that knows which elements close by themselves and where the open ones of each name
stand; ancestors are kept as parent numbers and paths as hashes of 32 characters, so that a page costs time in proportion to its
length whatever its markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise

# Element names, as HTML has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "select")
BLOCK = frozenset("html body address article aside blockquote br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
SKIP = frozenset("nav header footer aside form button menu dialog head".split())
NOISE = frozenset("ad ads adv advert advertisement adverts advertising adbox banner banners sponsor sponsored promo promotion cookie cookies consent notice notices sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comments disqus newsletter subscribe subscription signup login popup modal".split())
#: Words that mark boilerplate on containers alone: on paragraphs, items and the like they describe what an article says.
LOOSE_NOISE = frozenset("alert alerts widget widgets toc comment commentlist responses reply replies respond discussion share sharing social related recommended overlay skip hidden".split())
CONTAINERS = frozenset("div section ul ol table center details fieldset hgroup".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
# A tag ends at the first '>' that is in no quoted value; quotes are values only after '='.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
_OTHER = r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])ATTRS.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>ATTRS)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|(?P<open></?(?=[a-zA-Z]))"
SCAN, SCAN_LOOSE = (re.compile(_OTHER.replace("ATTRS", attrs), re.S | re.I) for attrs in (_ATTRS, r"[^>]*+>"))
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)""", re.I)
KEEPS_P = ("table", "td", "th", "button", "li", "div", "section", "article", "blockquote")


@dataclass
class Page:
    """Elements by number (0 is the page itself) and the pieces of text between tags, each with the element it stands in."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    path: list[str] = field(default_factory=lambda: [""])
    noise: list[bool] = field(default_factory=lambda: [False])
    pieces: list[tuple[int, str]] = field(default_factory=list)


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """An element's part of a path, digits left out, and whether it is boilerplate."""
    classes, noise = [], tag in SKIP
    for m in ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            said = re.split(r"[^a-z]+", value)
            noise |= not NOISE.isdisjoint(said) or (tag in CONTAINERS and not LOOSE_NOISE.isdisjoint(said))
            if name == "class":
                classes = sorted({c for x in value.split() if (c := re.sub(r"\d+", "", x))})
        elif name == "role":
            noise |= value in ROLES
        else:
            noise |= name == "hidden" or value == "true"
    return ".".join([tag, *classes]), noise and tag not in ("body", "html", "article", "main")


def _tags(text: str) -> Iterator[re.Match]:
    """Tags, comments and raw elements, each part of the text read a bounded number of times.

    A tag that no '>' ends outside its quotes shows that a quote is never closed: from there on quotes protect nothing. A tag
    without any '>' after it takes the rest of the page with it.
    """
    for m in SCAN.finditer(text):
        if m["open"] is None:
            yield m
            continue
        for m in SCAN_LOOSE.finditer(text, m.start()):
            if m["open"] is not None:
                m = re.compile(r".*", re.S).match(text, m.start())
                yield m
                return
            yield m
        return


def parse(text: str) -> Page:
    """The page's elements and pieces of text, references decoded piece by piece. In time proportional to its length."""
    page, open_, at = Page(), [0], 0
    places: dict[str, list[int]] = {}

    def close(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """Closes the innermost open element of ``names``, and what is open in it, unless one of ``stop`` is inside of it."""
        last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
        depth = last(names)
        if depth > last(stop):
            for i in open_[depth:]:
                places[page.tag[i]].pop()
            del open_[depth:]

    def said(piece: str) -> None:
        page.pieces.append((open_[-1], html.unescape(piece) if "&" in piece else piece))

    for m in _tags(text):
        if m.start() > at:
            said(text[at : m.start()])
        at = m.end()
        if not (m.re.groups and m["tag"]):
            continue
        tag = m["tag"].lower()
        if tag in BLOCK:
            said(" ")
        if m["end"]:
            close((tag,))
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            close(("p",), KEEPS_P)
        if tag in CLOSES:
            close(*CLOSES[tag])
        up = open_[-1]
        label, noise = _label(tag, m["attrs"][:-1])
        page.parent.append(up)
        page.tag.append(tag)
        # paths are chained hashes: as short for a page of any depth and any classes
        page.path.append(page.path[up] if tag in ("html", "body") else xxhash.xxh3_128_hexdigest(f"{page.path[up]}>{label}"))
        page.noise.append(page.noise[up] or noise)
        places.setdefault(tag, []).append(len(open_))
        open_.append(len(page.tag) - 1)
    if at < len(text):
        said(text[at:])
    return page


def scores(page: Page) -> list[float]:
    """For each element: letters of running text in it, less three for each letter of a link and two for each of boilerplate."""
    s, link = [0.0] * len(page.tag), [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        link[i] = link[page.parent[i]] or page.tag[i] == "a"
    for i, piece in page.pieces:
        s[i] += len(piece.strip()) * (-2 if page.noise[i] else -3 if link[i] else 1)
    for i in range(len(s) - 1, 0, -1):
        s[page.parent[i]] += s[i]
    return s


def best(page: Page) -> tuple[int, float]:
    """The container with the highest score, the innermost of equals; only such as may hold blocks."""
    s = scores(page)
    can = [i for i in range(len(s)) if not page.noise[i] and (page.tag[i] in ("", "html", "body", "article", "main", "section", "div", "td", "center", "blockquote") or "-" in page.tag[i])]
    top = max(can, key=lambda i: (s[i], i))
    return top, s[top]


def text_of(page: Page, roots: list[int]) -> str:
    inside = [False] * len(page.tag)
    for i in roots:
        inside[i] = True
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[page.parent[i]]
    return " ".join("".join(piece for i, piece in page.pieces if inside[i] and not page.noise[i]).split())


def main_text(source: str, path: str | None) -> str:
    """The text of the containers on ``path``, or of the best one where there are none with text."""
    page = parse(source)
    if path is not None:
        roots = [i for i in range(len(page.path)) if page.path[i] == path and not page.noise[i] and page.tag[i] not in ("html", "body")]
        if roots and (found := text_of(page, roots)):
            return found
    return text_of(page, [best(page)[0]])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, votes = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = parse(source.as_py() or "")
            i, s = best(page)
            if s > 0:
                hosts.append(host)
                paths.append(page.path[i])
                votes.append(1 + min(9, int(s // 500)))  # longer texts are surer, within bounds
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], ["host", "path", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            texts = [main_text(s.as_py() or "", p.as_py()) for s, p in zip(part.column(1), part.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "text"])


def host_of(url):
    """The host of a URL in lower case, without user or port; '' for null or for what has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", carry: list[str] | None = None, hosts_bound: int = 100_000) -> DataFrame:
    """(row, text) for each row of ``pages``: ``row`` is a struct of the columns in ``carry`` (default: all but the html).

    Null or empty html gives ''. Pages without a host vote together. Repeated rows vote as often as they occur. Ties go to the
    greater path. Winning paths of up to ``hosts_bound`` hosts are broadcast (about 100 bytes each). Of more, those of hosts with a
    thousandth of the voting pages or more are (a thousand hosts at most), and the others are joined.
    """
    bound_batches(pages.sparkSession)
    carry = carry or [c for c in pages.columns if c != html_col]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("h"))
    sums = rows.select("host", "h").mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.count("*").alias("n"))
    winners = materialise(sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"), F.sum("n").alias("n")), "paths")
    schema = rows.select("row").schema.add("text", "string")
    if winners.limit(hosts_bound + 1).count() <= hosts_bound:
        return rows.join(F.broadcast(winners), "host", "left").select("row", "h", "path").mapInArrow(_extract, schema)
    total = winners.agg(F.sum("n")).first()[0]
    hot = winners.where(F.col("n") * 1000 >= total).select("host", "path", F.lit(True).alias("hot"))
    met = rows.join(F.broadcast(hot), "host", "left")
    rest = met.where("hot is null").drop("path", "hot").join(winners, "host", "left")
    return met.where("hot").select("row", "h", "path").unionByName(rest.select("row", "h", "path")).mapInArrow(_extract, schema)
