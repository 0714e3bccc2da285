"""Pages as they are: what they say of themselves, their main text, and their links.

A tokenizer with a stack of open elements reads each page once, in the tasks; rules on what it
found are expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.text import canonical_url

# Elements by what they mean for the text, and what JSON-LD calls an article and its dates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg nav aside footer form button select iframe".split())
BLOCKS = frozenset("address article blockquote body br dd div dl dt figcaption h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table td th tr ul".split())
MAIN = frozenset(["article", "main"])
#: words in an element's class or id that stand for what is not the text
BESIDE = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie footer menu nav navbar pagination promo related share sharing sidebar social sponsored".split())
ARTICLES = frozenset(["BlogPosting", "NewsArticle", "Article", "TechArticle"])
DATES = ("datePublished", "dateCreated", "uploadDate")
#: a block whose links hold more of it than this is a list of links
LINKED = 0.5

KIND = (
    "page_id {id}, canonicals array<string>, social_title string, document_title string, lang string, published string, "
    "body string, text_chars long, link_chars long, links array<struct<href:string,title:string,origin:string>>"
)


class Page(HTMLParser):
    """Reads a page; ``told`` gives what it found."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # elements, and whether their text counts for nothing
        self.mute = 0
        self.lang = self.social = self.meta_date = None
        self.canonicals: dict[str, str] = {}
        self.title: list[str] | None = None
        self.heading = ""
        self.scripts: list[str] = []
        self.script: list[str] | None = None
        self.links: list[tuple[str, list[str]]] = []
        self.blocks: list[tuple[str, int, bool]] = []
        self.held: list[str] = []
        self.linked = 0
        self.anchors = self.inside = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given: dict[str, str] = {}
        for name, value in attrs:
            given.setdefault(name, (value or "").strip())
        if tag == "html":
            self.lang = self.lang or given.get("lang")
        elif tag == "link" and "canonical" in given.get("rel", "").lower().split():
            self.canonicals.setdefault("link", given.get("href", ""))
        elif tag == "meta":
            name, content = (given.get("property") or given.get("name", "")).lower(), given.get("content", "")
            if name == "og:url":
                self.canonicals.setdefault("og", content)
            elif name in ("og:title", "twitter:title"):
                self.social = self.social or content
            elif name == "article:published_time":
                self.meta_date = self.meta_date or content
        elif tag == "title" and self.title is None:
            self.title = []
        elif tag == "script" and given.get("type", "").lower() == "application/ld+json":
            self.script = []
        if tag in BLOCKS:
            self.close_block()
        if tag in VOID:
            return
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and any(t == tag for t, _ in self.open[-1:]):
            self.handle_endtag(tag)  # such elements end where the next one begins
        names = {w for c in ("class", "id") for w in given.get(c, "").lower().replace("_", "-").split()}
        mute = tag in SILENT or bool(names & BESIDE)
        self.open.append((tag, mute))
        self.mute += mute
        self.inside += tag in MAIN
        if tag == "a":
            self.anchors += 1
            self.links.append((given.get("href", ""), []))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.script is not None:
            self.scripts.append("".join(self.script))
            self.script = None
        if tag == "title" and self.title is not None:
            self.title.append("\0")  # only the first one counts
        if tag in BLOCKS:
            self.close_block()
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            name, mute = self.open.pop()
            self.mute -= mute
            self.inside -= name in MAIN
            self.anchors -= name == "a"
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)
        elif self.title is not None and self.open and self.open[-1][0] == "title":
            self.title.append(data)
        elif not self.open or self.open[-1][0] not in ("script", "style"):
            if self.anchors and self.links:
                self.links[-1][1].append(data)
            if not self.mute and not any(t == "head" for t, _ in self.open):
                self.held.append(data)
                if self.anchors:
                    self.linked += len("".join(data.split()))

    def close_block(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append((text, self.linked, self.inside > 0))
        self.held, self.linked = [], 0

    def body(self) -> list[tuple[str, int, bool]]:
        """Blocks of the text: those in an article or main element if there are some, without lists of links."""
        within = [b for b in self.blocks if b[2]] or self.blocks
        return [b for b in within if b[1] <= LINKED * len(b[0].replace(" ", ""))]


def nodes(value: object) -> Iterator[dict]:
    """Every object in a JSON value."""
    stack = [value]
    while stack:
        here = stack.pop()
        if isinstance(here, dict):
            yield here
            stack += reversed(here.values())
        elif isinstance(here, list):
            stack += reversed(here)


def told(url: str | None, html: str | None) -> dict:
    page = Page()
    page.feed(html or "")
    page.close()
    page.close_block()
    data = []
    for text in page.scripts:
        try:
            data.append(json.loads(text))
        except ValueError:
            continue
    found = [n for d in data for n in nodes(d)]
    dates = [n[k] for n in found for k in DATES if isinstance(n.get(k), str)]
    links = []
    for n in found:
        if n.get("@type") in ARTICLES if isinstance(n.get("@type"), str) else False:
            to = n.get("url") or n.get("mainEntityOfPage")
            to = to.get("@id") if isinstance(to, dict) else to
            if isinstance(to, str):
                links.append((to, n.get("headline"), "json-ld"))
    links += [(href, " ".join("".join(text).split()) or None, "anchor") for href, text in page.links]
    joined = []
    for href, title, origin in links:
        try:
            to = urljoin(url or "", href.strip()) if href.strip() and href.strip()[0] != "#" else None
        except ValueError:
            to = None
        if to:
            joined.append({"href": to, "title": title if isinstance(title, str) else None, "origin": origin})
    body = page.body()
    title = " ".join("".join(page.title or []).split("\0")[0].split())
    canonicals = [page.canonicals.get(k) for k in ("link", "og")]
    return {
        "canonicals": [c for c in canonicals if c], "social_title": page.social, "document_title": title or None, "lang": page.lang or None, "published": dates[0] if dates else page.meta_date,
        "body": "\n".join(b[0] for b in body), "text_chars": sum(len(b[0].replace(" ", "")) for b in body), "link_chars": sum(b[1] for b in body), "links": joined,
    }


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page (``KIND``). Null pages are empty ones; broken marks are read as far as they make sense."""
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    schema = KIND.format(id=rows.schema[0].dataType.simpleString())
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                out = [{"page_id": k} | told(url, html) for k, url, html in zip(*[c.to_pylist() for c in part.columns])]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("page_id", id_col)


def articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, canonical, title, lang, published_at, body, text_chars, link_chars of every page.

    The canonical address is the first usable one that the page names, else its own; the title is that given for
    sharing, else the document's without the site's name behind it; the date is that of its JSON-LD.
    """
    found = parsed(pages, id_col, url_col).join(pages.select(id_col, F.col(url_col).alias("__url")).distinct(), id_col)
    named = F.get(F.filter(F.transform("canonicals", canonical_url), lambda c: c.isNotNull()), F.lit(0))
    plain = F.regexp_replace("document_title", r"(?s)^(.{4,}?)\s+[-|–—_·]\s+.*$", "$1")
    title = F.coalesce(F.nullif("social_title", F.lit("")), plain)
    return found.select(
        id_col, F.coalesce(named, canonical_url(F.col("__url"))).alias("canonical"), title.alias("title"), "lang", F.try_to_timestamp("published").alias("published_at"), "body", "text_chars", "link_chars"
    )


#: paths of menus and lists
MENU = "/(tags?|categor(y|ies)|author|page)/|/(search|login|signup|pricing|careers|contact|privacy|terms|rss|feed|about)"


def article_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", below: bool = False) -> DataFrame:
    """id, link, title, origin, place: addresses of articles that a page names, those of its JSON-LD first, each once.

    They are on the page's host, are no menu page and have a path of more than three characters; below: they lie below the page's own path.
    """
    rows = parsed(pages, id_col, url_col).join(pages.select(id_col, F.col(url_col).alias("__url")).distinct(), id_col)
    rows = rows.select(id_col, "__url", F.posexplode("links").alias("place", "l")).select(id_col, "__url", "place", "l.*")
    bare = F.regexp_extract("href", r"^(https?://[^?#]*)", 1)
    host = lambda c: F.lower(F.regexp_extract(c, r"^https?://([^/?#]*)", 1))
    path = lambda c: F.regexp_extract(c, r"^https?://[^/?#]*(/[^?#]*)", 1)
    trimmed = lambda c: F.regexp_replace(path(c), "/+$", "")
    inside = F.col("origin") == "json-ld"
    own, there = trimmed(F.col("__url")), trimmed(F.col("href"))
    rest = F.length(there) - F.when(F.lit(below), F.length(own)).otherwise(1)
    fits = (host("href") == host("__url")) & ~F.lower(path(F.col("href"))).rlike(MENU) & (there != own) & (rest > 3)
    fits = fits & F.startswith(there, own) if below else fits
    kept = rows.filter((bare != "") & (inside | fits)).select(id_col, bare.alias("link"), "title", "origin", "place")
    return kept.groupBy(id_col, "link").agg(F.min_by(F.struct("title", "origin", "place"), "place").alias("x")).select(id_col, "link", "x.*")
