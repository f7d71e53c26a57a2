"""Landed programme pages to listings and screenings. Pages are files or rows; nothing is fetched here.

A page is a list of films (`.movie-item`), each with a title, genres, an optional length, and days
(`.day-wrapper` with `data-date`, or date tabs `.tab` paired by position with panes `.pane`), each with
screenings (`a.perf`). Films without a title or a screening in the window are dropped. The parser is the
standard library's, run in batches by the executors; there is no built-in for HTML.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import extract
from marquee.functions.text import WS

#: White space as the titles' functions have it, with U+FEFF.
SPACES = re.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", WS) + "+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None) -> None:
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def find(self, tag: str | None = None, cls: str | None = None) -> list[Node]:
        return [n for n in self.walk() if (tag is None or n.tag == tag) and (cls is None or cls in n.classes())]

    def text(self, without: str | None = None) -> str:
        return SPACES.sub(" ", "".join(k if isinstance(k, str) else "" if k.tag == without else k.text(without) for k in self.kids)).strip(" ") if self.tag not in ("script", "style") else ""


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, dict(attrs), self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def films(html: str | None, days: frozenset[str] | None = None) -> list[dict]:
    """The films of a page in order, with their screenings (date, time, code, hall, url) within `days`."""
    out = []
    for item in tree(html).find(cls="movie-item"):
        heads = [n for n in item.walk() if n.tag in ("h1", "h2", "h3")]
        title = heads[0].text(without="span") if heads else ""
        labels = {p.find(tag="strong")[0].text().rstrip(":").lower(): p.text(without="strong") for p in item.find(tag="p") if p.find(tag="strong")}
        shows = []
        blocks = [(n.attrs.get("data-date") or "", n) for n in item.find(cls="day-wrapper")]
        tabs, panes = item.find(cls="tab"), item.find(cls="pane")
        blocks += [(t.attrs.get("data-date") or t.text(), p) for t, p in zip(tabs, panes)]
        for day, block in blocks:
            if days is not None and day not in days:
                continue
            for a in block.find(tag="a", cls="perf"):
                href = a.attrs.get("href") or ""
                if href.rstrip("/").endswith("/index"):  # a placeholder without an id
                    continue
                shows.append({"date": day, "time": a.text(without="em"), "code": a.attrs.get("data-format") or "", "hall": a.attrs.get("data-hall"), "url": href})
        if title and shows:
            posters = item.find(tag="img")
            out.append({"title": title, "genres": [g.strip() for g in labels.get("žanr", labels.get("genre", "")).replace(";", ",").replace("/", ",").replace("|", ",").split(",") if g.strip()], "original": labels.get("izvorni naslov"), "minutes": labels.get("trajanje"), "poster": posters[0].attrs.get("src") if posters else None, "shows": shows})
    return out


SHOWS = "url string, title string, original_title string, minutes string, genres array<string>, poster_url string, listing_ord int, show_ord int, date string, time string, code string, hall string, booking_url string"


def parse_pages(pages: DataFrame, days: list[str] | None = None, most: int = 8 << 20) -> DataFrame:
    """One row per screening of the pages (url, body). Bodies beyond `most` bytes are refused (see `refused`), null ones have none."""
    window = frozenset(days) if days is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, body in zip(b["url"], b["body"]):
                for i, f in enumerate(films(body, window)):
                    rows += [(url, f["title"], f["original"], f["minutes"], f["genres"], f["poster"], i, k, s["date"], s["time"], s["code"], s["hall"], s["url"]) for k, s in enumerate(f["shows"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SHOWS.split(", ")])

    return pages.select("url", "body").where("body is not null").where(F.octet_length("body") <= most).mapInPandas(run, SHOWS)


def refused(pages: DataFrame, most: int = 8 << 20) -> DataFrame:
    """(url, error) of the pages that `parse_pages` does not read."""
    size = F.octet_length("body")
    return pages.where(size > most).select("url", F.concat(F.lit(f"more than {most} bytes: "), size.cast("string")).alias("error"))


def film_title(page: Node) -> str | None:
    """The title of a film's own page: its first heading, else what it says to other sites."""
    head = page.find(tag="h1")
    if head and (t := head[0].text()):
        return t
    meta = [m.attrs.get("content") or "" for m in page.find(tag="meta") if m.attrs.get("property") == "og:title"]
    return next((t for m in meta if (t := SPACES.sub(" ", m).strip(" "))), None)


DETAILS = "url string, title string, line string, poster_url string"


def film_pages(pages: DataFrame) -> DataFrame:
    """(url, title, line, poster_url) of film pages (url, body): `line` is the first paragraph beside the heading, from which
    the functions of `extract` read original title, length and country. Broken pages have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, body in zip(b["url"], b["body"]):
                page = tree(body)
                head = page.find(tag="h1")
                near = (head[0].up or page).find(tag="p") if head else []
                og = [m.attrs.get("content") for m in page.find(tag="meta") if m.attrs.get("property") == "og:image"]
                rows.append((url, film_title(page), near[0].text() if near else None, og[0] if og else None))
            yield pd.DataFrame(rows, columns=["url", "title", "line", "poster_url"])

    return pages.select("url", "body").mapInPandas(run, DETAILS)


def film_links(pages: DataFrame, base: str, pattern: str = r"/film/\d+") -> DataFrame:
    """(page, url, ord, title, poster_url): the films that home pages (url, body) link to, one per address, resolved against `base`.

    An address counts if its path is of the pattern; title and poster are the first that any of its anchors has.
    """
    fits = re.compile(pattern + "$")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, body in zip(b["url"], b["body"]):
                found: dict[str, list] = {}
                for href, title, poster in links(body, ""):
                    try:
                        url = urljoin(base, href)
                        ok = bool(fits.search(urlsplit(url).path.rstrip("/")))
                    except ValueError:
                        continue
                    if ok:
                        x = found.setdefault(url, ["", None])
                        x[0], x[1] = x[0] or title, x[1] or (urljoin(base, poster) if poster else None)
                rows += [(page, u, i, t or None, p) for i, (u, (t, p)) in enumerate(found.items())]
            yield pd.DataFrame(rows, columns=["page", "url", "ord", "title", "poster_url"])

    return pages.select("url", "body").where("body is not null").mapInPandas(run, "page string, url string, ord int, title string, poster_url string")


def with_details(listed: DataFrame, details: DataFrame, shows: DataFrame) -> DataFrame:
    """Listed films (url, title, ...) with what their own pages say and their screenings (url, ...).

    A film whose page is missing or broken keeps what was listed; one without title or screening is dropped.
    """
    d = details.select("url", F.col("title").alias("_t"), "line", F.col("poster_url").alias("_p")).dropDuplicates(["url"])
    x = listed.join(d, "url", "left").withColumns({"title": F.coalesce(F.nullif("title", F.lit("")), "_t"), "poster_url": F.coalesce("poster_url", "_p")}).drop("_t", "_p")
    x = x.withColumns({"original_title": extract.original_title(F.col("line")), "runtime_minutes": extract.runtime(F.col("line"))})
    return x.where("title is not null").join(shows, "url")


def links(html: str | None, part: str) -> list[tuple[str, str, str | None]]:
    """(address without fragment, title, poster) of the anchors whose address has `part`, one per address: first non-empty title and poster."""
    found: dict[str, list] = {}
    for a in tree(html).find(tag="a"):
        href = (a.attrs.get("href") or "").split("#")[0]
        if part in href:
            x = found.setdefault(href, ["", None])
            x[0] = x[0] or a.attrs.get("title") or a.text()
            img = a.find(tag="img")
            x[1] = x[1] or (img[0].attrs.get("src") if img else None)
    return [(h, t, p) for h, (t, p) in found.items()]
